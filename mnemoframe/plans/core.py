"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.operators import hierarchy, timestamps
from mnemoframe.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("chat_messages", "chat_sessions", "chat_zones", "zone_abbrevs")
    return timestamps.message_times(*(table(spark, sf_dir, n) for n in names)).filter("utc is not null").select("src", "row_id", "utc")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "entity_tree_nodes"), tree_col="entity_id").select("id", "root_id")


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, root_id, depth, path); the path as text, ids joined by '/'."""
    found = hierarchy.hierarchy(table(spark, sf_dir, "entity_tree_nodes"), tree_col="entity_id", with_paths=True)
    return found.select("id", "root_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, descendant_id, distance) of every node and every node under it."""
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, sf_dir, "entity_tree_nodes"), tree_col="entity_id", with_paths=True))


_WALK = """
WITH RECURSIVE n AS (
  SELECT id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS r FROM entity_tree_nodes WHERE id IS NOT NULL) WHERE r = 1
), walk AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(id AS VARCHAR) AS path FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM n)
  UNION ALL
  SELECT n.id, w.root_id, w.depth + 1, w.path || '/' || CAST(n.id AS VARCHAR) FROM n JOIN walk w ON n.parent_id = w.id
)"""

QUERIES = {f.__name__: f for f in (p4_found, p7_found, p7_paths, p7_descendants)}
ORACLE = {
    "p7_found": f"{_WALK} SELECT n.id, coalesce(w.root_id, -1) AS root_id FROM n LEFT JOIN walk w USING (id)",
    "p7_paths": f"{_WALK} SELECT n.id, coalesce(w.root_id, -1) AS root_id, w.depth, coalesce(w.path, '') AS path FROM n LEFT JOIN walk w USING (id)",
    "p7_descendants": f"""{_WALK}, down AS (
      SELECT n.parent_id AS id, n.id AS descendant_id, CAST(1 AS BIGINT) AS distance FROM n JOIN walk w ON n.parent_id = w.id
      UNION ALL SELECT d.id, n.id, d.distance + 1 FROM down d JOIN n ON n.parent_id = d.descendant_id
    ) SELECT id, descendant_id, distance FROM down""",
}
