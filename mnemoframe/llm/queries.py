"""Queries over the operators of this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import conversations, encoding, leaks, names, nearduplicates, neighbours, splitting, subjects
from mnemoframe.runtime import table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's content as pieces within the limits, in order under their document and chunk_index."""
    return splitting.split_items(table(spark, sf_dir, "file_chunks"), "chunk_id", "content", keep=("document_id", "chunk_index")).withColumnRenamed("id", "chunk_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).filter("oversized and piece_index = 0").select("chunk_id")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, task_id, grp): rows of a task with equal grp denote the same person or organisation."""
    return names.same_names(table(spark, sf_dir, "entities"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_pairs(p2_groups(spark, sf_dir))


def _near(spark: SparkSession, sf_dir: str, min_cosine: float | None = None, every: int = 1) -> DataFrame:
    facts = neighbours.neighbours(table(spark, sf_dir, "facts"), "id", "text_embedding", min_cosine=min_cosine, every=every).withColumn("src", F.lit("facts"))
    entities = neighbours.neighbours(table(spark, sf_dir, "entities"), "id", "desc_embedding", min_cosine=min_cosine, every=every).withColumn("src", F.lit("entities"))
    return facts.unionByName(entities).select("src", "id", "neighbour_id", "cosine", "rank")


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, neighbour_id, cosine, rank) of facts and entities."""
    return _near(spark, sf_dir)


def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, neighbour_id, rank): of every row whose id is divisible by 100 the five nearest among all rows, whatever their cosine."""
    return _near(spark, sf_dir, every=100).drop("cosine")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir, neighbours.MIN_COSINE)
    return near.select("src", F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


def _assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return conversations.assemble(table(spark, sf_dir, "chat_sessions"), table(spark, sf_dir, "chat_messages"), table(spark, sf_dir, "speaker_aliases"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)[0].filter("reason is not null").select("session_id")


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn, role, speaker, content) of every sound session."""
    return _assembled(spark, sf_dir)[1]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.alike_pairs(*nearduplicates.alike(table(spark, sf_dir, "facts")))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, n_links): the group of each fact with words, by its smallest id, and the links of its class to others."""
    return nearduplicates.alike_groups(*nearduplicates.alike(table(spark, sf_dir, "facts")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_pieces, p2_found, p2_groups, p3_found, p3_neighbours, p3_search, p5_found, p5_conversations, p6_found, p6_groups, p8_ids, p9_found, p10_found)
    return {f.__name__: f for f in found}


_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
_WORDS = rf"regexp_extract_all(regexp_replace(lower(TEXT), '({_CJK})', ' \1 ', 'g'), '{_CJK}|[\p{{L}}\p{{N}}]+')"
_ROLES = r"""
msg AS (
  SELECT DISTINCT session_id, position, speaker, content FROM chat_messages WHERE session_id IN (SELECT id FROM chat_sessions)
), roled AS (
  SELECT m.*, coalesce(a.role, 'user') AS role
  FROM msg m LEFT JOIN speaker_aliases a ON lower(regexp_replace(coalesce(m.speaker, ''), '[^\p{L}]', '', 'g')) = a.alias
), per AS (
  SELECT session_id, count(*) AS n, count(DISTINCT position) AS np, min(position) AS lo, max(position) AS hi,
         bool_or(position IS NULL) AS unplaced,
         bool_or(regexp_matches(coalesce(speaker, ''), '^[\s\p{Z}]*$') OR regexp_matches(coalesce(content, ''), '^[\s\p{Z}]*$')) AS blank,
         bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a,
         arg_max(role, position) FILTER (WHERE role <> 'system') AS last_role
  FROM roled GROUP BY session_id
), sound AS (
  SELECT session_id, lo FROM per
  WHERE NOT blank AND NOT unplaced AND n = np AND hi - lo + 1 = n AND lo IN (0, 1) AND u AND a AND last_role = 'assistant'
)"""


def _nearest_sql(src: str, column: str) -> str:
    return f"""
      v AS (SELECT DISTINCT id, CAST({column} AS DOUBLE[]) AS x FROM {src} WHERE id IS NOT NULL AND len({column}) = 64
            AND len(list_filter({column}, lambda y: y IS NOT NULL AND isfinite(y))) = 64 AND len(list_filter({column}, lambda y: y <> 0)) > 0),
      c AS (SELECT q.id, o.id AS neighbour_id, round(list_cosine_similarity(q.x, o.x), 9) AS s FROM v q, v o WHERE q.id % 100 = 0 AND q.id <> o.id)
      SELECT '{src}' AS src, id, neighbour_id, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_search": f"SELECT * FROM (WITH {_nearest_sql('facts', 'text_embedding')}) UNION ALL SELECT * FROM (WITH {_nearest_sql('entities', 'desc_embedding')})",
        "p1_found": rf"""
            SELECT DISTINCT chunk_id FROM file_chunks
            WHERE length(content) > 1200
               OR len(regexp_extract_all(content, '{_CJK}|[^ \t\r\n\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}]+')) > 160""",
        "p5_found": f"WITH {_ROLES} SELECT DISTINCT id AS session_id FROM chat_sessions WHERE id NOT IN (SELECT session_id FROM sound)",
        "p5_conversations": f"WITH {_ROLES} SELECT r.session_id, r.position - s.lo AS turn, r.role, r.speaker, r.content FROM roled r JOIN sound s USING (session_id)",
        "p9_found": rf"""
            WITH texts AS (
              SELECT item_id, {_WORDS.replace('TEXT', 'question')} AS w FROM eval_items
              UNION ALL SELECT item_id, {_WORDS.replace('TEXT', 'passage')} FROM eval_items
            ), windows AS (
              SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS k FROM texts, unnest(range(1, len(w) - 10)) AS r(i)
            ), dw AS (SELECT doc_id, {_WORDS.replace('TEXT', 'text')} AS w FROM documents WHERE text IS NOT NULL),
            dwin AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS k FROM dw, unnest(range(1, len(w) - 10)) AS r(i))
            SELECT DISTINCT doc_id, item_id FROM dwin JOIN windows USING (k)""",
    }
