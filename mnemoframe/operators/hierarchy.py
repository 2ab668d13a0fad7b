"""Parent-child links to full hierarchies.

Fragment contraction: rows are ranged over partitions by tree and id, each partition follows its own parent chains with pointer
doubling in numpy and keeps for each node the exit of its chain (the top node of the chain inside the partition, and the parent that the
top points to). Only the tops go on to the next, smaller level, whose answer is joined back. A level that fits one partition is solved
there outright; a level that shrinks too little is finished by distributed pointer doubling, in as many rounds as the logarithm of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.runtime import checkpointed, partitions_for, skew_join

#: Nodes of one fragment: 1 << 18 nodes are about 10 MB of numpy arrays.
FRAGMENT_ROWS = 1 << 18
#: With paths the fragment also holds the chain of every node, so it is kept small.
FRAGMENT_ROWS_PATHS = 1 << 12
CYCLE = -1


def latest_nodes(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", order_col: str = "created_at", tree_col: str | None = None) -> DataFrame:
    """(id, parent, loc) with one row per id: the one with the latest order_col, ties going to the larger parent. Null ids are dropped.
    Without a column order_col all rows tie.

    loc is the hash of tree_col (0 without one); rows with near loc and id end up in one fragment, nothing else depends on it.
    """
    loc = F.xxhash64(F.col(tree_col)) if tree_col else F.lit(0).cast("long")
    order = F.col(order_col) if order_col in nodes.columns else F.lit(0)
    rank = F.struct(order.alias("at"), F.col(parent_col).cast("long").alias("parent"), loc.alias("loc"))
    best = nodes.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(rank).alias("r"))
    return best.select("id", "r.parent", "r.loc")


def _chains(ids: np.ndarray, parent: np.ndarray, has_parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node the index of the top of its chain inside these rows, the summed weight up to it, whether it never ends, and the local parent (own index if none)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], parent)
    local = order[np.minimum(at, n - 1)]
    inside = has_parent & (at < n) & (ids[local] == parent)
    first = np.where(inside, local, np.arange(n))
    top, dist = first.copy(), np.where(inside, weight, 0)
    for _ in range(max(1, n).bit_length() + 1):
        dist = dist + dist[top]
        top = top[top]
    return top, dist, inside[top], first


def _fragments(q: DataFrame, parts: int, with_paths: bool) -> DataFrame:
    """Each row of q (id, parent, w, loc[, seg]) with its chain inside its partition: top, out (parent of the top), w_out, dist, cyclic[, chain, seg_out]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        pdf = pd.concat(rows, ignore_index=True)
        ids, has, parent = pdf["id"].to_numpy(np.int64), pdf["has"].to_numpy(bool), pdf["parent"].to_numpy(np.int64)
        weight = pdf["w"].to_numpy(np.int64)
        top, dist, cyclic, first = _chains(ids, parent, has, weight)
        dist = np.where(cyclic, 0, dist)
        out = pd.DataFrame({"id": ids, "loc": pdf["loc"], "top": ids[top], "out": pd.array(parent, dtype="Int64").take(top), "w_out": weight[top], "dist": dist, "cyclic": cyclic})
        out.loc[~has[top], "out"] = pd.NA
        if with_paths:
            seg = [[] if s is None else list(s) for s in pdf["seg"]]
            chain: list[list[int]] = [[] for _ in ids]
            for i in np.argsort(dist, kind="stable"):
                if not cyclic[i] and first[i] != i:
                    chain[i] = seg[i] + chain[first[i]]
            out["chain"], out["seg_out"] = chain, [seg[t] for t in top]
        for lo in range(0, len(out), 20_000):
            yield out.iloc[lo : lo + 20_000]

    schema = "id long, loc long, top long, out long, w_out long, dist long, cyclic boolean" + ", chain array<long>, seg_out array<long>" * with_paths
    # a column of nulls and numbers would reach numpy as floats, which do not hold every id
    q = q.withColumn("has", F.col("parent").isNotNull()).withColumn("parent", F.coalesce("parent", F.lit(0).cast("long")))
    spread = q.repartition(1) if parts == 1 else q.repartitionByRange(parts, "loc", "id")
    return spread.mapInPandas(run, schema)


def solve(q: DataFrame, rows: int, with_paths: bool, level: int = 0) -> DataFrame:
    """(id, root, depth[, above]) of q, in which every parent is null or an id of q; above lists the ids over id, nearest first."""
    n = q.count()
    parts = partitions_for(n, rows)
    frag = checkpointed(_fragments(q, parts, with_paths))
    none = F.array().cast("array<long>")
    if parts == 1:
        return frag.select("id", F.when(F.col("cyclic"), CYCLE).otherwise(F.col("top")).alias("root"), F.when(~F.col("cyclic"), F.col("dist")).alias("depth"), *([F.col("chain").alias("above")] if with_paths else []))
    tops = frag.filter("id = top and not cyclic").select("id", "loc", "out", "w_out", *(["seg_out"] if with_paths else []))
    entry = frag.select(F.col("id").alias("e_id"), F.col("top").alias("e_top"), F.col("dist").alias("e_dist"), F.col("cyclic").alias("e_cyclic"), *([F.col("chain").alias("e_chain")] if with_paths else []))
    edge = skew_join(tops, entry, "out", "e_id", "id")
    parent = F.when(F.col("e_cyclic"), F.col("id")).otherwise(F.col("e_top"))
    quotient = edge.select("id", "loc", parent.alias("parent"), (F.col("w_out") + F.coalesce("e_dist", F.lit(0))).alias("w"), *([F.when(F.col("e_id").isNotNull(), F.concat("seg_out", F.coalesce("e_chain", none))).otherwise(none).alias("seg")] if with_paths else []))
    quotient = checkpointed(quotient)
    left = quotient.count()
    further = _doubled(quotient, left, with_paths) if left > 0.7 * n else solve(quotient, rows, with_paths, level + 1)
    solved = further.withColumnRenamed("id", "s_id").withColumnRenamed("depth", "s_depth")
    if with_paths:
        solved = solved.withColumnRenamed("above", "s_above")
    out = frag.join(solved, F.col("top") == F.col("s_id"), "left")
    cyclic = F.col("cyclic") | (F.col("root") == CYCLE)
    return out.select("id", F.when(cyclic, CYCLE).otherwise(F.col("root")).alias("root"), F.when(~cyclic, F.col("dist") + F.col("s_depth")).alias("depth"), *([F.when(cyclic, none).otherwise(F.concat("chain", "s_above")).alias("above")] if with_paths else []))


def _doubled(q: DataFrame, n: int, with_paths: bool) -> DataFrame:
    """As solve, by joins: each round takes every open node twice as far up. What is open after the logarithm of n rounds runs in a circle; it is left out before paths are joined up."""
    none = F.array().cast("array<long>")
    root = F.col("parent").isNull()
    first = [F.col("id"), F.when(root, F.col("id")).otherwise(F.col("parent")).alias("up"), F.when(root, 0).otherwise(F.col("w")).alias("dist"), root.alias("done")]

    def climbed(cur: DataFrame, paths: bool) -> DataFrame:
        cur = checkpointed(cur)
        for _ in range(max(n, 2).bit_length() + 1):
            open_ = cur.filter(~F.col("done"))
            if open_.isEmpty():
                break
            over = cur.select(F.col("id").alias("o_id"), F.col("up").alias("o_up"), F.col("dist").alias("o_dist"), F.col("done").alias("o_done"), *([F.col("above").alias("o_above")] if paths else []))
            moved = open_.join(over, F.col("up") == F.col("o_id")).select("id", F.col("o_up").alias("up"), (F.col("dist") + F.col("o_dist")).alias("dist"), F.col("o_done").alias("done"), *([F.concat("above", "o_above").alias("above")] if paths else []))
            cur = checkpointed(cur.filter("done").unionByName(moved))
        return cur

    plain = climbed(q.select(*first), False)
    ended = plain.filter("done")
    if with_paths:
        tree = q.join(ended.select("id"), "id", "left_semi")
        ended = climbed(tree.select(*first, F.when(root, none).otherwise(F.col("seg")).alias("above")), True)
    paths = [F.col("above")] if with_paths else []
    out = ended.select("id", F.col("up").alias("root"), F.col("dist").alias("depth"), *paths)
    circles = plain.filter(~F.col("done")).select("id", F.lit(CYCLE).cast("long").alias("root"), F.lit(None).cast("long").alias("depth"), *([none.alias("above")] if with_paths else []))
    return out.unionByName(circles)


def hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", order_col: str = "created_at", tree_col: str | None = None, with_paths: bool = False, fragment_rows: int | None = None) -> DataFrame:
    """(id, root_id, depth[, path]) of every id.

    root_id is the last node reached by following parents, whose parent is null or missing; the node itself if that holds for it. Nodes
    whose chain runs into a circle (self-links included) get root_id -1, null depth and an empty path. depth is 0 at a root; path lists
    the ids from the root to the node. Of several rows of one id the latest order_col holds, null order_col being earliest; null ids are
    dropped; an empty table gives an empty result; all other columns are ignored, whatever their names.
    """
    base = checkpointed(latest_nodes(nodes, id_col, parent_col, order_col, tree_col))
    known = base.select(F.col("id").alias("k"))
    linked = skew_join(base, known, "parent", "k", "id")
    q = linked.select("id", "loc", F.col("k").alias("parent"), F.lit(1).cast("long").alias("w"), *([F.when(F.col("k").isNotNull(), F.array("k")).otherwise(F.array().cast("array<long>")).alias("seg")] if with_paths else []))
    rows = fragment_rows or (FRAGMENT_ROWS_PATHS if with_paths else FRAGMENT_ROWS)
    done = solve(checkpointed(q), rows, with_paths)
    path = F.when(F.col("root") == CYCLE, F.array().cast("array<long>")).otherwise(F.reverse(F.concat(F.array("id"), F.col("above")))) if with_paths else None
    return done.select("id", F.col("root").alias("root_id"), F.col("depth").cast("long").alias("depth"), *([path.alias("path")] if with_paths else []))


def descendants(paths: DataFrame) -> DataFrame:
    """(id, descendant_id, distance) from hierarchy(with_paths=True): one row for each proper ancestor of each node; nodes in or under circles have none."""
    pairs = paths.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("pos", "id"))
    return pairs.filter("id <> descendant_id").select("id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(paths: DataFrame) -> DataFrame:
    """(id, n_descendants) of every node, 0 for leaves and for nodes in circles; summed map-side before the shuffle."""
    below = descendants(paths).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return paths.select("id").join(below, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_descendants"))
