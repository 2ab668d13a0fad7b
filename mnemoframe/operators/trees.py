"""Entity trees: structure, debt, routing, splitting and centroids.

What is arithmetic on nodes is expressed on columns; the stateful walk of one entity's tree runs as one grouped Arrow call.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import vectors as V
from mnemoframe.operators import search as S
from mnemoframe.operators.hierarchy import hierarchy
from mnemoframe.runtime import checkpointed, hot_keys, over_groups, skew_join

#: Weights and limits of the structure rules.
UNCERTAINTY_STEP, WIDTH_WEIGHT, DEPTH_WEIGHT, DEBT_LIMIT, AUDITS, MOST_CHILDREN = 1.0, 3.0, 5.0, 10.0, 5, 15


def most_depth(n: Column) -> Column:
    """Depth that a tree of n facts may have, rounded half to even."""
    return F.bround(2 + 1.3 * F.ln(n.cast("double")), 0).cast("int")


def least_support(depth: Column) -> Column:
    """Support that a node of the depth should have; values within a tenth of a whole number are that number, others go up. A double: from depth 30 on it is beyond an int."""
    x = F.exp((depth - 2) / 1.3)
    return F.when(F.abs(x - F.round(x)) <= 0.1, F.round(x)).otherwise(F.ceil(x)).cast("double")


def structural_debt(uncertainty: Column, width: Column, support: Column, depth: Column, limit: Column) -> Column:
    wide = F.greatest(F.lit(0.0), width - (3 + 1.5 * F.log2(1 + support)))
    return uncertainty + WIDTH_WEIGHT * wide + DEPTH_WEIGHT * F.greatest(F.lit(0), depth - limit)


def placed_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with root_id, depth and width (number of children); nodes in circles have no depth."""
    h = hierarchy(nodes, tree_col="entity_id").withColumnRenamed("id", "h_id")
    width = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("w_id")).agg(F.count(F.lit(1)).alias("width"))
    out = nodes.join(h, F.col("id") == F.col("h_id"), "left").join(width, F.col("id") == F.col("w_id"), "left")
    return out.withColumn("width", F.coalesce("width", F.lit(0))).drop("h_id", "w_id")


def with_debt(nodes: DataFrame) -> DataFrame:
    """(id, entity_id, debt) of nodes that have children and a depth; the allowed depth follows the node's own support, without any there is no limit."""
    placed = placed_nodes(nodes)
    support = F.greatest(F.coalesce("support", F.lit(0)), F.lit(0))
    limit = F.when(support > 0, most_depth(F.greatest(support, F.lit(1)))).otherwise(999)
    debt = structural_debt(F.coalesce("uncertainty_score", F.lit(0.0)), F.col("width"), support, F.col("depth"), limit)
    return placed.filter("width > 0 and depth is not null").select("id", "entity_id", F.round(debt, 6).alias("debt"))


def audit_candidates(debts: DataFrame, k: int = AUDITS, least: float = DEBT_LIMIT) -> DataFrame:
    """Of each entity the k nodes with the most debt, if it reaches the limit."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("debt"), "id")
    return debts.filter(F.col("debt") >= least).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def child_score(description: Column, centroid: Column) -> Column:
    """Half of each similarity if neither is negative, else the larger."""
    return F.when((description >= 0) & (centroid >= 0), 0.5 * description + 0.5 * centroid).otherwise(F.greatest(description, centroid))


def supports(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, support): the leaves under each node, itself included if it is one; paths from hierarchy(with_paths=True)."""
    parents = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    leaves = paths.join(parents, "id", "left_anti")
    return leaves.select(F.explode("path").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("support"))


def split_groups(nodes: DataFrame, most: int = MOST_CHILDREN) -> DataFrame:
    """(parent_id, id, part): children of parents with more than `most`, dealt in order to equal parts of at most so many."""
    w = Window.partitionBy("parent_id").orderBy("id")
    n = F.count(F.lit(1)).over(Window.partitionBy("parent_id"))
    own = nodes.filter("parent_id is not null").select("parent_id", "id").withColumn("_n", n).withColumn("_r", F.row_number().over(w)).filter(F.col("_n") > most)
    size = F.ceil(F.col("_n") / F.ceil(F.col("_n") / F.lit(most)))
    return own.select("parent_id", "id", F.floor((F.col("_r") - 1) / size).cast("int").alias("part"))


def is_flat(nodes: DataFrame) -> DataFrame:
    """(id, flat) of nodes with children: all of them are leaves without children."""
    parents = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("p")).distinct()
    kids = nodes.join(parents, F.col("id") == F.col("p"), "left")
    return kids.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.min(F.col("p").isNull()).alias("flat"))


def dissolvable(nodes: DataFrame) -> DataFrame:
    """(id): aspects (nodes under another one, without a fact) with at most one child, or in a thin chain: below the support that their depth
    should have, as is their parent, which is no root. Nodes in circles have no depth and stay."""
    placed = placed_nodes(nodes).select("id", "parent_id", "fact_id", F.coalesce("support", F.lit(0)).alias("support"), "depth", "width")
    over = placed.select(F.col("id").alias("p_id"), F.col("support").alias("p_support"), F.col("depth").alias("p_depth"))
    own = placed.filter("fact_id is null and depth > 0").join(over, F.col("parent_id") == F.col("p_id"))
    thin = (F.col("p_depth") > 0) & (F.col("support") < least_support(F.col("depth"))) & (F.col("p_support") < least_support(F.col("p_depth")))
    return own.filter((F.col("width") <= 1) | thin).select("id")


#: Nodes of a tree that one task dissolves to the end: five numbers each. Larger trees take a round of joins at a time.
TREE_CAP = 1 << 17


def _dissolved_at_once(trees: pd.DataFrame) -> pd.DataFrame:
    """(g, to) of whole trees (id, parent, a root its own; aspect, support): each node that goes, and the nearest node above it that stays when no more go."""
    ids, aspect, support = trees["id"].to_numpy(np.int64), trees["aspect"].to_numpy(bool), trees["support"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    over = order[np.searchsorted(ids[order], trees["parent"].to_numpy(np.int64))]
    here = np.arange(len(ids))
    below, stays = over != here, np.ones(len(ids), bool)
    while True:
        depth, top = below.astype(np.int64), over
        while (more := depth[top]).any():
            depth, top = depth + more, top[top]
        width = np.bincount(over[below & stays], minlength=len(ids))
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.exp((depth - 2) / 1.3)
            low = support < np.where(np.abs(x - np.round(x)) <= 0.1, np.round(x), np.ceil(x))
        goes = stays & aspect & below & ((width <= 1) | ((depth[over] > 0) & low & low[over]))
        if not goes.any():
            return pd.DataFrame({"g": ids[~stays], "to": ids[over[~stays]]})
        stands = np.where(goes, over, here)
        while ((further := stands[stands]) != stands).any():
            stands = further
        over, stays = stands[over], stays & ~goes


def _climbed(up: DataFrame) -> DataFrame:
    """up (g, to), a node that goes and one above it, with the nearest above that is no g in place of to, by doubling."""
    while True:
        further = up.select(F.col("g").alias("to"), F.col("to").alias("over"))
        moved = checkpointed(up.join(further, "to", "left").select("g", F.coalesce("over", "to").alias("to"), F.col("over").isNotNull().alias("moved")))
        up = moved.select("g", "to")
        if moved.filter("moved").isEmpty():
            return up


def _dissolved_by_rounds(cur: DataFrame) -> DataFrame:
    """(g, to) as _dissolved_at_once, of trees (id, entity_id, parent_id, fact_id, support) of any size."""
    columns, every = cur.columns, None
    while True:
        gone = checkpointed(dissolvable(cur))
        if gone.isEmpty():
            return _climbed(every) if every is not None else gone.select(F.col("id").alias("g"), F.col("id").alias("to"))
        up = _climbed(cur.join(gone, "id", "left_semi").select(F.col("id").alias("g"), F.col("parent_id").alias("to")))
        every = up if every is None else checkpointed(every.unionByName(up))
        kept = skew_join(cur.join(gone, "id", "left_anti"), up, "parent_id", "g", "id")
        cur = checkpointed(kept.withColumn("parent_id", F.coalesce("to", "parent_id")).select(*columns))


def dissolved(nodes: DataFrame, cap: int = TREE_CAP) -> DataFrame:
    """nodes without all aspects that dissolve, round after round until none is left; their children hang on the nearest node above that stays.

    A tree dissolves by itself, so trees of up to cap nodes are each dissolved to the end in one sorted pass; nodes in circles stay.
    """
    cur = checkpointed(nodes)
    own = cur.select("id", "entity_id", "parent_id", "fact_id", F.coalesce("support", F.lit(0)).alias("support"))
    place = hierarchy(own, tree_col="entity_id").filter("depth is not null").withColumnRenamed("id", "h_id")
    placed = checkpointed(own.join(place.hint("merge"), F.col("id") == F.col("h_id")).drop("h_id"))
    large = checkpointed(hot_keys(placed, "root_id", cap).select("root_id"))
    some = not large.isEmpty()
    small = placed.join(large, "root_id", "left_anti") if some else placed
    trees = small.select("root_id", "id", F.when(F.col("depth") == 0, F.col("id")).otherwise(F.col("parent_id")).alias("parent"), F.col("fact_id").isNull().alias("aspect"), "support")
    up = over_groups(trees, "root_id", _dissolved_at_once, "g long, to long")
    if some:
        up = up.unionByName(_dissolved_by_rounds(checkpointed(placed.join(large, "root_id", "left_semi").select(*own.columns))))
    up = checkpointed(up)
    hung = skew_join(cur, up.hint("merge"), "parent_id", "g", "id").withColumn("parent_id", F.coalesce("to", "parent_id")).select(*nodes.columns)
    return hung.join(up.select(F.col("g").alias("id")).hint("merge"), "id", "left_anti")


def attached(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """nodes (id, parent_id, fact_id, support, ...) after new facts (node_id, fact_id, leaf_id) are hung on them: a leaf each with support 1, and the
    support of every node over it raised by the leaves that it gets. Columns that a leaf does not have are null."""
    paths = hierarchy(nodes.withColumn("created_at", F.lit(0)), tree_col=None, with_paths=True).filter("root_id <> -1").select(F.col("id").alias("node_id"), "path")
    more = placed.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).join(paths, "node_id").select(F.explode("path").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("_n"))
    kinds = dict(nodes.dtypes)
    old = nodes.join(more, "id", "left").withColumn("support", (F.coalesce("support", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast(kinds["support"])).drop("_n")
    filled = {"id": F.col("leaf_id"), "parent_id": F.col("node_id"), "fact_id": F.col("fact_id"), "support": F.lit(1), "node_type": F.lit("leaf")}
    leaves = placed.select(*[filled.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in nodes.columns])
    return old.select(*nodes.columns).unionByName(leaves)


def reparented(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """nodes after moves (id, new_parent), applied together. Moves to a missing node, to a node below (or the node itself), to a leaf, and of a root are left
    out; old and new parent get a step of uncertainty for each move, and supports are counted anew from the leaves."""
    paths = checkpointed(hierarchy(nodes.withColumn("created_at", F.lit(0)), with_paths=True).select("id", "path", "root_id"))
    target = nodes.filter("fact_id is null").select(F.col("id").alias("new_parent"))
    asked = moves.groupBy("id").agg(F.min("new_parent").alias("new_parent")).join(target, "new_parent")
    ok = asked.join(nodes.filter("parent_id is not null").select("id", F.col("parent_id").alias("old_parent")), "id").join(paths.select(F.col("id").alias("new_parent"), F.col("path").alias("over")), "new_parent").filter(~F.array_contains("over", F.col("id")) & (F.col("new_parent") != F.col("old_parent")))
    ok = checkpointed(ok.select("id", "old_parent", "new_parent"))
    steps = ok.select(F.explode(F.array("old_parent", "new_parent")).alias("id")).groupBy("id").agg((F.count(F.lit(1)) * UNCERTAINTY_STEP).alias("_u"))
    moved = nodes.join(ok.select("id", "new_parent"), "id", "left").join(steps, "id", "left").withColumn("parent_id", F.coalesce("new_parent", "parent_id"))
    moved = checkpointed(moved.withColumn("uncertainty_score", F.coalesce("uncertainty_score", F.lit(0.0)) + F.coalesce("_u", F.lit(0.0))).select(*nodes.columns))
    new = hierarchy(moved.withColumn("created_at", F.lit(0)), with_paths=True)
    # two moves may each be sound and together run in a circle: then none of the tree's moves is done
    circles = new.filter("root_id = -1").limit(1).count()
    if circles:
        bad = new.filter("root_id = -1").select("id").join(ok.select("id"), "id", "left_semi")
        return reparented(nodes, moves.join(bad, "id", "left_anti"))
    counted = supports(moved, new)
    kind = dict(nodes.dtypes)["support"]
    return moved.join(counted.withColumnRenamed("support", "_s"), "id", "left").withColumn("support", F.coalesce("_s", "support").cast(kind)).select(*nodes.columns)


def grouped(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """nodes with a new aspect (group_id, parent_id, description) for each row of groups (group_id, parent_id, description, members), under which those members hang that are children of the parent.

    A group of fewer than two such children, or of all of them, is left out."""
    kids = nodes.filter("parent_id is not null").select(F.col("id").alias("m"), F.col("parent_id").alias("m_parent"))
    n = kids.groupBy(F.col("m_parent").alias("n_parent")).agg(F.count(F.lit(1)).alias("n"))
    own = groups.select("group_id", "parent_id", "description", F.explode(F.array_distinct("members")).alias("m")).join(kids, "m").filter("parent_id = m_parent")
    first = own.groupBy("m").agg(F.min("group_id").alias("group_id"))  # a child goes to one group
    own = own.join(first, ["m", "group_id"])
    size = own.groupBy("group_id", "parent_id", "description").agg(F.count(F.lit(1)).alias("k")).join(n, F.col("parent_id") == F.col("n_parent")).filter("k >= 2 and k < n")
    size = checkpointed(size.select("group_id", "parent_id", "description", "k"))
    hung = own.join(size.select("group_id"), "group_id", "left_semi").select(F.col("m").alias("id"), "group_id")
    entity = nodes.select(F.col("id").alias("parent_id"), *[F.col(c) for c in ("task_id", "entity_id") if c in nodes.columns])
    kinds = dict(nodes.dtypes)
    aspects = size.join(entity, "parent_id").withColumns({"id": F.col("group_id"), "node_type": F.lit("aspect"), "support": F.lit(0), "uncertainty_score": F.lit(0.0)})
    aspects = aspects.select(*[(F.col(c) if c in aspects.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in nodes.columns])
    moved = nodes.join(hung, "id", "left").withColumn("parent_id", F.coalesce("group_id", "parent_id")).select(*nodes.columns)
    every = checkpointed(moved.unionByName(aspects))
    counted = supports(every, hierarchy(every.withColumn("created_at", F.lit(0)), with_paths=True).filter("root_id <> -1"))
    return every.join(counted.withColumnRenamed("support", "_s"), "id", "left").withColumn("support", F.coalesce("_s", "support").cast(kinds["support"])).select(*nodes.columns)


def aspect_paths(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, aspect_path, leaf_key, mid_key) of every node with a fact: the descriptions over it, `grandparent > parent`, a root's giving nothing."""
    p = nodes.select(F.col("id").alias("p_id"), F.col("parent_id").alias("p_parent"), F.col("description").alias("p_desc"))
    g = nodes.select(F.col("id").alias("g_id"), F.col("parent_id").alias("g_parent"), F.col("description").alias("g_desc"))
    e = entities.select("task_id", "entity_id", F.col("canonical_ref").alias("ref")).groupBy("task_id", "entity_id").agg(F.min("ref").alias("ref"))
    j = nodes.filter("fact_id is not null").select("id", "task_id", "entity_id", "parent_id").join(p, F.col("parent_id") == F.col("p_id"), "left").join(g, F.col("p_parent") == F.col("g_id"), "left").join(e, ["task_id", "entity_id"], "left")
    leaf = F.when(F.col("p_parent").isNotNull(), F.coalesce("p_desc", F.lit("")))
    mid = F.when(F.col("g_parent").isNotNull(), F.coalesce("g_desc", F.lit("")))
    path = F.when(mid.isNotNull() & leaf.isNotNull(), F.concat(mid, F.lit(" > "), leaf)).when(leaf.isNotNull(), leaf).otherwise("")
    ref = F.coalesce("ref", F.lit(""))
    return j.select("id", path.alias("aspect_path"), F.when(leaf.isNotNull(), F.concat(ref, F.lit("::"), leaf)).alias("leaf_key"), F.when(mid.isNotNull(), F.concat(ref, F.lit("::"), mid)).alias("mid_key"))


def route(tree: pd.DataFrame, vector: np.ndarray) -> int:
    """Id of the node a fact hangs on: down from the root to the best child while it scores strictly more than the node's description, stopping over a leaf.

    tree has id, parent_id, vec (of the description, of a leaf its fact's), leaf and maybe centroid; an inner child scores the mean of both similarities
    unless one is negative or missing, then the larger. Ties go to the smaller id. -1 without a root.
    """

    def sim(v: np.ndarray | None) -> float:
        if v is None or not len(v):
            return -1.0
        n = float(np.linalg.norm(v) * np.linalg.norm(vector))
        return float(np.dot(v, vector) / n) if n else 0.0

    kids: dict[int, list[int]] = {}
    row = {}
    for i, (key, parent) in enumerate(zip(tree["id"], tree["parent_id"])):
        row[key] = i
        if not pd.isna(parent):
            kids.setdefault(int(parent), []).append(int(key))
    roots = [int(k) for k, p in zip(tree["id"], tree["parent_id"]) if pd.isna(p) or int(p) not in row]
    if not roots:
        return -1
    own = {k: sim(tree["vec"].iloc[i]) for k, i in row.items()}
    centre = {k: sim(tree["centroid"].iloc[i]) if "centroid" in tree else -1.0 for k, i in row.items()}
    leaf = {k: bool(tree["leaf"].iloc[i]) for k, i in row.items()}
    score = {k: own[k] if leaf[k] else (own[k] + centre[k]) / 2 if own[k] >= 0 and centre[k] >= 0 else max(own[k], centre[k]) for k in row}
    at, seen = min(roots), set()
    while at not in seen:
        seen.add(at)
        best = max(sorted(kids.get(at, [])), key=score.__getitem__, default=None)
        if best is None or score[best] <= own[at] or leaf[best]:
            break
        at = best
    return at


def routed(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """(entity_id, fact_id, node_id): each new fact (entity_id, fact_id, vec) on the tree as it was; nodes has entity_id, id, parent_id, vec, leaf."""

    def run(tree: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        rows = [(e, f, route(tree, np.asarray(v, float))) for e, f, v in zip(new["entity_id"], new["fact_id"], new["vec"])] if len(tree) else []
        return pd.DataFrame(rows, columns=["entity_id", "fact_id", "node_id"])

    return nodes.groupBy("entity_id").cogroup(facts.groupBy("entity_id")).applyInPandas(run, "entity_id string, fact_id long, node_id long")


def beam(nodes: DataFrame, scores: DataFrame, width: int = 3) -> DataFrame:
    """(root_id, fact_id): from every root the `width` best children of each node, level by level; leaves in the beam give their facts.

    scores is (id, score); a node without one scores 0, ties go to the smaller id. Children are ranked once, before the walk,
    which ends at the last level: from a root no circle can be met.
    """
    w = Window.partitionBy("parent_id").orderBy(F.desc("score"), "id")
    kids = nodes.filter("parent_id is not null").join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = kids.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= width).select(F.col("parent_id").alias("p"), "id", "fact_id")
    known = nodes.select(F.col("id").alias("k"))
    best = checkpointed(best)
    level = nodes.join(known, F.col("parent_id") == F.col("k"), "left").filter("k is null").select(F.col("id").alias("root_id"), F.col("id").alias("at"))
    found, depth = None, 0
    while True:
        level = checkpointed(level.join(best, F.col("at") == F.col("p")).select("root_id", F.col("id").alias("at"), "fact_id"))
        hit = level.filter("fact_id is not null").select("root_id", "fact_id")
        found = hit if found is None else found.unionByName(hit)
        level = level.filter("fact_id is null").select("root_id", "at")
        if level.isEmpty():
            break
        depth += 1
        if depth % 16 == 0:  # else the plan grows with the depth
            found = checkpointed(found)
    return found.distinct()


def tree_facts(nodes: DataFrame, facts: DataFrame, entities: DataFrame, named: DataFrame, vec: list[float], top_n: int = 5, width: int = 3, limit: int = 20) -> DataFrame:
    """(id, score): path of the trees. The entities that are named (entity_id, score) or whose descriptions (desc_embedding) are nearest to vec give their trees, a beam of
    width goes down each by likeness to vec (a node is as like as its description_embedding, if it has one, a leaf else as its fact's vector, others 0), and the
    facts found are ranked by inner product."""
    q = F.array(*[F.lit(float(x)) for x in vec])
    w = Window.orderBy(F.desc("score"), "id")
    by_alias = named.groupBy(F.col("entity_id").alias("id")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(2 * top_n).withColumn("rank", F.row_number().over(w))
    of_vectors = entities.filter(V.is_vector(F.col("desc_embedding"), len(vec))).select(F.col("entity_id").alias("id"), F.round(V.cosine(F.col("desc_embedding"), q), 6).alias("score"))
    by_vector = of_vectors.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(2 * top_n)
    chosen = S.matched_entities(by_alias, by_vector, top_n).select("entity_id")
    own = checkpointed(nodes.join(F.broadcast(chosen), "entity_id", "left_semi"))  # at most top_n entities
    ok = facts.filter(V.is_vector(F.col("text_embedding"), len(vec))).select(F.col("id").alias("f_id"), "text_embedding")
    known = own.join(ok, F.col("fact_id") == F.col("f_id"), "left")
    like = F.col("text_embedding")
    if "description_embedding" in own.columns:
        like = F.coalesce("description_embedding", like)
    scores = known.select("id", F.round(F.when(like.isNotNull(), V.cosine(like, q)).otherwise(0.0), 6).alias("score"))
    found = beam(own, scores, width).select(F.col("fact_id").alias("id")).distinct()
    return found.join(ok, F.col("id") == F.col("f_id")).select("id", F.round(V.inner_product(F.col("text_embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def valid_groups(groups: list[dict], children: list[int]) -> list[dict]:
    """groups (label, members) of a node's children as they are; an unknown or repeated member, a group of fewer than two, or one without a label is an error."""
    seen: set[int] = set()
    for g in groups:
        members = g.get("members") or []
        if not (g.get("label") or "").strip() or len(members) < 2 or len(set(members)) < len(members):
            raise ValueError(f"a group needs a label and two different members: {g}")
        if not set(members) <= set(children) or seen & set(members):
            raise ValueError(f"unknown members, or members of two groups: {g}")
        seen |= set(members)
    return groups


def valid_moves(moves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, new_parent) of moves (id, action, target): 'PROMOTE' hangs a node on its grandparent, 'RELOCATE' on the target, a sibling of its parent. Roots, nodes right
    under a root (PROMOTE), and targets that are no sibling are left out; a node with two moves is an error."""
    if moves.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("a node with two moves")
    own = nodes.select("id", "parent_id")
    p = nodes.select(F.col("id").alias("p"), F.col("parent_id").alias("over"))
    t = nodes.select(F.col("id").alias("target"), F.col("parent_id").alias("t_over"))
    placed = moves.join(own, "id").join(p, F.col("parent_id") == F.col("p")).join(t, "target", "left")
    sibling = (F.col("t_over") == F.col("over")) & (F.col("target") != F.col("parent_id"))
    to = F.when(F.col("action") == "PROMOTE", F.col("over")).when((F.col("action") == "RELOCATE") & sibling, F.col("target"))
    return placed.select("id", to.alias("new_parent")).filter("new_parent is not null")


#: Fixed value: under so many children a node is merged with its groups' parent instead of being wrapped.
WRAP_FROM = 8


def audited_down(nodes: DataFrame, group, first_id: int) -> DataFrame:
    """nodes after the children of each entity's most indebted nodes are grouped by a hook: group(ids, descriptions) gives (label, members) dicts.

    A node with fewer than WRAP_FROM children first takes the children of its aspects over (they are flattened); wrapped groups become aspects with
    ids from first_id on. An invalid answer leaves its node as it is. One row for each child of a candidate goes through Arrow.
    """
    candidates = checkpointed(audit_candidates(with_debt(nodes)).select("id"))
    width = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    narrow = candidates.join(width, "id").filter(F.col("n") < WRAP_FROM).select("id")
    aspects = nodes.filter("fact_id is null").join(narrow.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select(F.col("id").alias("g"), F.col("parent_id").alias("to"))
    aspects = checkpointed(aspects.join(candidates.select(F.col("id").alias("g")), "g", "left_anti"))
    flat = nodes.join(aspects.select(F.col("g").alias("id")), "id", "left_anti").join(aspects, F.col("parent_id") == F.col("g"), "left")
    flat = checkpointed(flat.withColumn("parent_id", F.coalesce("to", "parent_id")).select(*nodes.columns))
    kids = flat.join(candidates.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("id", "description"))).alias("k"))

    def run(batches):
        for batch in batches:
            rows = []
            for parent, k in zip(batch["parent_id"], batch["k"]):
                ids = [int(x["id"]) for x in k]
                try:
                    rows += [(int(parent), g["label"], sorted(g["members"])) for g in valid_groups(group(ids, [x["description"] for x in k]), ids)]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["parent_id", "description", "members"])

    found = checkpointed(kids.mapInPandas(run, "parent_id long, description string, members array<long>"))
    w = Window.orderBy("parent_id", F.col("members")[0])  # one row a group of the few audited nodes
    return grouped(flat, found.withColumn("group_id", (F.row_number().over(w) + first_id - 1).cast("long")))


def propagated(nodes: DataFrame, summarise, changed: DataFrame, least_fresh: int = 3) -> DataFrame:
    """nodes after the descriptions over changed ones (id) are made anew, deepest first: summarise(descriptions of the children) gives a node's own.

    A change goes on to the parent only if that has had least_fresh changes since its last summary, this one included; fresh_count counts them and
    starts again at 0. Each level is one pass over the nodes of that depth.
    """
    cur = checkpointed(nodes.withColumn("fresh_count", F.coalesce("fresh_count", F.lit(0)).cast("int")))
    depth = checkpointed(hierarchy(nodes.withColumn("created_at", F.lit(0))).filter("root_id <> -1").select(F.col("id").alias("d_id"), "depth"))
    inner = cur.filter("fact_id is null").select("id")
    dirty = checkpointed(changed.select("id").distinct().join(inner, "id").join(depth, F.col("id") == F.col("d_id")).select("id", "depth"))
    kinds = dict(cur.dtypes)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"n_id": batch["n_id"], "new": [summarise([t for t in k if t]) for k in batch["k"]]})

    while (deepest := dirty.agg(F.max("depth")).first()[0]) is not None:
        now = dirty.filter(F.col("depth") == deepest).select(F.col("id").alias("n_id"))
        kids = cur.join(now, F.col("parent_id") == F.col("n_id")).groupBy("n_id").agg(F.array_sort(F.collect_list(F.struct("id", "description"))).alias("k")).withColumn("k", F.transform("k", lambda x: x["description"]))
        said = checkpointed(kids.mapInPandas(run, "n_id long, new string"))
        up = cur.join(said, F.col("id") == F.col("n_id")).filter("parent_id is not null").groupBy(F.col("parent_id").alias("u_id")).agg(F.count(F.lit(1)).alias("u_n"))
        fresh = F.when(F.col("n_id").isNotNull(), 0).otherwise(F.col("fresh_count") + F.coalesce("u_n", F.lit(0)))
        cur = checkpointed(cur.join(said, F.col("id") == F.col("n_id"), "left").join(up, F.col("id") == F.col("u_id"), "left").withColumns({"description": F.coalesce("new", "description"), "fresh_count": fresh.cast(kinds["fresh_count"])}).select(*nodes.columns))
        further = cur.join(up, F.col("id") == F.col("u_id"), "left_semi").filter(F.col("fresh_count") >= least_fresh).join(depth, F.col("id") == F.col("d_id")).select("id", "depth")
        dirty = checkpointed(dirty.filter(F.col("depth") < deepest).unionByName(further).distinct())
    return cur


def updated(nodes: DataFrame, placed: DataFrame, group, summarise, first_id: int) -> DataFrame:
    """The whole round on trees: new facts (node_id, fact_id, leaf_id) are attached, indebted nodes audited, thin aspects dissolved, and descriptions made anew up from the nodes that got facts."""
    grown = checkpointed(attached(nodes, placed))
    kept = dissolved(audited_down(grown, group, first_id))
    parents = placed.select(F.col("leaf_id").alias("l")).join(kept.select(F.col("id").alias("l"), "parent_id"), "l").select(F.col("parent_id").alias("id"))
    return propagated(kept, summarise, parents)
