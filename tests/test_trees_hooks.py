"""Tree updates, model hooks, stored indexes, reuse by identity: on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemoframe import hooks as H
from mnemoframe.functions import text as X
from mnemoframe.operators import memory as M
from mnemoframe.operators import resolution as E
from mnemoframe.operators import search as S
from mnemoframe.operators import trees as G

NODES = "id long, task_id int, entity_id string, parent_id long, node_type string, fact_id long, description string, uncertainty_score double, support int, fresh_count int"


def tree(spark, rows):
    """rows of (id, parent_id, fact_id, support)."""
    return spark.createDataFrame([(i, 1, "e", p, "leaf" if f else "aspect", f, f"d{i}", 0.0, s, 0) for i, p, f, s in rows], NODES)


def links(df):
    return {r.id: r.parent_id for r in df.collect()}


def test_dissolving_goes_on_until_nothing_is_thin(spark):
    # 2 holds 3 only, 3 holds 4 only: all three go and the leaves of 4 hang on the root; 9 has no child
    nodes = tree(spark, [(1, None, None, 40), (2, 1, None, 40), (3, 2, None, 40), (4, 3, None, 40), (9, 1, None, 0), (5, 1, 50, 1), *[(10 + k, 4, 100 + k, 1) for k in range(3)], (6, 4, None, 1), (7, 6, 70, 1)])
    assert {r.id for r in G.dissolvable(nodes).collect()} == {2, 3, 6, 9}
    assert links(G.dissolved(nodes)) == {1: None, 4: 1, 5: 1, 10: 4, 11: 4, 12: 4, 7: 4}
    # at depth 4 five facts are due and at depth 3 three: 5 and its parent have two
    thin = tree(spark, [(1, None, None, 9), *[(k, k - 1, None, 2) for k in range(2, 6)], *[(10 * k, k, 100 * k, 1) for k in range(2, 6)], (51, 5, 510, 1)])
    assert {r.id for r in G.dissolvable(thin).collect()} == {5}
    assert G.dissolved(nodes.limit(0)).collect() == []


@pytest.mark.parametrize("deep", [40, 1000])  # beyond an int, and beyond a double
def test_thin_chains_of_any_depth_are_found(spark, deep):
    chain = tree(spark, [(1, None, None, 2**31 - 1), *[(k, k - 1, None, 2) for k in range(2, deep)], *[(10_000 + k, k, k, 1) for k in range(2, deep)], (20_000, deep - 1, 9, 1)])
    assert {r.id for r in G.dissolvable(chain).collect()} == set(range(5, deep))


def test_deep_thin_chains_dissolve_whole(spark):
    chain = tree(spark, [(1, None, None, 100), *[(k, k - 1, None, 2) for k in range(2, 60)], *[(100 + k, k, k, 1) for k in range(2, 60)], (200, 59, 9, 1)])
    assert links(G.dissolved(chain)) == {1: None, 2: 1, 3: 2, 4: 3, 102: 2, 103: 3, 200: 4, **{100 + k: 4 for k in range(4, 60)}}


def test_trees_dissolve_to_the_end_in_one_pass(spark, monkeypatch):
    # aspects without facts in a tree of two children each: a level goes in each of six rounds
    levels = tree(spark, [(1, None, None, 100), *[(k, k // 2, None, 10**6) for k in range(2, 128)], (500, 1, 5, 1)])
    passes = []
    monkeypatch.setattr(G, "hierarchy", lambda *a, h=G.hierarchy, **k: passes.append(1) or h(*a, **k))
    assert links(G.dissolved(levels)) == {1: None, 500: 1}
    assert len(passes) == 1


def plainly_dissolved(rows):
    """{id: parent} after rounds over rows of (id, parent, fact, support), one node at a time."""
    parent, rest = {r[0]: r[1] for r in rows}, {r[0]: (r[2], r[3] or 0) for r in rows}

    def depth(k):
        n, seen = 0, {k}
        while (k := parent[k]) in parent:
            if k in seen:
                return -1
            seen.add(k)
            n += 1
        return n

    def thin(k):
        x = math.exp((depth(k) - 2) / 1.3)
        return rest[k][1] < (round(x) if abs(x - round(x)) <= 0.1 else math.ceil(x))

    while True:
        kids = [p for p in parent.values() if p is not None]
        gone = {k for k, p in parent.items() if rest[k][0] is None and depth(k) > 0 and (kids.count(k) <= 1 or (depth(p) > 0 and thin(k) and thin(p)))}
        if not gone:
            return parent
        over = dict(parent)
        for k in parent.keys() - gone:
            while over[k] in gone:
                over[k] = parent[over[k]]
        parent = {k: over[k] for k in parent.keys() - gone}


@pytest.mark.parametrize("cap", [G.TREE_CAP, 30, 0])  # all trees at once, the large ones by rounds, all by rounds
def test_dissolving_is_the_same_for_trees_of_any_size(spark, cap):
    rng, far = np.random.default_rng(7), 2**60  # ids that no float holds
    rows = []
    for k in range(240):
        over = int(rng.integers(max(0, k - (4 if k < 120 else 100)), k)) if k % 40 else None  # deep trees, then wide ones
        fact = k if rng.random() < 0.4 else None
        rows.append((far + k, None if over is None else far + max(over, k - k % 40), fact, None if rng.random() < 0.1 else int(rng.integers(0, 12))))
    rows += [(far + 300, far + 301, None, 1), (far + 301, far + 300, None, 1), (far + 302, far + 301, None, 1), (far + 303, 5, None, 1), (far + 304, far + 303, None, 1), (far + 305, far + 304, 9, 1)]
    want = plainly_dissolved(rows)
    assert 50 < len(want) < 220
    assert links(G.dissolved(tree(spark, rows), cap=cap)) == want


def test_debt_follows_the_nodes_own_support(spark):
    nodes = tree(spark, [(1, None, None, 100), (2, 1, None, 1), (3, 2, None, 1), (4, 3, None, 1), (5, 4, 50, 1)])
    debt = {r.id: r.debt for r in G.with_debt(nodes).collect()}
    assert debt == {1: 0.0, 2: 0.0, 3: 0.0, 4: 5.0}  # one fact allows a depth of two


def test_attaching_moving_and_grouping(spark):
    nodes = tree(spark, [(1, None, None, 4), (2, 1, None, 2), (3, 1, None, 2), (4, 2, 40, 1), (5, 2, 50, 1), (6, 3, 60, 1), (7, 3, 70, 1)])
    grown = G.attached(nodes, spark.createDataFrame([(2, 80, 8), (3, 90, 9), (2, 95, 10)], "node_id long, fact_id long, leaf_id long"))
    assert {r.id: r.support for r in grown.collect()} == {1: 7, 2: 4, 3: 3, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    # 4 under 3; under a leaf, under itself or below, and a root: not done
    moves = spark.createDataFrame([(4, 3), (5, 6), (2, 2), (1, 3), (3, 99)], "id long, new_parent long")
    moved = G.reparented(nodes, moves)
    assert links(moved) == links(nodes) | {4: 3}
    assert {r.id: (r.support, r.uncertainty_score) for r in moved.collect() if r.id < 4} == {1: (4, 0.0), 2: (1, 1.0), 3: (3, 1.0)}
    # two moves that are sound alone and run in a circle together
    assert links(G.reparented(nodes, spark.createDataFrame([(2, 3), (3, 2)], "id long, new_parent long"))) == links(nodes)
    wide = tree(spark, [(1, None, None, 4), *[(k, 1, 10 * k, 1) for k in range(2, 6)]])
    groups = spark.createDataFrame([(100, 1, "pair", [2, 3, 3]), (101, 1, "single", [4]), (102, 1, "foreign", [99, 98])], "group_id long, parent_id long, description string, members array<long>")
    assert links(G.grouped(wide, groups)) == {1: None, 100: 1, 2: 100, 3: 100, 4: 1, 5: 1}


def test_actions_are_checked(spark):
    assert G.valid_groups([{"label": "a", "members": [1, 2]}], [1, 2, 3])
    for bad in ([{"label": " ", "members": [1, 2]}], [{"label": "a", "members": [1]}], [{"label": "a", "members": [1, 9]}], [{"label": "a", "members": [1, 2]}, {"label": "b", "members": [2, 3]}]):
        with pytest.raises(ValueError):
            G.valid_groups(bad, [1, 2, 3])
    nodes = tree(spark, [(1, None, None, 4), (2, 1, None, 2), (3, 1, None, 2), (4, 2, 40, 1), (5, 2, None, 1)])
    moves = spark.createDataFrame([(4, "PROMOTE", None), (5, "RELOCATE", 3), (2, "PROMOTE", None), (3, "RELOCATE", 4)], "id long, action string, target long")
    assert {tuple(r) for r in G.valid_moves(moves, nodes).collect()} == {(4, 1), (5, 3)}
    with pytest.raises(ValueError):
        G.valid_moves(moves.unionByName(moves), nodes)


def test_the_whole_round(spark):
    nodes = tree(spark, [(1, None, None, 12), *[(k, 1, 10 * k, 1) for k in range(2, 14)]]).withColumn("uncertainty_score", F.when(F.col("id") == 1, 20.0).otherwise(0.0))
    placed = spark.createDataFrame([(1, 500, 50)], "node_id long, fact_id long, leaf_id long")
    group = lambda ids, texts: [{"label": "low", "members": ids[:4]}, {"label": "high", "members": ids[4:9]}]
    out = {r.id: r for r in G.updated(nodes, placed, group, lambda texts: f"{len(texts)} parts", 1000).collect()}
    assert out[1000].description == "low" and out[1001].parent_id == 1 and [out[k].parent_id for k in (2, 5, 6, 10, 11)] == [1000, 1000, 1001, 1001, 1]
    assert out[1].description == "5 parts" and out[1].support == 13 and out[50].fact_id == 500
    silent = {r.id: r.parent_id for r in G.updated(nodes, placed, lambda ids, texts: [{"label": "", "members": ids}], lambda texts: str(len(texts)), 1000).select("id", "parent_id").collect()}
    assert silent == {1: None, 50: 1} | {k: 1 for k in range(2, 14)}


def test_changes_go_up_from_three_on(spark):
    nodes = tree(spark, [(1, None, None, 3), (2, 1, None, 1), (3, 1, None, 1), (4, 1, None, 1), (5, 2, 50, 1), (6, 3, 60, 1), (7, 4, 70, 1)])
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    said = lambda df: {r.id: (r.description, r.fresh_count) for r in df.collect() if r.id < 5}
    assert said(G.propagated(nodes, "+".join, ids(2, 3))) == {1: ("d1", 2), 2: ("d5", 0), 3: ("d6", 0), 4: ("d4", 0)}
    assert said(G.propagated(nodes, "+".join, ids(2, 3, 4)))[1] == ("d5+d6+d7", 0)


def test_routing_stops_over_leaves(spark):
    t = pd.DataFrame({"id": [1, 2, 3, 4], "parent_id": [None, 1.0, 1.0, 2.0], "vec": [[1.0, 0.0], [0.5, 1.0], [0.0, 1.0], [0.0, 1.0]], "leaf": [False, False, True, True], "centroid": [None, [0.0, 1.0], None, None]})
    assert G.route(t, np.array([0.0, 1.0])) == 1  # the leaf 3 is the best child
    assert G.route(t[t.id != 3], np.array([0.0, 1.0])) == 2
    assert G.route(t.iloc[:0], np.array([0.0, 1.0])) == -1


def test_beam_in_deep_chains(spark):
    chain = tree(spark, [(i, i - 1 if i else None, None, 1) for i in range(60)] + [(60, 59, 600, 1)])
    assert [tuple(r) for r in G.beam(chain, chain.select("id", F.lit(0.0).alias("score"))).collect()] == [(0, 600)]


def test_words_of_any_script_and_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Die Katze übt für Prüfungen"), (2, "猫和狗"), (3, "two kettles boiled"), (4, "the bus passes"), (5, None)], "id long, text string")
    index = S.Index(docs, "id", "text", stemmed=True)
    stored = index.written(f"file://{tmp_path}/index")
    for own in (index, stored, S.Index.read(spark, f"file://{tmp_path}/index")):
        found = lambda q, own=own: [r.id for r in own.search(q, 5).collect()]
        assert found("über prüfungen") == [1] and found("猫") == [2] and found("kettle") == [3] and found("+bus passes") == [4] and found("") == []
    assert "part" in str(stored.search("猫", 5)._jdf.queryExecution().executedPlan()) and S.Index(docs.limit(0), "id", "text").search("bus", 5).collect() == []


def test_protected_facts_pass_the_caps(spark):
    item = lambda i, leaf: F.struct(F.lit(i).alias("id"), F.lit(leaf).alias("leaf"), F.lit("m").alias("mid"))
    kept = spark.range(1).select(S.capped(F.array(*[item(i, "a") for i in range(6)]), 2, 8, F.array(F.lit(0), F.lit(5)).cast("array<long>")).alias("k")).first()[0]
    assert [k.id for k in kept] == [0, 1, 2, 5]


def test_reuse_needs_the_same_entities(spark):
    facts = spark.createDataFrame([(1, 7, "[Alex] moved", ["e1"]), (2, 7, "[Alex] moved", ["e2"]), (3, 7, "[Alex] moved", ["e1", "e1"]), (4, 8, "[Alex] moved", None)], "id long, task_id int, text string, entities array<string>")
    new = spark.createDataFrame([("a", 7, "[Alex] moved", ["e2"]), ("b", 7, "[Alex] moved", ["e3"]), ("c", 8, "[Alex] moved", [])], "key string, task_id int, text string, entities array<string>")
    assert {tuple(r) for r in M.exact_reuse(new, facts).collect()} == {("a", 2), ("c", 4)}
    pairs = spark.createDataFrame([("a", "t", ["e1"], 1, "same", ["e1"]), ("a", "t", ["e1"], 2, "other", ["e2"]), ("b", "u", ["e1"], 3, "no", ["e1"])], "key string, text string, entities array<string>, fact_id long, fact_text string, fact_entities array<string>")
    assert [tuple(r) for r in M.equivalent_facts(pairs, lambda text, offered: 0 if text == "t" else 9).collect()] == [("a", 1)]


def test_cursor_places_and_upserts(spark):
    assert M.chosen("1-3, 8,2", 8) == [1, 2, 3, 8]
    for bad in ("0", "9", "3-1", "a", "", "1-2-3"):
        with pytest.raises(ValueError):
            M.chosen(bad, 8)
    old = spark.createDataFrame([(1, None, 5), (2, 1, 1), (3, 1, 1)], "id long, parent_id long, support int")
    new = spark.createDataFrame([(1, None, 6), (2, 1, 1), (4, 2, 1)], "id long, parent_id long, support int")
    assert dict(map(tuple, M.upserts(old, new, ["parent_id", "support"]).collect())) == {1: "update", 2: "keep", 3: "delete", 4: "insert"}
    with pytest.raises(ValueError):
        M.upserts(old, new.filter("id <> 2"), ["support"])


@pytest.mark.parametrize(
    ("new", "target", "aliases", "desc", "conflict"),
    [
        ("Blake", "badge", [], None, True), ("Blake", "Blake Ross", [], None, False), ("Avery's badge", "Blake's badge", [], None, True), ("Avery's badge", "badge", [], "found near Avery's desk", False),
        ("Avery's badge", "badge", [], "Blake's old one", True), ("Blake", "B", ["Blake Ross"], None, False), ("the badge", "badge", [], None, False), ("Blake", "Ross", [], "Ross's cousin", True), (None, "x", [], None, False),
    ],
)
def test_identity_conflicts(spark, new, target, aliases, desc, conflict):
    row = spark.createDataFrame([(new, target, aliases, desc)], "n string, t string, a array<string>, d string")
    assert row.select(X.identity_conflict(F.col("n"), F.col("t"), F.col("a"), F.col("d"))).first()[0] == conflict


def test_canonical_names(spark):
    df = spark.createDataFrame([("e1", ["Al", "Alan Turner", "Alan T"], "x"), ("e2", [], None)], "entity_id string, names array<string>, desc string")
    assert {tuple(r) for r in E.canonical(df).collect()} == {("e1", "Alan Turner", "x"), ("e2", None, None)}
    told = E.canonical(df, lambda names, desc: ("Al", "w " * 61) if names else ("nobody", "new"))
    assert {tuple(r) for r in told.collect()} == {("e1", "Al", "x"), ("e2", None, "new")}


def test_registry_retry_trace_and_factory(spark):
    reg = H.Registry()
    reg.add(H.Manifest("greet", lambda name: {"value": f"hi {name}"}, ("name",), "value string", "Greet {name}"))
    reg.add(H.Manifest("greet", lambda name: {"other": 1}, ("name",)), "broken")
    assert reg.get("greet", "unknown").rendered(name="Bo") == "Greet Bo"
    for bad in (lambda: reg.get("none"), lambda: reg.get("greet").rendered()):
        with pytest.raises(KeyError):
            bad()
    rows = spark.createDataFrame([(1, "Bo")], "id int, name string")
    assert [tuple(r) for r in H.factory(reg, "greet")(rows).collect()] == [(1, "Bo", "hi Bo", None)]
    failed = H.factory(reg, "greet", "broken")(rows).first()
    assert failed.value is None and "KeyError" in failed.error and H.factory(reg, "greet") is H.factory(reg, "greet")

    class Busy(Exception):
        status_code, retry_after = 429, 7

    waits, tries = [], iter([Busy(), TimeoutError(), RuntimeError("content_filter"), None])

    def call():
        error = next(tries)
        if error:
            raise error
        return "done"

    assert H.retried(call, waits.append)() == "done" and waits == [7.0, 2.0]
    with pytest.raises(ValueError):
        H.retried(lambda: int("x"), waits.append)()
    shots = []
    trace = H.Trace(shots.append)
    assert trace.record("a", lambda: 5, cost=lambda out: out / 10) == 5
    with pytest.raises(ZeroDivisionError):
        trace.record("b", lambda: 1 / 0)
    assert [(r.task, r.status, r.cost) for r in trace.rows(spark).collect()] == [("a", "done", 0.5), ("b", "failed", 0.0)] and len(shots) == 4
    assert H.evaluation_profile("choices").judge == "letter" and H.evaluation_profile("what").name == "base"
