"""Functions, search, resolution, trees and the store on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemoframe.api import FileLibrary, Hooks, MemoryStore, hashed_embedding, without_stop_words
from mnemoframe.functions import text as X
from mnemoframe.functions import vectors as V
from mnemoframe.operators import memory as M
from mnemoframe.operators import resolution as E
from mnemoframe.operators import search as S
from mnemoframe.operators import trees as G
from mnemoframe.runtime import blocked, components, over_groups


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (lambda: X.bracket_refs(lit("[Bob] met [Al::x] and [Bob] [Eve]")), ["Bob", "Eve"]),
        (lambda: X.render_marks(lit("[a:b::c] [d::e]")), "[a:b::c] d (e)"),
        (lambda: X.inline_dates(lit("on [May::2024-05]")), "on [2024-05]"),
        (lambda: X.search_text(lit("[Bob] left [today::2024]"), F.array(lit("Robert"))), "Bob left today [Robert]"),
        (lambda: X.time_info(lit("then"), lit("2024/2025"), lit(None)), "then [2024, 2025]"),
        (lambda: X.time_info(lit(None).cast("string"), lit(None).cast("string"), lit("2024")), "[2024]"),
        (lambda: X.clean_time_info(lit("x [2024-01-02T10:00, 2024-02-03]")), "2024-01-02/2024-02-03"),
        (lambda: X.fact_line(lit("a"), lit("[2024]")), "- a (known from message on 2024)"),
        (lambda: X.token_estimate(lit("12345678")), 3),
        (lambda: X.sanitized_query(lit('a+b "c" 中文 (d)')), "a b c d"),
        (lambda: X.sanitized_boolean_query(lit("+a -b (c|d)")), "+a -b (c d)"),
        (lambda: X.shingles(lit("ab c")), ["abc"]), (lambda: X.shingles(lit("ab")), ["ab"]), (lambda: X.shingles(lit("")), []),
        (lambda: X.jaccard(F.array(lit("a")), F.array(lit("a"), lit("b"))), 0.5),
        (lambda: X.session_label(lit("2023/05/20 (Sat) 02:21")), "2023/05/20 (Sat) 02:21"), (lambda: X.session_label(lit("2023-05-20T00")), "2023-05-20"),
        (lambda: X.message_line(lit("t"), lit("u"), lit("c")), "[t] u: c"), (lambda: X.message_line(lit(None), lit(""), lit("c")), "c"),
        (lambda: X.shortened_reply(lit("a\n\n\nb")), "a\nb"), (lambda: X.shortened_reply(lit("x" * 500)), "（……）" + "x" * 400),
        (lambda: X.evidence_ref(lit("D1:3")), "S1:2"), (lambda: X.evidence_ref(lit("no")), None),
        (lambda: X.ranked_answer(F.array(lit("a"), lit("b"))), "1. a\n2. b"),
        (lambda: X.judge_label(lit('x ```json\n{"label": "correct"}\n```')), "CORRECT"), (lambda: X.judge_label(lit("wrong")), "WRONG"), (lambda: X.judge_label(lit("maybe")), None),
        (lambda: X.final_answer(lit("hm\nFINAL ANSWER: 42")), "42"), (lambda: X.final_answer(lit(" 7 ")), "7"),
        (lambda: X.sections(lit("[Question] why\n[Choice A] a\nb"))["Choice A"], "a\nb"),
        (lambda: X.chunk_prefix(lit("a.md"), lit(0), lit(2), lit(None).cast("int"), lit("# Top\nx")), "File: a.md | Type: MD | Part 1/2 | Section: Top"),
        (lambda: X.escaped(lit("<a & 'b'>")), "&lt;a &amp; &#x27;b&#x27;&gt;"),
        (lambda: X.lock_slot(lit("a")), -390611389), (lambda: X.category_of(lit("Time_questions")), "Time"),
        (lambda: X.persona_name(lit('{"profile": {"name": "Ada"}}')), "Ada"), (lambda: X.persona_name(lit("{}")), "User"),
        (lambda: X.identity_conflict(lit("Blake"), lit("AURORA-1001")), True), (lambda: X.identity_conflict(lit("Blake's badge"), lit("Avery's badge")), True),
        (lambda: X.identity_conflict(lit("Blake"), lit("Blake's badge")), True), (lambda: X.identity_conflict(lit("Bob"), lit("Robert")), False),
        (lambda: X.resolve_aliases(lit("[Al] and [Bo]"), F.array(F.struct(lit("Al").alias("alias"), lit("Alan").alias("canonical")))), "[Alan] and [Bo]"),
        (lambda: X.highlighted(lit("A.b a.B"), "a.b"), "<mark>A.b</mark> <mark>a.B</mark>"),
        (lambda: X.diary_content(F.create_map(lit("id"), lit("1"), lit("mood"), lit("calm"))), "[mood: calm]"),
        (lambda: X.clock_time(lit("1:56 pm on 8 May, 2023")).cast("string"), "2023-05-08 13:56:00"), (lambda: X.clock_time(lit("2023/05/20 (Sat) 02:21")).cast("string"), "2023-05-20 02:21:00"),
        (lambda: V.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0))), 0.0), (lambda: V.parsed_vector(lit("[1,2.5]")), [1.0, 2.5]),
        (lambda: G.most_depth(lit(1)), 2), (lambda: G.least_support(lit(2)), 1), (lambda: G.child_score(lit(-0.5), lit(0.2)), 0.2),
    ],
)
def test_functions(spark, make, expected):
    got = one(spark, make())
    assert list(got) == expected if isinstance(expected, list) else got == expected


def test_search_and_fusion(spark):
    docs = spark.createDataFrame([(1, "the red kettle"), (2, "a kettle kettle"), (3, "blue cup"), (4, None), (5, "")], "id long, text string")
    index = S.Index(docs, "id", "text")
    assert [r.id for r in index.search("kettle", 10).collect()] == [2, 1]
    assert [r.id for r in index.search("+red kettle", 10).collect()] == [1]
    assert index.search("中文", 5).collect() == [] and index.search("", 5).collect() == []
    a, b = index.search("kettle", 10), index.search("blue red", 10)
    fused = {r.id: r.source for r in S.fuse([("a", a), ("b", b)]).collect()}
    assert fused == {1: "a", 2: "a", 3: "b"}
    assert S.interleaved([[1, 2, 3], [1, 4]], 4) == [1, 4, 2, 3]
    kept = spark.range(1).select(S.capped(F.array(*[F.struct(F.lit(i).alias("id"), F.lit("l").alias("leaf"), F.lit(None).cast("string").alias("mid")) for i in range(5)])).alias("k")).first()[0]
    assert [k.id for k in kept] == [0, 1, 2]


def test_groups_and_components(spark):
    df = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 100)], "key long, row long")
    cut = blocked(df, "key", "row", 8)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby("_group"):
            r, b, cross = g["row"].tolist(), g["_block"].tolist(), g["_cross"].tolist()
            out += [(min(r[i], r[j]), max(r[i], r[j])) for i in range(len(r)) for j in range(i) if g["key"].iloc[i] == g["key"].iloc[j] and (not cross[i] or b[i] != b[j])]
        return pd.DataFrame(out, columns=["a", "b"])

    got = over_groups(cut, "_group", pairs, "a long, b long").collect()
    assert len(got) == len({tuple(r) for r in got}) == 30 * 29 // 2
    edges = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10] + [(7, 7), (99, 99), (None, 3)], "a long, b long")
    comp = dict(map(tuple, components(edges).collect()))
    assert comp[99] == 99 and all(comp[i] == (i - 1) // 10 * 10 + 1 for i in range(1, 50))


def test_resolution(spark):
    known = spark.createDataFrame([(1, 1, "Alex Chen"), (2, 1, "Bartholomew Zimmerman"), (3, 1, "Sam"), (4, 1, "sam")], "id long, task_id int, name string")
    new = spark.createDataFrame([(10, 1, "alex  chen"), (11, 1, "Bartholomew Zimmermann"), (12, 1, "Sam"), (13, 1, "Nobody Known"), (14, 2, "Alex Chen")], "id long, task_id int, name string")
    got = {r.id: (r.action, r.target) for r in E.resolve(new, known).collect()}
    assert got == {10: ("merge", 1), 11: ("merge", 2), 12: ("create", None), 13: ("create", None), 14: ("create", None)}


def test_trees(spark):
    tree = pd.DataFrame({"id": [1, 2, 3, 4], "parent_id": [None, 1.0, 1.0, 2.0], "vec": [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 1.0]], "leaf": [False, False, False, True]})
    assert G.route(tree, np.array([0.1, 1.0])) == 2 and G.route(tree, np.array([1.0, 0.0])) == 1
    nodes = spark.createDataFrame([("e", 1, None, [1.0, 0.0], False), ("e", 2, 1, [0.0, 1.0], False), ("e", 3, 1, [1.0, 1.0], False)], "entity_id string, id long, parent_id long, vec array<double>, leaf boolean")
    facts = spark.createDataFrame([("e", 7, [0.0, 2.0]), ("none", 8, [1.0, 0.0])], "entity_id string, fact_id long, vec array<double>")
    assert [tuple(r) for r in G.routed(nodes, facts).collect()] == [("e", 7, 2)]


def test_windows(spark):
    m = spark.createDataFrame([(1, 10 + i, i, "x" * n) for i, n in enumerate([10, 10, 900, 5, 5, 5])], "session_id long, id long, position int, content string")
    got = [(r.batch_index, r.n_messages, r.n_chars) for r in M.message_batches(m, 2, 100).orderBy("batch_index").collect()]
    assert got == [(0, 2, 20), (1, 1, 900), (2, 2, 10), (3, 1, 5)]
    assert M.count_windows(10, 4, 1) == [(0, 4), (3, 7), (6, 10), (9, 10)] and M.count_windows(8, 4, 1) == [(0, 4), (4, 8)] and M.count_windows(0, 4, 1) == []
    b = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"])], "session_id long, batch_index int, lines array<string>")
    assert {r.batch_index: list(r.context) for r in M.context_tails(b, 1).collect()} == {0: [], 1: ["b"]}


def store(spark, hooks=None):
    facts = spark.createDataFrame([(1, 1, "[Ann] has a red kettle", "2024-01-01", "active", hashed_embedding("red kettle")), (2, 1, "[Bob] likes tea", None, "Active ", hashed_embedding("tea")), (3, 2, "red kettle", None, "active", None), (4, 1, "red kettle", None, "invalidated", None)], "id long, task_id int, text string, fact_ts string, status string, text_embedding array<float>")
    sources = spark.createDataFrame([(1, 77), (1, 88), (2, 77)], "fact_id long, session_id long")
    sessions = spark.createDataFrame([(77, 1, "chat-a"), (88, 1, "chat-b")], "id long, task_id int, chat_id string")
    summaries = spark.createDataFrame([(77, "Session 1", "about kettles")], "session_id long, subject string, content string")
    return MemoryStore(spark, facts, sources, sessions, summaries, hooks or Hooks())


@pytest.mark.parametrize(("mode", "strategy"), [("direct", "rrf"), ("expand", "rerank"), ("reflect", "rrf")])
def test_store_search(spark, mode, strategy):
    def fails(*_):
        raise RuntimeError("no model")

    hooks = Hooks(rewrite=fails, reflect=lambda q, known: ["tea"])
    found = store(spark, hooks).search(1, "red kettle", mode, strategy, top_k=1)
    ids = [r.id for r in found.facts.orderBy("place").collect()]
    assert ids[0] == 1 and set(ids) <= {1, 2} and (mode != "reflect" or ids == [1, 2])
    assert "- [Ann] has a red kettle (known from message on 2024-01-01)" in found.context and found.n_tokens == len(found.context) // 4 + 1
    assert {r.session_id for r in found.sessions.collect()} == {77, 88}


def test_store_misses(spark):
    found = store(spark).search(9, "red kettle")
    assert found.facts.collect() == [] and found.context == "" and found.n_tokens == 0
    with pytest.raises(ValueError):
        store(spark).search(1, "x", "other")
    assert without_stop_words("What is the red kettle?") == "red kettle" and without_stop_words("what is") == "what is"


def test_file_library(spark):
    chunks = spark.createDataFrame([(1, "c", "d1", "a.txt", "release <Friday>"), (2, "c", "d2", "b.txt", "error TS-999 release"), (3, "x", "d1", "a.txt", "release")], "chunk_id long, chat_id string, document_id string, file_name string, content string")
    lib = FileLibrary(chunks)
    assert {r.id for r in lib.search("c", "release").collect()} == {1, 2}
    assert {r.id for r in lib.search("c", "release", [" d2 "]).collect()} == {2}
    with pytest.raises(ValueError):
        lib.search("c", "release", [" "])
    text = lib.packed(lib.search("c", "release"), 100)
    assert "&lt;Friday&gt;" in text and lib.packed(lib.search("none", "release"), 100) == ""
    left, documents, n = lib.without("c", "d1")
    assert (documents, n, left.count()) == (1, 1, 2) and lib.without("c")[1:] == (2, 2)


def test_digest(spark):
    from mnemoframe.operators import ingest as I

    sessions = spark.createDataFrame([(1, 5, 1, None), (2, 5, 2, "done")], "id long, task_id int, session_number int, digested_at string")
    messages = spark.createDataFrame([(1, 1, 0, "me", "Robert Miller likes tea", None), (2, 1, 1, "bot", "noted", None), (3, 2, 0, "me", "Anna left", None)], "id long, session_id long, position int, speaker string, content string, message_time_raw string")
    facts = spark.createDataFrame([(41, 5, "x")], "id long, task_id int, text string")
    sources = spark.createDataFrame([], "fact_id long, session_id long")
    rows, links, done = I.digest(sessions, messages, facts, sources)
    got = rows.collect()
    assert [(r.id, r.task_id) for r in got] == [(42, 5)] and "[Robert Miller]" in got[0].text
    assert [tuple(r) for r in links.collect()] == [(42, 1)] and [r[0] for r in done.collect()] == [1]
    again = I.written(facts.unionByName(rows.select("id", "task_id", "text")), links, rows.select("task_id", F.lit(1).cast("long").alias("session_id"), "text"))
    assert again[0].count() == 0 and again[1].count() == 0


def test_store_messages_and_hooks(spark):
    from mnemoframe.operators import ingest as I

    sessions = spark.createDataFrame([(7, 5, 3)], "id long, task_id int, session_number int")
    messages = spark.createDataFrame([(9,)], "id long")
    s, m = I.store_messages(sessions, messages, 5, "chat", [("me", "a", None), ("bot", "b", None)])
    assert (s.first().id, s.first().session_number) == (8, 4) and [(r.id, r.session_id, r.position) for r in m.orderBy("id").collect()] == [(10, 8, 0), (11, 8, 1)]
    with pytest.raises(ValueError):
        I.store_messages(sessions, messages, 5, "chat", [])
    fails = I.Profile("x", None, I.Extraction(entities=lambda lines: 1 / 0))
    b = spark.createDataFrame([(1, 0, ["Ann said"])], "session_id long, batch_index int, lines array<string>")
    assert I.extracted(b, fails).count() == 0 and I.profile("unknown").name == "default" and I.profile("personas").fixed_entities == ["User"]
    checks = [("[Ann] left [then::2024-05]", True), ("no reference [then::2024]", False), ("[Ann] [then::soon]", False), ("[Ann] [x::2024/]", True), (None, False)]
    df = spark.createDataFrame(checks, "t string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", I.valid_fact(F.col("t"))).collect())
    n = I.numbered(spark.range(1000).withColumnRenamed("id", "k"), [F.col("k")], 10).collect()
    assert [r.id for r in sorted(n, key=lambda r: r.k)] == list(range(11, 1011))


def test_beam_of_a_deep_chain(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 7 if i == 40 else None) for i in range(41)], "id long, parent_id long, fact_id long")
    got = G.beam(nodes, spark.createDataFrame([], "id long, score double")).collect()
    assert [(r.root_id, r.fact_id) for r in got] == [(0, 7)]


def test_whole_order_and_places(spark):
    from mnemoframe.plans import more, scalars

    class C:
        facts = spark.createDataFrame([(i, None if i % 3 == 0 else "" if i % 3 == 1 else f"2024-{i:04}") for i in range(150)], "id long, fact_ts string")
        nodes = spark.createDataFrame([(i, "e") for i in range(9)], "id long, entity_id string")

    got = scalars.t3_whole_order(C).collect()
    assert [r.id for r in got] == [*range(2, 150, 3), *sorted([*range(0, 150, 3), *range(1, 150, 3)])] and got[-1].sort_key == "zzz"
    assert sorted((r.id, r.place) for r in more.w2_places(C).collect()) == [(i, i) for i in range(9)]
