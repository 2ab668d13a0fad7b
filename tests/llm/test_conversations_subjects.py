import collections
import random

import pytest

from mnemoframe.llm import conversations, subjects

ALIASES = [("user", "user"), ("me", "user"), ("assistant", "assistant"), ("bot", "assistant"), ("system", "system"), ("助手", "assistant")]


def verdict(rows):
    """Reason for a session's distinct (position, speaker, content) rows, straight from the rules."""
    names = dict(ALIASES)
    if not rows:
        return True
    if any(not (s or "").strip() or not (c or "").strip() for _, s, c in rows):
        return True
    at = sorted(p for p, _, _ in rows if p is not None)
    if len(at) < len(rows) or at[0] not in (0, 1) or at != list(range(at[0], at[0] + len(at))):
        return True
    roles = [names.get("".join(x for x in s.lower() if x.isalpha()), "user") for _, s, _ in sorted(rows)]
    spoken = [r for r in roles if r != "system"]
    return "user" not in roles or "assistant" not in roles or spoken[-1] != "assistant"


def tables(spark, data, ids):
    m = spark.createDataFrame(data, "id long, session_id long, position int, speaker string, content string, role string, h long")
    return spark.createDataFrame([(i,) for i in ids], "id long"), m, spark.createDataFrame(ALIASES, "alias string, role string")


@pytest.mark.parametrize("block_ids", [2048, 5, 2])
def test_against_the_rules(spark, block_ids):
    rnd = random.Random(9)
    data, key = [], 0
    for session in range(120):
        n = rnd.randrange(0, 9)
        start = rnd.choice([0, 1, 1, 0, 2])
        rows = [(start + i, ["User ", "<|assistant|>"][i % 2] if rnd.random() < 0.95 else "system", f"t{i}") for i in range(n)]
        if rows and rnd.random() < 0.15:
            rows.pop(rnd.randrange(len(rows)))
        if rows and rnd.random() < 0.1:
            rows.append((rows[0][0], "me", "another"))
        if rows and rnd.random() < 0.05:
            rows.append((rows[-1][0] + 1, rnd.choice([None, " ", "bot"]), rnd.choice([None, "\n", "x"])))
        rows += rnd.sample(rows, len(rows) // 2)  # the same message under another id
        rnd.shuffle(rows)
        for p, s, c in rows:
            data.append((key, session, p, s, c, "clash", 1))
            key += rnd.choice([1, 1, 1, 4])
    data += [(10_000, 5000, 0, "me", "x", "", 0), (10_001, None, 0, "me", "x", "", 0), data[0]]
    per = collections.defaultdict(set)
    for _, s, p, who, text, _, _ in data:
        per[s].add((p, who, text))
    got, said = conversations.assemble(*tables(spark, data, range(125)), block_ids=block_ids)
    dropped = {r.session_id for r in got.collect() if r.reason}
    assert dropped == {s for s in range(125) if verdict(per.get(s, set()))}
    turns = collections.defaultdict(list)
    for r in said.collect():
        turns[r.session_id].append(r.turn)
    assert set(turns) == set(range(125)) - dropped and all(sorted(t) == list(range(len(t))) for t in turns.values())


def test_reasons(spark):
    data = [(1, 1, 0, "me", "a", "", 0), (2, 1, 1, "bot", "b", "", 0), (3, 2, None, "me", "a", "", 0), (4, 3, 0, "me", "a", "", 0), (5, 3, 1, None, "a", "", 0), (6, 4, 0, "bot", "a", "", 0), (7, 5, 0, "bot", "a", "", 0), (8, 5, 1, "me", "a", "", 0)]
    got, _ = conversations.assemble(*tables(spark, data, [1, 1, 2, 3, 4, 5, 6]))
    assert dict(map(tuple, got.collect())) == {1: None, 2: "broken", 3: "blank", 4: "no_user", 5: "no_reply", 6: "empty"}
    s, m, a = tables(spark, data, [1])
    assert conversations.assemble(s.limit(0), m, a)[0].collect() == [] and conversations.assemble(s, m.limit(0), a)[0].collect()[0].reason == "empty"


def test_planted_fragments(spark):
    """Fragments that overlap are merged by their hashes; one that goes on in two ways, or contradicts where it overlaps, breaks its session."""
    who = ["me", "bot"]
    part = lambda first_id, session, positions, tag="t": [(first_id + i, session, p, who[p % 2], f"{tag}{p}", "", 0) for i, p in enumerate(positions)]
    data = part(0, 1, range(4)) + part(10, 1, range(2, 6)) + part(20, 1, range(5, 8)) + part(30, 1, range(3, 5))
    data += part(100, 2, range(4)) + part(110, 2, range(2, 6), "u")  # 2 and 3 again, saying something else
    data += part(200, 3, range(3)) + part(210, 3, range(3, 6)) + part(220, 3, range(3, 8), "v")  # two ways on from 2
    data += part(300, 4, range(1, 3)) + part(310, 4, range(4, 7))  # 3 is missing
    data += part(400, 5, [5, 4, 3, 2, 1, 0])  # stored from the end
    turns, frags = conversations.fragments(tables(spark, data, range(1, 6))[1], tables(spark, data, [])[2])
    _, edges = conversations.overlap_edges(frags)
    assert sorted(r.n for r in edges.collect() if r.n) == [1, 2]  # session 1; that of positions 3 and 4 is contained
    got, said = conversations.assemble(*tables(spark, data, range(1, 6)))
    assert dict(map(tuple, got.collect())) == {1: None, 2: "broken", 3: "broken", 4: "broken", 5: None}
    rows = sorted((r.session_id, r.turn, r.content) for r in said.collect())
    assert rows == [(1, i, f"t{i}") for i in range(8)] + [(5, i, f"t{i}") for i in range(6)]


TOPICS = {"law": "judge court plaintiff statute verdict appeal".split(), "music": "violin chord melody tempo sonata choir".split(), "sport": "referee striker goal league coach medal".split()}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        about = rnd.sample(sorted(TOPICS), rnd.choice([1, 1, 1, 2]))
        lines = []
        for t in about:
            lines += [f"The {a} asked about the {b} and the {c}." for a, b, c in (rnd.sample(TOPICS[t], 3) for _ in range(rnd.randrange(4, 7)))]
        lines += ["That sounds good to me.", "We will see about it tomorrow."][: rnd.randrange(3)]
        rnd.shuffle(lines)
        docs.append((i, " ".join(lines), "note", f"chat-{i % 5}", "x"))
        truth[i] = set(about)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(240)
    docs += [(900, None, None, None, ""), (901, "  ", "note", None, ""), (902, "?", "note", None, ""), docs[0]]
    rnd = random.Random(2)
    labels = [(i, rnd.choice(sorted(TOPICS)) if rnd.random() < 0.05 else t, "a") for i in range(60) for t in truth[i]] + [(None, "law", "a"), (3, None, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, doc_kind string, source string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([(t, "") for t in TOPICS] + [("unused", "")], "subject string, description string")
    got = collections.defaultdict(set)
    for r in subjects.subject_areas(df, lab, areas).collect():
        got[r.doc_id].add(r.subject)
    assert not {900, 901, 902} & set(got)
    held_out = [i for i in truth if i >= 60]
    assert sum(got[i] == truth[i] for i in held_out) >= 0.95 * len(held_out)


def test_no_labels_no_areas(spark):
    df = spark.createDataFrame([(1, "The judge asked.", "note", "c")], "doc_id long, text string, doc_kind string, source string")
    lab = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([("law", "")], "subject string, description string")
    assert subjects.subject_areas(df, lab, areas).collect() == []


def test_sentences():
    text = '# Head\n{"file": 1}\nOne is. Two said "it is not" The third one?\nA: 我们走。他来。\n?\n'
    assert [s.strip() for s in subjects.sentences(text)] == ["One is.", 'Two said "it is not"', "The third one?", "A: 我们走。", "他来。"]
    assert subjects.sentences(None) == []
