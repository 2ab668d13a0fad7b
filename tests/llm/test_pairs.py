"""Names, neighbours, near-duplicates: against brute force on small tables, with hot keys."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import names, nearduplicates, neighbours
from mnemoframe.llm.words import words


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_neighbours_against_brute_force():
    rnd = random.Random(1)
    tokens = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(250)})
    near = {(i, j) for i, j in itertools.combinations(range(len(tokens)), 2) if levenshtein(tokens[i], tokens[j]) <= (1 if min(len(tokens[i]), len(tokens[j])) < 5 else 2)}
    assert {tuple(sorted(p)) for p in names.trie_neighbours(tokens)} == near
    assert names.trie_neighbours([]) == []


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Wanda Peoran", "Peorran, Wanda", True), ("Wanda Peoran", "W. Peoran", True), ("Dr. Kathy A Veidalt", "Katherine Veidält", True), ("Wanda Peoran", "Walter Peoran", False),
        ("Geileis Timber Association", "GTA", True), ("Geileis Timber Association", "Assoc of Timber, Geileis", True), ("lottetrowiltsson", "Lotte Trowiltsson", True), ("", "x", False),
    ],
)
def test_name_match(a, b, same):
    known = names.Variants([("kathy", "katherine"), *(("dr", t) for t in "abel bert cora dana emil fred".split())])
    assert (names.name_match(names.name_tokens(a), names.name_tokens(b), known) > 0) == same


WORDINGS = {
    "plain": (["works as a {}", "is a {}", "{} by trade"], ["lives in {}", "based in {}", "from {}"], ["works for {}", "employed at {}"], ["since {}", "known since {}"]),
    "reworded": (["earns a living as {}", "makes money being a {}", "paid for {} duty"], ["resides around {}", "sleeps near {}", "{} is home"], ["on the payroll of {}", "serves under {}"], ["around here from {}", "first seen {}"]),
}


@pytest.mark.parametrize("wording", WORDINGS)
def test_descriptions_in_any_wording(spark, wording):
    """No phrase is known beforehand: bearers are found whatever words state what they do."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(n))
    trades, firsts = [word(3) for _ in range(25)], [word(2).title() for _ in range(25)]
    rows, truth, key = [], set(), 0
    for _ in range(220):
        first, last, facts = rnd.choice(firsts), word(4).title(), (rnd.choice(trades), word(4).title(), f"{word(4)} {rnd.choice(('mills', 'works', 'yards'))}".title(), rnd.randrange(1950, 2020))
        own = []
        for _ in range(rnd.randrange(2, 6)):
            name = rnd.choice([f"{first} {last}", f"{last}, {first}", f"{first[0]}. {last}", f"{first} {last[:3]}{last[4:]}"])
            said = [rnd.choice(forms).format(x) for forms, x in zip(WORDINGS[wording], facts)]
            rnd.shuffle(said)
            rows.append((key, rnd.randrange(1), name, ", ".join(said[: rnd.choice((3, 4))]), "", ""))
            own.append(key)
            key += 1
        truth |= set(itertools.combinations(own, 2))
    got = {tuple(r) for r in names.same_pairs(names.same_names(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)


SCHEMA = "id long, task_id int, canonical_ref string, `desc` string, comp string, key string"
D1, D1b = "works for Drouflunen Glass, from Dridround, pilot by trade", "Left drouflunen glass recently, since 1961, based in dridrond"
D2 = "employed at Tuva Polar, lives in Moska, trained baker, since 1990"


def test_same_names(spark):
    data = [
        (1, 1, "Wanda Peoran", D1), (2, 1, "Peorran, Wanda", D1b), (3, 1, "Wanda Peoran", D2), (4, 2, "Wanda Peoran", D1), (5, 1, "oval lamp", "kept in Moska, rarely used"),
        (6, 1, "oval lamp", "kept in Moska, rarely used"), (7, 1, "W Peoran", D1), (8, 3, "Ugo Tralix", None), (9, 3, "Ugo Tralix", " "), (10, 3, None, D1), (11, 1, "Wanda Peoran", None), (1, 1, "Wanda Peoran", D1),
        (12, 4, "Ina Brosk", D2), (13, 4, "Brosk, Ina", None), (None, 1, "Wanda Peoran", D1),
    ]
    # others in the same wording, from which its weight is learned
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4)).title()
    for i in range(60):
        name, firm, town, year, trade = f"{word()} {word()}", f"{word()} {rnd.choice(('Glass', 'Polar'))}", word(), rnd.randrange(1950, 2020), rnd.choice(("pilot", "baker", "nurse", "mason"))
        said = (f"{rnd.choice(('works for', 'employed at'))} {firm}, from {town}, {trade} by trade", f"left {firm} recently, since {year}, {rnd.choice(('based in', 'lives in'))} {town}", f"trained {trade}, since {year}, from {town}")
        data += [(1000 + 3 * i + k, 9, name, d) for k, d in enumerate(said)]
    df = spark.createDataFrame([(*r, "c", "k") for r in data], SCHEMA)
    got = {tuple(r) for r in names.same_pairs(names.same_names(df)).collect() if r[0] < 1000}
    # 11 fits two bearers of the name and joins neither
    assert got == {(1, 2), (1, 7), (2, 7), (8, 9), (12, 13)}
    assert names.same_names(df.limit(0)).collect() == []


def test_hot_name(spark, monkeypatch):
    monkeypatch.setattr(names, "NAME_CAP", 16)
    monkeypatch.setattr(names, "TRIE_TOKENS", 8)
    data = [(i, 1, "Wanda " + ("Peoran" if i % 2 else "Peorann"), f"works for Drouflunen Glass, from Dridround, pilot by trade, note {i}", "", "") for i in range(90)]
    data += [(1000 + i, 1, f"Person N{'abcdefghij'[i]}xtor", D2, "", "") for i in range(10)]
    got = names.same_names(spark.createDataFrame(data, SCHEMA)).toPandas()
    assert got[got.id < 1000].grp.nunique() == 1 and len(got) == 100


def test_people_of_few_statements_are_in_a_group(spark):
    data = [(1, 1, "Nuria Veoviar", "from Shedai, works as a baker", "", ""), (2, 1, "Nuria Veoviar", "from Shedai, works as a baker", "", ""), (3, 1, "crimson flask", "kept in Shedai, rarely used", "", "")]
    got = names.same_names(spark.createDataFrame(data, SCHEMA)).toPandas()
    assert sorted(got.id) == [1, 2] and got.grp.nunique() == 1


def test_unlike_words_are_not_compared_letter_by_letter(monkeypatch):
    seen = []
    monkeypatch.setattr(names, "distance", lambda a, b, d=names.distance: seen.append((a, b)) or d(a, b))
    a, b = ([("Works", "for", "Drouflunen"), ("from", "Jozeidour")], [("Since", "Kobeikkend"), ("Shoveltark", "branch")])
    assert names.descriptions_agree(a, b, {}, 9.0) == 0 and not seen
    assert names.within("peoran", "peorran", 1) and not names.within("peoran", "peorrann", 1) and names.within("abcd", "badc", 2)


@pytest.mark.parametrize("part", [3, 1 << 20])
def test_pairs_of_groups_against_brute_force(monkeypatch, part):
    monkeypatch.setattr(names, "PAIRS_AT_ONCE", part, raising=False)
    rnd = random.Random(5)
    rows = pd.DataFrame([(g, rnd.randrange(40), rnd.randrange(2), g % 3 == 0) for g in range(60) for _ in range(rnd.randrange(1, 7))], columns=["_group", "cls", "_block", "_cross"])
    expected = {(min(x.cls, y.cls), max(x.cls, y.cls)) for _, own in rows.groupby("_group") for x, y in itertools.combinations(own.itertuples(), 2) if x.cls != y.cls and not (x[4] and x[3] == y[3])}
    got = [tuple(r) for r in names._pairs(rows).to_numpy().tolist()]
    assert set(got) == expected and len(got) == len(expected)
    assert names._pairs(rows[:0]).empty


def brute_neighbours(vectors, k=5, least=0.9):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    out = set()
    for i, key in enumerate(ids):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= least)[:k]
        out |= {(key, j) for _, j in near}
    return out


@pytest.mark.parametrize("cap", [1024, 24])
def test_neighbours_recall_and_hot_cell(spark, monkeypatch, cap):
    monkeypatch.setattr(neighbours, "CELL_CAP", cap)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 64))
    vectors = {i: v for i, v in enumerate(base)}
    for i in range(100):
        vectors[1000 + i] = base[i] + rng.normal(size=64) * rng.uniform(0, 0.4)
    vectors |= {2000 + i: base[0] * (i + 1) for i in range(40)}  # one direction, many lengths
    rows = [(i, [float(x) for x in v], "c", "v") for i, v in vectors.items()]
    rows += [(5000, None, "", ""), (5001, [0.0] * 64, "", ""), (5002, [1.0] * 63, "", ""), (5003, [float("nan")] + [1.0] * 63, "", ""), (5004, [], "", ""), (None, [1.0] * 64, "", ""), rows[3]]
    got = neighbours.neighbours(spark.createDataFrame(rows, "id long, e array<float>, cls string, vec string"), "id", "e").collect()
    pairs, expected = {(r.id, r.neighbour_id) for r in got}, brute_neighbours({i: np.float32(v) for i, v in vectors.items()})
    assert len(pairs) == len(got) and len(pairs & expected) >= 0.9 * len(expected)
    assert max(r["rank"] for r in got) <= 5 and all(r.id != r.neighbour_id and r.id < 5000 for r in got)
    assert {r.neighbour_id for r in got if r.id == 2039} == {0, 2000, 2001, 2002, 2003}


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_of_unrelated_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "BLOCKS_PER_TASK", 3)
    rng = np.random.default_rng(5)
    vectors = {i: np.float32(v) for i, v in enumerate(rng.normal(size=(200, 64)))} | {300 + i: np.float32(np.eye(64)[i]) for i in range(9)} | {400 + i: np.float32(np.eye(64)[0] * (i + 2)) for i in range(8)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id long, e array<float>")
    got = {(r.id, r.neighbour_id) for r in neighbours.neighbours(df, "id", "e").collect()}
    assert got == brute_neighbours(vectors, least=-1)
    few = {i: vectors[i] for i in (0, 1, 2)}
    got = neighbours.neighbours(df.filter("id < 3"), "id", "e").collect()
    assert {(r.id, r.neighbour_id) for r in got} == brute_neighbours(few, least=-1) and len(got) == 6


@pytest.mark.parametrize("cap", [8192, 200])
def test_neighbours_in_a_dense_third(spark, monkeypatch, cap):
    monkeypatch.setattr(neighbours, "CELL_CAP", cap)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    m = np.float32(np.concatenate([rng.normal(size=(4000, 64)), centre + rng.normal(size=(2000, 64)) * 0.2]))
    vectors = dict(enumerate(m))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id long, e array<float>")
    got = {(r.id, r.neighbour_id) for r in neighbours.neighbours(df, "id", "e", min_cosine=0.9).collect()}
    expected = brute_neighbours(vectors)
    assert len(expected) == 10000 and len(got & expected) >= 0.999 * len(expected)


def test_cells_are_found_once(spark):
    m = np.float32(np.random.default_rng(8).normal(size=(3000, 64)))
    classes = neighbours.usable(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, e array<float>"), "id", "e")
    cells = neighbours._cells(classes, 3000)
    assert "MapInPandas" not in cells._jdf.queryExecution().toString()  # counting the cells and searching them read a table
    rows = cells.select("cell", "cls").collect()
    assert len(set(rows)) == len(rows) and {c for _, c in rows} == {r.cls for r in classes.collect()}


def test_pivots_where_no_row_has_a_low_hash(spark):
    unlucky = spark.range(1000).filter("pmod(xxhash64(id), 1000000) > 500000").limit(140).select(F.col("id").alias("cls"))
    vectors = {r.cls: v for r, v in zip(unlucky.collect(), np.float32(np.random.default_rng(11).normal(size=(140, 64))))}
    classes = spark.createDataFrame([(c, neighbours._packed(v[None])[0]) for c, v in vectors.items()], "cls long, vec binary")
    assert {(r.cell, r.cls) for r in neighbours._cells(classes, 140).collect()} == {(k, c) for k in range(2) for c in vectors}


def test_best_pivots_of_the_lists_that_are_looked_at():
    rng = np.random.default_rng(9)
    for count in (1, 2, 5, 400):
        pivots, unit = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in np.float32(rng.normal(size=(2, max(count, 300), 64))))
        own = neighbours._Pivots(pivots[:count])
        near = np.argsort(-(unit @ own.guides.T), axis=1)[:, : neighbours.GUIDES_OF_ROW]
        for row, guides, got in zip(unit, near, own.nearest(unit, 2)):
            seen = np.unique(np.concatenate([own.lists[g] for g in guides]))
            best = seen[np.argsort(-(pivots[seen] @ row))][:2]
            assert got.tolist() == [*best.tolist(), -1, -1][:2]


@pytest.mark.parametrize("blocks", [None, 2])
def test_collisions_against_a_plain_count(monkeypatch, blocks):
    monkeypatch.setattr(neighbours, "STEP", 5000)
    rng = np.random.default_rng(10)
    m = rng.normal(size=(120, 64))
    m = np.concatenate([m, *(m[i : i + 1] + rng.normal(size=(i % 9, 64)) * rng.uniform(0.02, 0.45) for i in range(60))])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    kind = np.arange(len(m)) if blocks is None else rng.integers(0, blocks, len(m)) * 7
    width = neighbours.HALF_WINDOW * np.sqrt(0.2)
    met = (np.abs((m @ neighbours._directions())[:, None] - (m @ neighbours._directions())[None]) <= width).sum(axis=2) >= neighbours.MATCHES
    s = (m @ m.T).round(12)
    expected = [set(sorted(np.flatnonzero(met[i] & (kind != kind[i]) & (s[i] >= 0.9)), key=lambda j: (-s[i, j], j))[:5]) for i in range(len(m))]
    i, j, _ = neighbours._k_best(5, *neighbours._by_collisions(m, kind, 5, 0.9))
    assert [set(j[i == x]) for x in range(len(m))] == expected and len(i) > 300


def test_vectors_with_null_elements_take_no_part(spark):
    rows = [(1, [1.0] * 64), (2, [None] + [1.0] * 63), (3, [float("inf")] + [1.0] * 63), (4, [2.0] * 64), (5, None), (6, [1.0] * 63)]
    got = neighbours.usable(spark.createDataFrame(rows, "id long, e array<float>"), "id", "e").collect()
    assert {r.id for r in got} == {1, 4} and len({r.cls for r in got}) == 1 and {len(r.vec) for r in got} == {256}


def test_no_vectors(spark):
    assert neighbours.neighbours(spark.createDataFrame([(1, None)], "id long, e array<float>"), "id", "e").collect() == []


def jaccard_pairs(texts, least=0.7):
    sets = {i: set(words(nearduplicates._MARK.sub(r"\1", t or ""))) for i, t in texts.items()}
    return {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


@pytest.mark.parametrize("rare", [512, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, rare):
    monkeypatch.setattr(nearduplicates, "RARE", rare)  # 2: nearly all words are frequent and meet in pairs
    monkeypatch.setattr(nearduplicates, "GROUP_CAP", 8)
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(220):
        w = rnd.sample(vocabulary, rnd.randrange(1, 25))
        if texts and rnd.random() < 0.6:
            w = words(rnd.choice(list(texts.values())))
            for _ in range(rnd.randrange(4)):
                w = w[:-1] if rnd.random() < 0.5 else [*w, rnd.choice(vocabulary)]
        texts[i] = " ".join(w)
    texts |= {500: None, 501: "", 502: "!!", 503: "[a::b] c d e f g", 504: "a c d e f g", 505: "x " * 5000}
    texts |= {600 + i: "all of these are one and the same text here" for i in range(30)}
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()] + [(0, texts[0], "c"), (None, "x", "c")], "id long, text string, cls string")
    links, members = nearduplicates.alike(df)
    got = {tuple(r) for r in nearduplicates.alike_pairs(links, members).collect()}
    assert got == jaccard_pairs(texts)
    groups = {r.id: r.grp for r in nearduplicates.alike_groups(links, members).collect()}
    assert all(groups[i] == groups[j] for i, j in got) and 500 not in groups and len({groups[600 + i] for i in range(30)}) == 1
    empty = nearduplicates.alike(df.limit(0))
    assert nearduplicates.alike_pairs(*empty).collect() == []


def test_pruning_limits_are_monotone():
    least = nearduplicates.least_matches()
    assert list(least) == sorted(least) and least[-1] < nearduplicates.HASHES * (1 + 0.7) / 2
