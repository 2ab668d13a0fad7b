import datetime as dt
import random

import pytest

from mnemoframe.operators.hierarchy import descendant_counts, descendants, hierarchy

SCHEMA = "id long, parent_id long, created_at timestamp_ntz, depth string, path string"
T = dt.datetime(2024, 1, 1)


def walk(parent):
    out = {}
    for i in parent:
        seen, x = [], i
        while x not in seen and parent[x] is not None and parent[x] in parent:
            seen.append(x)
            x = parent[x]
        out[i] = (-1, None, []) if x in seen else (x, len(seen), [*seen, x][::-1])
    return out


def found(df):
    return {r.id: (r.root_id, r.depth, list(r.path)) for r in df.collect()}


def rows(parent):
    return [(i, p, T, "clash", "clash") for i, p in parent.items()]


@pytest.mark.parametrize("fragment_rows", [None, 7, 40])
def test_random_forests_with_circles(spark, fragment_rows):
    rnd = random.Random(3)
    parent = {i: rnd.choice([None, rnd.randrange(300), rnd.randrange(300), 10_000 + i]) for i in range(300)}
    parent |= {i: i - 1 for i in range(401, 500)} | {400: None, 600: 601, 601: 600, 602: 601, 603: 603}
    got = hierarchy(spark.createDataFrame(rows(parent), SCHEMA), with_paths=True, fragment_rows=fragment_rows)
    assert found(got) == walk(parent)


def test_latest_row_holds_and_copies_count_once(spark):
    data = [(1, None, T, "a", "b"), (1, None, T, "a", "b"), (2, 1, T + dt.timedelta(1), "", ""), (2, 9, T, "", ""), (None, 1, T, "", ""), (3, 2, None, None, None)]
    assert found(hierarchy(spark.createDataFrame(data, SCHEMA), with_paths=True)) == {1: (1, 0, [1]), 2: (1, 1, [1, 2]), 3: (1, 2, [1, 2, 3])}


def test_descendants(spark):
    paths = hierarchy(spark.createDataFrame(rows({1: None, 2: 1, 3: 2, 4: 1, 5: 6, 6: 5}), SCHEMA), with_paths=True)
    assert {tuple(r) for r in descendants(paths).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}
    assert dict(map(tuple, descendant_counts(paths).collect())) == {1: 3, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA), with_paths=True).collect() == []


def test_ids_beyond_floats(spark):
    top = 2**62
    nodes = spark.createDataFrame([(top + i, top + i - 1 if i else None, 1) for i in range(6)], "id long, parent_id long, created_at int")
    assert {tuple(r) for r in hierarchy(nodes).collect()} == {(top + i, top, i) for i in range(6)}
