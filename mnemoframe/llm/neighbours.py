"""The most similar vectors of every vector, by cosine.

Without a least cosine every vector is compared with every other, block by block: unrelated vectors of 64 dimensions have no structure
that a search could skip by. With one, the table is sharded by pivots drawn from the data, each vector in several cells, as a window of the
least cosine on a random direction holds a third of all unrelated vectors. In every cell the search counts collisions: the rows stand
in single-projection sorted arrays, windows around each query are widened by virtual rehashing, and what collides in enough of the arrays is
verified. Pivots that lie close together share a cell, so that a crowd of vectors is not scattered over many.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.runtime import blocked, checkpointed, over_groups, partitions_for

DIMENSIONS = 64
NEIGHBOURS, MIN_COSINE = 5, 0.9
#: Sets of pivots and cells of each set that a vector goes to. Pivots are a sample of at most MOST_PIVOTS vectors a set, by hash.
#: They stand in two tiers: a vector looks at the pivots of its nearest guides only, so the work of a row grows with the square root of their number.
PIVOT_SETS, CELLS, MOST_PIVOTS, ROWS_PER_PIVOT = 2, 2, 1 << 16, 150
GUIDES_OF_PIVOT, GUIDES_OF_ROW = 3, 8
#: Sorted arrays of a cell, windows in which a candidate must lie, and their half width for a radius of 1. Of vectors at just the radius 95 % lie in one
#: window, so that less than one in two thousand misses the count; closer ones miss it less.
PROJECTIONS, MATCHES, HALF_WINDOW = 24, 19, 2.0
#: Pivots of a set with this cosine or more are one cell.
JOINED = 0.7
#: Rows of one task's group; larger cells are compared block by block.
CELL_CAP = 8192
#: Pairs of a query and a row whose collisions are counted at once, so that the counts stay in the processor's cache.
STEP = 1 << 16
#: Rows of a block where all are compared with all, and blocks that one task goes over.
BLOCK, BLOCKS_PER_TASK = 4096, 32
#: How far a cosine of float32 may be off.
_FLOAT32 = 4e-6


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, cls, vec): rows whose vector has exactly 64 finite values, not all zero. vec holds them as float32; equal directions have equal cls."""
    rows = table.filter(F.col(id_col).isNotNull() & (F.size(vec_col) == DIMENSIONS)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = np.concatenate(batch["v"].to_list()).astype(np.float64).reshape(-1, DIMENSIONS)
            ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            raw, ids = m[ok], batch["id"].to_numpy()[ok]
            m = raw / np.abs(raw).max(axis=1, keepdims=True)
            unit = np.rint(m / np.linalg.norm(m, axis=1, keepdims=True) * 1e5).astype(np.int32)
            yield pd.DataFrame({"id": ids, "cls": np.array([xxhash.xxh3_64_intdigest(u) - 2**63 for u in _row_bytes(unit)], np.int64), "vec": _packed(raw)})

    return rows.mapInPandas(run, "id long, cls long, vec binary")


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row of float32 as bytes, all first bytes, then all second ones and so on: vectors of few digits compress well that way."""
    return _row_bytes(rows.astype(np.float32).view(np.uint8).reshape(-1, DIMENSIONS, 4).transpose(0, 2, 1))


def _row_bytes(rows: np.ndarray) -> list[bytes]:
    """The bytes of each row, cut out of those of all."""
    all_bytes = rows.tobytes()
    size = len(all_bytes) // max(1, len(rows))
    return [all_bytes[lo : lo + size] for lo in range(0, len(all_bytes), size)] if size else []


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Packed vectors as float64 rows of length 1."""
    planes = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, 4, DIMENSIONS)
    m = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.float32).reshape(-1, DIMENSIONS).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _merged(pivots: np.ndarray, part: int = 512) -> np.ndarray:
    """For each pivot the least number of those that it is linked to by cosines of JOINED or more."""
    pairs = [np.nonzero(pivots[lo : lo + part] @ pivots.T >= JOINED) for lo in range(0, len(pivots), part)]
    x, y = np.concatenate([i + lo for (i, _), lo in zip(pairs, range(0, len(pivots), part))]), np.concatenate([j for _, j in pairs])
    label = np.arange(len(pivots))
    while (label[x] != label[y]).any():
        np.minimum.at(label, x, label[y])
    return label


class _Pivots:
    """Pivots of one set in two tiers: guides, each with the pivots that have it among their nearest GUIDES_OF_PIVOT guides."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots, self.label = pivots, _merged(pivots)
        self.guides = pivots[: math.isqrt(len(pivots) - 1) + 1]
        own = self._best(pivots @ self.guides.T, GUIDES_OF_PIVOT)
        self.lists = [np.flatnonzero((own == g).any(axis=1)) for g in range(len(self.guides))]

    @staticmethod
    def _best(s: np.ndarray, n: int) -> np.ndarray:
        """Columns of the n largest of each row."""
        n = min(n, s.shape[1])
        return np.argpartition(s, -n, axis=1)[:, -n:]

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """For each row the n best pivots among the lists of its nearest GUIDES_OF_ROW guides; -1 where there are fewer."""
        near = self._best(unit @ self.guides.T, GUIDES_OF_ROW)
        by_guide = np.argsort(near, axis=None, kind="stable")
        bounds = np.searchsorted(near.ravel()[by_guide], np.arange(len(self.guides) + 1))
        found, value = np.full((*near.shape, n), -1), np.full((*near.shape, n), -2.0, np.float32)
        for members, lo, hi in zip(self.lists, bounds, bounds[1:]):
            if lo == hi or not len(members):
                continue
            rows, place = np.divmod(by_guide[lo:hi], near.shape[1])
            s = unit[rows] @ self.pivots[members].T
            for t, (best, cosine) in enumerate(_largest(s, min(n, len(members)))):
                found[rows, place, t], value[rows, place, t] = members[best], cosine
        found, value = found.reshape(len(unit), -1), value.reshape(len(unit), -1)
        kept = np.full((len(unit), n), -1)
        for t in range(n):
            kept[:, t] = found[np.arange(len(unit)), value.argmax(axis=1)]
            value[found == kept[:, t, None]] = -3  # a pivot may stand in several lists
            found[value == -3] = -1
        return kept


def _largest(s: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns and values of the largest of each row, then of the next, n times; s is used up."""
    rows = np.arange(len(s))
    for _ in range(n):
        best = s.argmax(axis=1)
        yield best, s[rows, best]
        s[rows, best] = -3


def _cells(classes: DataFrame, n: int) -> DataFrame:
    """(cell, cls, vec): each class in the cells of its CELLS nearest pivots of each set. Cells are found once and written, as they are read to be counted and to be searched."""
    per_set = int(min(MOST_PIVOTS, max(1, n // ROWS_PER_PIVOT)))
    # three times as many as needed are kept by hash, so that tasks do not each send a full sample to the driver
    share = min(1.0, 3 * per_set * PIVOT_SETS / n)
    hashed = classes.select("vec", F.xxhash64("cls").alias("h"))
    sample = hashed.filter(F.pmod("h", F.lit(1_000_000)) < math.ceil(share * 1_000_000)).orderBy("h").limit(per_set * PIVOT_SETS).toPandas()
    if len(sample) < min(n, per_set * PIVOT_SETS):  # of a few rows none may have such a hash
        sample = hashed.orderBy("h").limit(per_set * PIVOT_SETS).toPandas()
    pivots = _matrix(sample["vec"]).astype(np.float32)
    sets = [pivots[k::PIVOT_SETS][: max(1, len(pivots) // PIVOT_SETS)] for k in range(min(PIVOT_SETS, len(pivots)))]
    held = classes.sparkSession.sparkContext.broadcast([_Pivots(own) for own in sets])
    columns = [f"_c{i}" for i in range(len(sets) * CELLS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _matrix(batch["vec"]).astype(np.float32)
            near = [np.where(best >= 0, own.label[best] * PIVOT_SETS + k, -1) for k, own in enumerate(held.value) for best in own.nearest(unit, CELLS).T]
            yield batch.assign(**dict(zip(columns, near)))

    found = checkpointed(classes.select("cls", "vec").mapInPandas(run, f"cls long, vec binary, {', '.join(f'{c} long' for c in columns)}"))
    return found.select(F.explode(F.array_distinct(F.array(*columns))).alias("cell"), "cls", "vec").filter("cell >= 0")


def _k_best(k: int, row: np.ndarray, other: np.ndarray, cosine: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row the k entries with the largest cosine; ties go to the smaller other. Sorted by row."""
    order = np.lexsort((other, -cosine, row))
    kept = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
    return tuple(x[kept] for x in (row, other, cosine, *more))


def _nearest(queries: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray, apart: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine), among them the k best rows of every query that reach its least cosine. apart tells which rows do not count."""
    small_q, small_r = queries.astype(np.float32), rows.astype(np.float32)
    found = []
    for lo in range(0, len(queries), 256):
        part = slice(lo, lo + 256)
        s = small_q[part] @ small_r.T
        if apart is not None:
            s[apart(part)] = -3
        limit = (least[part] - _FLOAT32).astype(np.float32)
        hit = s >= limit[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
        if len(many) and s.shape[1] > k:  # the k-th best of some of the rows is a bound too
            bound = np.partition(s[many, : max(1024, k + 1)], -k, axis=1)[:, -k] - np.float32(2 * _FLOAT32)
            hit[many] = s[many] >= np.maximum(limit[many], bound)[:, None]
        i, j = np.nonzero(hit)
        i += lo
        cosine = np.einsum("ij,ij->i", queries[i], rows[j]).round(12)
        ok = cosine >= least[i]
        found.append((i[ok], j[ok], cosine[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(20240611).standard_normal((DIMENSIONS, PROJECTIONS))


class _SortedArrays:
    """The rows of one cell in PROJECTIONS sorted arrays, one for each random direction; windows around a query are cut out of each."""

    def __init__(self, unit: np.ndarray) -> None:
        at = (unit @ _directions()).T
        order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, order, axis=1)
        self.rank = np.empty(at.shape, np.uint16)  # a group has at most 2 * CELL_CAP rows
        np.put_along_axis(self.rank, order, np.arange(len(unit), dtype=np.uint16)[None], axis=1)

    def windows(self, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """For each array and row: first place and number of places of its window of HALF_WINDOW * radius to each side. The edges are looked up in sorted order."""
        first = np.array([x.searchsorted(x - HALF_WINDOW * radius) for x in self.sorted], np.uint16)
        end = np.array([x.searchsorted(x + HALF_WINDOW * radius, side="right") for x in self.sorted], np.uint16)
        return tuple(np.take_along_axis(x, self.rank, axis=1) for x in (first, end - first))

    def colliding(self, queries: np.ndarray, windows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each query (a row's index) which rows lie in its windows in at least MATCHES of the arrays."""
        shape = len(queries), self.rank.shape[1]
        count, place, inside = np.zeros(shape, np.uint8), np.empty(shape, np.uint16), np.empty(shape, bool)
        for rank, first, width in zip(self.rank, windows[0][:, queries, None], windows[1][:, queries, None]):
            np.less(np.subtract(rank, first, out=place), width, out=inside)  # unsigned: what is before the window is far behind it
            np.add(count, inside.view(np.uint8), out=count)
        return count >= MATCHES


def _by_collisions(unit: np.ndarray, kind: np.ndarray, k: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine), among them the k nearest of every row that reach min_cosine. Rows of the same kind are not compared.

    Virtual rehashing: windows begin with half the widest radius, and a query goes on to the widest unless k rows of the smaller radius are
    verified, which no row outside of it can beat.
    """
    arrays, small = _SortedArrays(unit), unit.astype(np.float32)
    kind = np.unique(kind, return_inverse=True)[1].astype(np.uint16)
    widest = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    found, pending = [], np.arange(len(unit))
    step = max(16, STEP // len(unit))
    for radius in (widest / 2, widest):
        windows, undone = arrays.windows(radius), [np.empty(0, np.int64)]
        for queries in np.split(pending, range(step, len(pending), step)):
            hit = arrays.colliding(queries, windows)
            hit &= kind[queries][:, None] != kind
            at = np.flatnonzero(hit)
            if 32 * len(at) > hit.size:  # a crowd: the same cosines by one product
                i, j, cosine = _nearest(unit[queries], unit, k, np.full(len(queries), min_cosine - 1e-9), lambda part, hit=hit: ~hit[part])
            else:
                i, j = np.divmod(at, len(unit))
                cosine = np.einsum("ij,ij->i", small[queries[i]], small[j])
                ok = cosine >= min_cosine - 1e-9 - _FLOAT32
                i, j = i[ok], j[ok]
                cosine = np.einsum("ij,ij->i", unit[queries[i]], unit[j]).round(12)
                ok = cosine >= min_cosine - 1e-9
                i, j, cosine = i[ok], j[ok], cosine[ok]
            done = np.bincount(i[cosine >= 1 - radius * radius / 2], minlength=len(queries)) >= k
            final = done[i] | (radius == widest)
            found.append((queries[i[final]], j[final], cosine[final]))
            undone.append(queries[~done])
        pending = np.concatenate(undone)
        if not len(pending):
            break
    return tuple(np.concatenate(x) for x in zip(*found))


def _in_cells(k: int, min_cosine: float):
    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        group, cls, block, cross, cell = (rows[c].to_numpy() for c in ("_group", "cls", "_block", "_cross", "cell"))
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])])
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for s, e in zip(starts, np.r_[starts[1:], len(group)]):
            if e - s < 2:
                continue
            own = cls[s:e]
            i, j, cosine = _by_collisions(_matrix(rows["vec"].iloc[s:e]), block[s:e] if cross[s] else own, k, min_cosine)
            found.append(_k_best(k, own[i], own[j], cosine))
        a, b, cosine = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a, "b": b, "cosine": cosine}).drop_duplicates(["a", "b"])

    return fn


def _all_with_all(asked: DataFrame, n_asked: int, classes: DataFrame, n: int, k: int) -> DataFrame:
    """(a, b, cosine): the k nearest other classes of each asked one, ties by their first ids; n_asked * n cosines."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield pd.DataFrame({"at": [int(rows["cls"].iloc[0])], "cls": [rows["cls"].to_numpy(np.int64).tobytes()], "first": [rows["first"].to_numpy(np.int64).tobytes()], "vecs": [b"".join(rows["vec"])]})

    def packed(rows: DataFrame, size: int) -> DataFrame:
        return checkpointed(rows.select("cls", "first", "vec").repartition(partitions_for(size, BLOCK), "cls").mapInPandas(pack, "at long, cls binary, first binary, vecs binary"))

    blocks = packed(classes, n)
    others = blocks.select(F.col("cls").alias("r_cls"), F.col("first").alias("r_first"), F.col("vecs").alias("r_vecs")).repartition(partitions_for(partitions_for(n, BLOCK), BLOCKS_PER_TASK))
    if asked is not classes:
        blocks = packed(asked, n_asked)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        none = np.empty(0, np.int64)
        for batch in batches:
            for at, cls, vecs, r_cls, r_first, r_vecs in zip(*(batch[c] for c in ("at", "cls", "vecs", "r_cls", "r_first", "r_vecs"))):
                if at not in best:
                    q = _matrix([vecs])
                    best[at] = (cls, q, np.full(len(q), -2.0), (none, none, np.empty(0), none))
                cls, q, least, kept = best[at]
                a, b = np.frombuffer(cls, np.int64), np.frombuffer(r_cls, np.int64)
                own = (lambda part, a=a, b=b: a[part][:, None] == b[None]) if len(np.intersect1d(a, b)) else None
                i, j, cosine = _nearest(q, _matrix([r_vecs]), k, least, own)
                new = (i, np.frombuffer(r_first, np.int64)[j], cosine, np.frombuffer(r_cls, np.int64)[j])
                kept = _k_best(k, *(np.concatenate(x) for x in zip(kept, new)))
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(q)) == k)
                least[full] = kept[2][np.searchsorted(kept[0], full, side="right") - 1]
                best[at] = (cls, q, least, kept)
        for at, (cls, _, _, (row, *rest)) in best.items():
            yield pd.DataFrame({"at": [at], **{c: [x.tobytes()] for c, x in zip(columns, (np.frombuffer(cls, np.int64)[row], *rest))}})

    columns = {"a": np.int64, "first": np.int64, "cosine": np.float64, "b": np.int64}

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        kept = _k_best(k, *(np.frombuffer(b"".join(parts[c]), kind) for c, kind in columns.items()))
        return pd.DataFrame(dict(zip(columns, kept)))[["a", "b", "cosine"]]

    met = blocks.repartition(partitions_for(n_asked, BLOCK)).crossJoin(others).select("at", "cls", "vecs", "r_cls", "r_first", "r_vecs").mapInPandas(compare, "at long, a binary, first binary, cosine binary, b binary")
    return over_groups(met, "at", merge, "a long, b long, cosine double")


def neighbours(table: DataFrame, id_col: str, vec_col: str, k: int = NEIGHBOURS, min_cosine: float | None = None, every: int = 1) -> DataFrame:
    """(id, neighbour_id, cosine, rank): for every usable vector its k most similar other ids, or those with a cosine of min_cosine or more.

    Ties go to the smaller id; rank is from 1. Usable are exactly 64 finite values, not all zero, of any length; other rows and null ids
    take no part; copies of an id count once. Vectors of equal direction (to five digits) are one class and compared once, however
    many: of a class only the k+1 smallest ids can be among anyone's nearest. Without min_cosine the result is exact, at a cost that grows
    with the square of the classes. With it a pair may be missed; what is given is exact. Recall is measured in the tests and in the README.
    every > 1 takes as queries the ids that it divides, searched among all rows, and so may not be joined with min_cosine.
    """
    if every > 1 and min_cosine is not None:
        raise ValueError("a search by least cosine takes all rows as queries")
    base = usable(table, id_col, vec_col)
    classes = checkpointed(base.groupBy("cls").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("first")))
    members = checkpointed(base.select("id", "cls").distinct())
    n = classes.count()
    spark = table.sparkSession
    if not n:
        return spark.createDataFrame([], "id long, neighbour_id long, cosine double, rank int")
    if min_cosine is None:
        asked = classes if every == 1 else checkpointed(classes.join(members.filter(F.col("id") % every == 0).select("cls").distinct(), "cls", "left_semi"))
        found = _all_with_all(asked, n if every == 1 else asked.count(), classes, n, k)
    else:
        found = over_groups(blocked(_cells(classes, n), "cell", "cls", CELL_CAP), "_group", _in_cells(k, min_cosine), "a long, b long, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    verified = checkpointed(found)
    by_id = Window.partitionBy("cls").orderBy("id")
    least = members.withColumn("_r", F.row_number().over(by_id)).filter(F.col("_r") <= k + 1).select("cls", "id")
    near = verified.join(least.select(F.col("cls").alias("b"), F.col("id").alias("neighbour_id")), "b").select("a", "neighbour_id", "cosine")
    own = least.select(F.col("cls").alias("a"), F.col("id").alias("neighbour_id"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour_id")
    lists = near.unionByName(own).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    each = members.filter(F.col("id") % every == 0).join(lists, F.col("cls") == F.col("a")).filter("id <> neighbour_id")
    last = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour_id")
    return each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("id", "neighbour_id", "cosine", "rank")
