"""Near-duplicate records with small edits.

Texts with the same set of words form a class and only one of each is compared. Candidates come from an exact prefix filter: two sets
that are alike enough share at least two words among the first few of a fixed order that puts rare words first. Candidates are
pruned the Bayesian way: MinHash values are compared some at a time, and a pair is dropped once the posterior probability that it
reaches the threshold is below a tolerance. What is left is verified exactly by the words.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.words import words
from mnemoframe.runtime import GROUP_CAP, blocked, checkpointed, components, over_groups

THRESHOLD = 0.7
#: Posterior probability of reaching the threshold under which a pair is dropped.
TOLERANCE = 1e-5
#: MinHash values of one bit each, compared STEP (one machine word) at a time: for a given number of bytes the most telling at high similarity.
HASHES, STEP = 256, 64
#: Words that the prefixes of two alike sets must share; the prefix is longer by as much.
SHARED = 2
#: Words that may count as frequent, and so be broadcast with their rank: 2**20 of 12 bytes are 12 MB.
FREQUENT_WORDS = 1 << 20
#: A word found in fewer records than this is never called frequent.
RARE = 512
_MARK = re.compile(r"\[([^\[\]]*?)::[^\[\]]*\]")


def word_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the words of text after each [raw::resolved] has become raw; empty for null."""
    if not text:
        return np.empty(0, np.int64)
    hashes = {xxhash.xxh3_64_intdigest(w) for w in words(_MARK.sub(r"\1", text))}
    return np.sort(np.array(list(hashes), np.uint64).view(np.int64))


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set HASHES bits, STEP in a word: one bit of the least image of the set under each of as many hash functions. Sets must have words."""
    a, b = _seeds()
    out = np.empty((len(sets), HASHES // 8), np.uint8)
    for lo in range(0, len(sets), 200):
        part = sets[lo : lo + 200]
        starts = np.cumsum([0, *(len(s) for s in part[:-1])])
        with np.errstate(over="ignore"):
            least = np.minimum.reduceat(np.concatenate(part).view(np.uint64)[:, None] * a[None, :] + b[None, :], starts, axis=0)
            least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[lo : lo + len(part)] = np.packbits((least >> np.uint64(63)).astype(np.uint8), axis=1)
    return out.view(np.uint64)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For STEP, 2*STEP, ... compared values the least number of matches that is not pruned.

    Under a uniform prior of the similarity s a bit matches with probability s + (1-s)/2; the posterior of s >= threshold given m
    matches of n is a ratio of two integrals, taken on a grid.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 2
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def _classes(facts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, c1, words) of each id with words; c1 hashes the whole set."""
    once = facts.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [word_set(t) for t in batch["text"]]
            sizes = np.array([len(s) for s in sets])
            out = pd.DataFrame({"id": batch["id"], "cls": [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], "words": sets})
            yield out[sizes > 0]

    return once.mapInPandas(run, "id long, cls long, words array<long>")


def _keys(reps: DataFrame, threshold: float, frequent: np.ndarray, rank: np.ndarray, bare: bool = False) -> DataFrame:
    """(key, cls, n, sig), or (key) of the keys that many sets may share if bare: the keys under which a set is compared: each rare word of its prefix, and each SHARED frequent ones together."""
    held = reps.sparkSession.sparkContext.broadcast((frequent, rank))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ranks = held.value
        for batch in batches:
            key, cls, size, sig = [], [], [], []
            sets = [np.asarray(w, np.int64) for w in batch["words"]]
            signed = None if bare or not sets else [m.tobytes() for m in minhashes(sets)]
            for at_row, (c, w) in enumerate(zip(batch["cls"], sets)):
                n = len(w)
                need = math.ceil(threshold * n - 1e-9)
                if need < SHARED:  # so few words that only the equal set is alike enough
                    continue
                at = np.searchsorted(known, w)
                is_known = (at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == w) if len(known) else np.zeros(n, bool)
                place = np.where(is_known, ranks[np.minimum(at, max(len(known) - 1, 0))] if len(known) else 0, -1)
                order = np.lexsort((w, place))[: n - need + SHARED]
                rare = order[place[order] < 0]
                common = np.sort(w[order[place[order] >= 0]])
                keys = [] if bare else w[rare].tolist()
                keys += [xxhash.xxh3_64_intdigest(np.array(t, np.int64).tobytes()) - 2**63 for t in itertools.combinations(common.tolist(), SHARED)]
                key += keys
                if bare:
                    continue
                cls += [c] * len(keys)
                size += [n] * len(keys)
                sig += [signed[at_row]] * len(keys)
            if bare:
                yield pd.DataFrame({"key": np.array(key, np.int64)})
                continue
            yield pd.DataFrame({"key": np.array(key, np.int64), "cls": np.array(cls, np.int64), "n": np.array(size, np.int32), "sig": sig})

    return reps.select("cls", "words").mapInPandas(run, "key long" if bare else "key long, cls long, n int, sig binary")


def _pairs_within(starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of each group, in chunks of at most about most pairs (one row of one group at least)."""
    ends = np.repeat(starts + sizes, sizes)
    first = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)]) if len(starts) else np.empty(0, int)
    left = ends - first - 1  # partners of each row: those after it in its group
    cum = np.cumsum(left)
    lo = 0
    while lo < len(first):
        base = cum[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cum, base + most, side="right")))
        n = left[lo:hi]
        i = np.repeat(first[lo:hi], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if len(i):
            yield i, j
        lo = hi


def _prune(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows["_group"].to_numpy()
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        more = sizes > 1
        n, cls = rows["n"].to_numpy(), rows["cls"].to_numpy()
        key, block, cross = rows["key"].to_numpy(), rows["_block"].to_numpy(), rows["_cross"].to_numpy()
        hashes = np.ascontiguousarray(np.frombuffer(b"".join(rows["sig"]), np.uint64).reshape(-1, HASHES // STEP).T)
        found = []
        for i, j in _pairs_within(starts[more], sizes[more]):
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (small >= threshold * large - 1e-9) & (key[i] == key[j]) & (cls[i] != cls[j]) & (~cross[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            matches = np.zeros(len(i), np.uint16)
            for step, limit in enumerate(least):
                matches += np.uint16(STEP) - np.bitwise_count(hashes[step][i] ^ hashes[step][j])
                ok = matches >= limit
                i, j, matches = i[ok], j[ok], matches[ok]
            if len(i):
                found.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return fn


def alike(facts: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: (a, b, similarity) of each two classes of different word sets with |A and B| / |A or B| >= threshold, a < b;
    members: (id, cls) of every id that has words.

    Texts with equal word sets are one class, so copies, however many, are compared once. Copies of an id count once; of differing rows of
    an id each counts. Null, blank and wordless texts belong to no class. No word, key or group is capped: groups over GROUP_CAP rows
    are compared block by block. A true pair is lost with a probability of about the tolerance.
    """
    members = checkpointed(_classes(facts, id_col, text_col))
    reps = checkpointed(members.groupBy("cls").agg(F.first("words").alias("words")))
    counts = reps.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > RARE)
    counts = checkpointed(counts)
    total = counts.agg(F.sum("df")).first()[0] or 0
    limit = max(RARE, total // FREQUENT_WORDS)  # more than limit times: at most FREQUENT_WORDS words
    top = counts.filter(F.col("df") > limit).toPandas()
    top = top.sort_values(["df", "w"]).reset_index(drop=True)
    rank = np.arange(len(top), dtype=np.int32)
    order = np.argsort(top["w"].to_numpy(np.int64)) if len(top) else np.empty(0, int)
    known = top["w"].to_numpy(np.int64)[order], rank[order]
    keys = _keys(reps, threshold, *known)
    # a rare word's key has at most limit rows, so only pairs of frequent words can be hot
    counted = _keys(reps, threshold, *known, bare=limit <= GROUP_CAP)
    survivors = over_groups(blocked(keys, "key", "cls", GROUP_CAP, counted), "_group", _prune(threshold, tolerance), "a long, b long").distinct()
    both = survivors.join(reps.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a").join(reps.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    similarity = common / (F.size("wa") + F.size("wb") - common)
    links = both.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
    return links, members.select("id", "cls").distinct()


def alike_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of ids, those of one class and those of linked classes."""
    links = checkpointed(links.select("a", "b"))
    a, b = members.select(F.col("id").alias("x"), F.col("cls").alias("a")), members.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    across = links.join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    both = across.unionByName(within).filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def alike_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, grp, n_links): each id with the smallest id of its group, groups being closed under links, and the number of classes linked to its own."""
    links = checkpointed(links.select("a", "b"))
    every = members.select("cls").distinct()
    comp = components(links.unionByName(every.select(F.col("cls").alias("a"), F.col("cls").alias("b"))))
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
    placed = members.join(comp.withColumnRenamed("id", "c_id"), F.col("cls") == F.col("c_id"))
    name = placed.groupBy("comp").agg(F.min("id").alias("grp"))
    return placed.join(name, "comp").join(degree, F.col("cls") == F.col("c"), "left").groupBy("id").agg(F.min("grp").alias("grp"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"))
