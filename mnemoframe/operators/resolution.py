"""Entity resolution in layers: exact names, MinHash bands, then a pluggable decision, with vetoes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.runtime import blocked, checkpointed, over_groups

#: Hash functions, their band width, and the similarity from which names are the same.
SEEDS, BAND, SIMILAR = 32, 4, 0.9


def shingled(names: DataFrame, id_col: str = "id", name_col: str = "canonical_ref") -> DataFrame:
    """(id, task_id, name, shingles)."""
    return names.select(F.col(id_col).alias("id"), "task_id", F.col(name_col).alias("name"), X.shingles(X.fuzzy_name(F.col(name_col))).alias("shingles"))


def signed(names: DataFrame) -> DataFrame:
    """names with signature; those without shingles are left out."""
    return checkpointed(names.filter(F.size("shingles") > 0).withColumn("signature", X.minhash_signature(F.col("shingles"), SEEDS)))


def entropy_rejected(name: Column) -> Column:
    """Names too short or too even for similarity to say anything."""
    short = (F.length(name) < 6) & (F.size(F.split(F.trim(name), r"\s+")) < 2)
    return short | (X.char_entropy(F.lower(name)) < 1.5)


def _bands(names: DataFrame, side: str, *more: str) -> DataFrame:
    """(side, key, *more): names under each of their bands, within their task."""
    band = F.transform(F.sequence(F.lit(0), F.lit(SEEDS // BAND - 1)), lambda b: F.xxhash64(F.col("task_id"), b, F.slice("signature", b * BAND + 1, BAND)))
    return names.select(F.col("id").alias(side), F.explode(band).alias("key"), *more)


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of ids of each group, those of differing kinds only (kind 2 goes with all)."""
    out = []
    group = rows["_group"].to_numpy()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ids, kind, block, cross = (rows[c].to_numpy() for c in ("id", "kind", "_block", "_cross"))
    for s, e in zip(starts, np.r_[starts[1:], len(group)]):
        i, j = np.triu_indices(e - s, 1)
        i, j = i + s, j + s
        ok = (ids[i] != ids[j]) & ((kind[i] != kind[j]) | (kind[i] == 2)) & (~cross[i] | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        swap = np.where(kind[i] == 2, ids[i] > ids[j], kind[i] > kind[j])
        out.append(np.stack([np.where(swap, ids[j], ids[i]), np.where(swap, ids[i], ids[j])], axis=1))
    found = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def _pairs_of_bands(bands: DataFrame) -> DataFrame:
    """(a, b): ids that share a band, however many do: a band over the cap is compared block by block."""
    several = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return over_groups(blocked(checkpointed(bands.join(several, "key", "left_semi")), "key", "id", 1024), "_group", _met, "a long, b long").distinct()


def banded_pairs(names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(id_a, id_b, similarity): names of a task that share a band of their signatures and are similar enough."""
    pairs = _pairs_of_bands(_bands(names, "id").withColumn("kind", F.lit(2)))
    s = names.select("id", "shingles")
    both = pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).join(s.select(F.col("id").alias("id_a"), F.col("shingles").alias("sa")), "id_a").join(s.select(F.col("id").alias("id_b"), F.col("shingles").alias("sb")), "id_b")
    return both.select("id_a", "id_b", X.jaccard(F.col("sa"), F.col("sb")).alias("_s")).filter(F.col("_s") >= least).select("id_a", "id_b", F.round("_s", 6).alias("similarity"))


def exact_layer(entities: DataFrame) -> DataFrame:
    """(task_id, name, n, verdict): entities of one normalised name; more than one make it ambiguous."""
    n = entities.groupBy("task_id", X.normalized_name(F.col("canonical_ref")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("verdict", F.when(F.col("n") == 1, "merge").otherwise("ambiguous"))


def best_similar(new: DataFrame, known: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(id, target): for signed new names the most similar signed known one of the task, ties going to the smaller id."""
    # ids of both sides may be equal: those of known ones are marked by their sign
    bands = _bands(new, "id").withColumn("kind", F.lit(0)).unionByName(_bands(known.withColumn("id", -F.col("id") - 1), "id").withColumn("kind", F.lit(1)))
    met = _pairs_of_bands(bands).select(F.col("a").alias("n"), (-F.col("b") - 1).alias("k"))
    met = met.join(new.select(F.col("id").alias("n"), F.col("shingles").alias("s_n")), "n").join(known.select(F.col("id").alias("k"), F.col("shingles").alias("s_k")), "k")
    scored = met.select("n", "k", X.jaccard(F.col("s_n"), F.col("s_k")).alias("j")).filter(F.col("j") >= least)
    return scored.groupBy(F.col("n").alias("id")).agg(F.min(F.struct((-F.col("j")).alias("j"), "k")).alias("b")).select("id", F.col("b.k").alias("target"))


def resolve(new: DataFrame, known: DataFrame, decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, action, target): new names (id, task_id, name) merged with known entities (id, task_id, name, maybe aliases and desc) or created.

    An exact name of one entity merges, of several asks decide with all of them; then, of names with enough in them, a similar one merges; decide gets
    (id, target) candidates and may return (id, target) to keep, default none. Merges of names that cannot be one are turned into creations.
    """
    k = known.select(F.col("id").alias("target"), "task_id", F.col("name").alias("k_name"))
    exact = new.select("id", "task_id", F.col("name").alias("n_name")).join(k, (X.normalized_name(F.col("n_name")) == X.normalized_name(F.col("k_name"))) & (new["task_id"] == k["task_id"])).select("id", "target").distinct()
    exact = checkpointed(exact)
    hits = exact.groupBy("id").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n"))
    sure = hits.filter("n = 1").select("id", "target")
    unsure = exact.join(hits.filter("n > 1").select("id"), "id", "left_semi")
    rest = new.join(hits.select("id"), "id", "left_anti").filter(~entropy_rejected(X.fuzzy_name(F.col("name"))))
    similar = best_similar(signed(shingled(rest, "id", "name")), signed(shingled(known, "id", "name")))
    decided = decide(unsure).groupBy("id").agg(F.min("target").alias("target")) if decide else unsure.limit(0)
    merges = sure.unionByName(similar).unionByName(decided)
    more = [c for c in ("aliases", "desc") if c in known.columns]
    named = merges.join(new.select("id", F.col("name").alias("n_name")), "id").join(known.select(F.col("id").alias("target"), F.col("name").alias("k_name"), *more), "target")
    conflict = X.identity_conflict(F.col("n_name"), F.col("k_name"), F.col("aliases") if "aliases" in more else None, F.col("desc") if "desc" in more else None)
    allowed = named.filter(~conflict).select("id", "target")
    return new.select("id").join(allowed, "id", "left").select("id", F.when(F.col("target").isNull(), "create").otherwise("merge").alias("action"), "target")


def canonical(aliases: DataFrame, choose: Callable[[list[str], str | None], tuple[str, str | None]] | None = None, most_words: int = 60) -> DataFrame:
    """(entity_id, canonical_ref, desc) of entities (entity_id, names, desc): a hook chooses among the names and shortens the description.

    By default the longest name, the first of several; a choice that is no name of the entity, or a description over most_words, leaves what was.
    """
    fallback = F.when(F.size("names") > 0, F.array_sort("names", lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).when(x < y, -1).when(x > y, 1).otherwise(0))[0])
    if choose is None:
        return aliases.select("entity_id", fallback.alias("canonical_ref"), "desc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, names, desc, first in zip(batch["entity_id"], batch["names"], batch["desc"], batch["first"]):
                name, new = choose(list(names), desc)
                rows.append((key, name if name in set(names) else first, new if new and len(new.split()) <= most_words else desc))
            yield pd.DataFrame(rows, columns=["entity_id", "canonical_ref", "desc"])

    return aliases.withColumn("first", fallback).select("entity_id", "names", "desc", "first").mapInPandas(run, "entity_id string, canonical_ref string, desc string")
