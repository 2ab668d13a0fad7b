"""Full-text and hybrid retrieval: BM25 over an inverted index, rank fusion, and packing into a budget."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The usual constants of BM25 and of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


#: The ranges of CJK characters, each of which is a token by itself.
_CJK = "\\u3040-\\u30ff\\u3400-\\u9fff"
_TOKEN = re.compile(f"[{_CJK}]|(?:(?![{_CJK}])[^\\W_])+")
#: Parts of a stored index, by the hash of the term.
BUCKETS = 64


def tokens(text: Column) -> Column:
    """Lower-cased CJK characters and runs of other letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{_CJK}]|[\\p{{L}}\\p{{N}}&&[^{_CJK}]]+"), F.lit(0))


def stem(term: Column) -> Column:
    """A word without its English plural: -ies becomes -y, -es -e, and -s goes, but for words in which it is no ending."""
    return (
        F.when(term.rlike("[^ea]ies$"), F.regexp_replace(term, "ies$", "y")).when(term.rlike("[^aeo]es$"), F.regexp_replace(term, "s$", ""))
        .when(term.rlike("[^aeousi]s$"), F.regexp_replace(term, "s$", "")).otherwise(term)
    )


def _stemmed(term: str) -> str:
    for ending, cut, put in (("[^ea]ies$", "ies$", "y"), ("[^aeo]es$", "s$", ""), ("[^aeousi]s$", "s$", "")):
        if re.search(ending, term):
            return re.sub(cut, put, term)
    return term


class Index:
    """Inverted index of (id, text): postings (term, id, tf, dl), and the corpus' size and mean length.

    Only the postings of the asked terms take part in a search: the filter on term reaches the index, be it a plan or a stored table. With
    stemmed, English plurals count as their singulars. written() stores it, in parts by the hash of the term; read() opens a stored one.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, stemmed: bool = False) -> None:
        self.stemmed, self.stored = stemmed, False
        found = tokens(F.col(text_col))
        words = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), (F.transform(found, stem) if stemmed else found).alias("w"))
        self.lengths = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w")).alias("avgdl"))
        self.postings = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))

    @cached_property
    def statistics(self) -> tuple[int, float]:
        n, mean = self.lengths.first()
        return n, mean or 1.0

    def written(self, path: str) -> Index:
        """The same index as tables under path: postings in BUCKETS parts, each sorted by term, and one row of statistics."""
        parts = self.postings.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        parts.repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        self.lengths.withColumn("stemmed", F.lit(self.stemmed)).write.mode("overwrite").parquet(f"{path}/statistics")
        return Index.read(self.postings.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        out = cls.__new__(cls)
        out.postings, out.lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics")
        out.stemmed, out.stored = bool(out.lengths.select("stemmed").first()[0]), True
        out.lengths = out.lengths.drop("stemmed")
        return out

    def search(self, query: str, limit: int | None, keep: DataFrame | None = None) -> DataFrame:
        """(id, score), best first. A bare term may occur, +term must; keep (id) filters the found ones."""
        asked, must = set(), set()
        for plus, word in re.findall(r"(\+?)([^\s+]+)", query.lower()):
            own = {_stemmed(t) if self.stemmed else t for t in _TOKEN.findall(word)}
            asked |= own
            must |= own if plus else set()
        asked = sorted(asked)
        hits = self.postings.filter(F.col("term").isin(asked))
        if self.stored:  # of the parts of a stored index only those of the asked terms are read
            spark = self.postings.sparkSession
            parts = [r[0] for r in spark.createDataFrame([(t,) for t in asked], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int")).distinct().collect()] if asked else []
            hits = hits.filter(F.col("part").isin(parts))
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        scored = hits.join(F.broadcast(df), "term")  # df has one row a query term
        n_docs, mean = self.statistics
        idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        found = scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.when(F.col("term").isin(sorted(must)), 1)).alias("_must"))
        found = found.filter(F.col("_must") >= len(must)).select("id", "score")
        if keep is not None:
            found = found.join(keep.select(F.col(keep.columns[0]).alias("id")), "id", "left_semi")
        return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


def matched_entities(by_alias: DataFrame, by_vector: DataFrame, top_n: int = 5) -> DataFrame:
    """(entity_id, score): the best of entities found by their names (id, rank: each counts 1) and by their descriptions (id, score); the larger score counts, ties go to the names in order."""
    names = by_alias.select(F.col("id").alias("entity_id"), F.lit(1.0).alias("score"), F.col("rank").cast("long").alias("place"))
    vectors = by_vector.select(F.col("id").alias("entity_id"), F.col("score").cast("double").alias("score"), (F.lit(1_000_000) + F.row_number().over(Window.orderBy(F.desc("score"), "id"))).cast("long").alias("place"))
    best = names.unionByName(vectors).groupBy("entity_id").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    return best.orderBy(F.desc("score"), "place").limit(top_n).select("entity_id", "score")


def ranked(path: DataFrame, name: str, order: int) -> DataFrame:
    """A path (id, score) with its name, its place among the paths, and ranks from 1."""
    by = Window.orderBy(F.desc("score"), "id")  # paths are limited to a few rows before
    return path.select("id", "score", F.lit(name).alias("path"), F.lit(order).alias("path_order"), F.row_number().over(by).alias("rank"))


def fuse(paths: list[tuple[str, DataFrame]], top_k: int | None = None, k: int = RRF_K) -> DataFrame:
    """(id, score, source, pool_position): sum of 1/(k + rank) over the paths; source is the first path that has the id, whose place breaks ties."""
    every = None
    for order, (name, path) in enumerate(paths):
        one = ranked(path, name, order)
        every = one if every is None else every.unionByName(one)
    first = F.min(F.struct("path_order", "rank", "path"))
    pool = every.groupBy("id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"), first.alias("f"))
    pool = pool.select("id", "score", F.col("f.path").alias("source"), (F.col("f.path_order") * 1_000_000 + F.col("f.rank")).alias("pool_position"))
    return pool.orderBy(F.desc("score"), "pool_position").limit(top_k) if top_k else pool


def first_seen(paths: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, score, source): each id once, as the first path in order has it."""
    every = None
    for order, (name, path) in enumerate(paths):
        one = ranked(path, name, order)
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("id").agg(F.min(F.struct("path_order", "rank", "score", "path")).alias("f"))
    return best.select("id", F.col("f.score").alias("score"), F.col("f.path").alias("source"))


def overlap_score(query: str, text: Column) -> Column:
    """Shared over all words of query and text; the default ranking function where no model is at hand."""
    asked = F.array(*[F.lit(t) for t in sorted(set(_TOKEN.findall(query.lower())))]) if query else F.array().cast("array<string>")
    own = F.array_distinct(tokens(text))
    union = F.size(F.array_union(asked, own))
    return F.round(F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(asked, own)) / F.when(union == 0, 1).otherwise(union)), 6)


def rerank(pool: DataFrame, text_col: str, query: str, top_k: int, scorer=overlap_score) -> DataFrame:
    """pool with the scorer's score, the best top_k; if there is no scorer, the pool's first top_k with score 0."""
    if scorer is None:
        return pool.withColumn("score", F.lit(0.0)).orderBy("pool_position").limit(top_k)
    return pool.withColumn("score", scorer(query, F.col(text_col))).orderBy(F.desc("score"), "pool_position").limit(top_k)


def pack_skipping(items: Column, budget: int) -> Column:
    """Of array<struct<cost, ...>> in order those that still fit, going on past one that does not."""
    kind = "array<struct<cost:bigint,key:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(F.struct(x["cost"].cast("long").alias("cost"), x["key"].cast("long").alias("key"))))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def pack_prefix(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows of each group in order until the first that does not fit."""
    w = Window.orderBy(*order) if not keys else Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", total).filter(F.col("used") <= budget)


def capped(items: Column, leaf_cap: int = 3, mid_cap: int = 8, protected: Column | None = None) -> Column:
    """Of array<struct<id, leaf, mid>> in order those kept under at most leaf_cap of each leaf and mid_cap of each mid. Null keys pass, and ids in
    protected (an array) do, without counting."""
    kind = "array<struct<id:bigint,leaf:string,mid:string>>"

    def step(kept: Column, x: Column) -> Column:
        safe = F.array_contains(protected, x["id"].cast("long")) if protected is not None else F.lit(False)
        leaf_full = F.size(F.filter(kept, lambda q: q["leaf"] == x["leaf"])) >= leaf_cap
        mid_full = F.size(F.filter(kept, lambda q: q["mid"] == x["mid"])) >= mid_cap
        full = ~safe & ((x["leaf"].isNotNull() & leaf_full) | (x["mid"].isNotNull() & mid_full))
        key = lambda c: F.when(safe, F.lit(None)).otherwise(x[c]).alias(c)
        return F.when(full, kept).otherwise(F.concat(kept, F.array(F.struct(x["id"].cast("long").alias("id"), key("leaf"), key("mid")))))

    return F.aggregate(items, F.array().cast(kind), step)


def interleaved(lists: list[list], top_k: int) -> list:
    """From several ranked lists in turn the next one not yet taken, until top_k. The lists are short results on the driver."""
    out, seen, iters = [], set(), [iter(x) for x in lists]
    while iters and len(out) < top_k:
        going = []
        for it in iters:
            nxt = next((x for x in it if x not in seen), None)
            if nxt is None:
                continue
            going.append(it)
            seen.add(nxt)
            out.append(nxt)
            if len(out) == top_k:
                break
        iters = going
    return out
