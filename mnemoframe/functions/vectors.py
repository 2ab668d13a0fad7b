"""Vector arithmetic on array columns, JVM-side; arrays are taken as doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a length is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(inner_product(a, b) / F.when(n == 0, 1.0).otherwise(n))


def parsed_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def is_vector(v: Column, dimensions: int) -> Column:
    """Has exactly so many finite values."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))


def mean_vector(df: DataFrame, keys: list[str], vec_col: str, weight_col: str | None = None) -> DataFrame:
    """keys and centroid: the (weighted) mean by position, from sums that are combined before the shuffle; weights of 0 or less count as 1."""
    w = F.when(F.col(weight_col) > 0, F.col(weight_col)).otherwise(1).cast("double") if weight_col else F.lit(1.0)
    parts = df.filter(F.col(vec_col).isNotNull()).select(*keys, w.alias("_w"), F.posexplode(vec_col).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def top_by_vector(df: DataFrame, vec_col: str, query: list[float], id_col: str, n: int, least: float | None = None) -> DataFrame:
    """The n rows with the largest inner product with one query vector, as id_col and score; ties go to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.filter(is_vector(F.col(vec_col), len(query))).select(id_col, F.round(inner_product(F.col(vec_col), q), 6).alias("score"))
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), id_col).limit(n)


#: What a matrix of queries may take in every task.
MOST_QUERY_BYTES = 1 << 28


def nearest_of_few(queries: DataFrame, items: DataFrame, k: int, least: float, most_queries: int = 100_000) -> DataFrame:
    """(query_id, item_id, score): of each query (query_id, query_vec) the k items (item_id, item_vec) of inner product >= least; ties go to the smaller id.

    For a stated set of at most most_queries queries, which goes to every task as one matrix; more raise an error, as the neighbour
    operator is made for them. Items pass in blocks, each giving its own k best, so that only these are shuffled.
    """
    asked = queries.limit(most_queries + 1).toPandas()
    if len(asked) > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    asked = [(q, np.asarray(v, np.float64)) for q, v in zip(asked["query_id"], asked["query_vec"]) if v is not None]
    if sum(v.nbytes for _, v in asked) > MOST_QUERY_BYTES:
        raise ValueError(f"more than {MOST_QUERY_BYTES} bytes of queries")
    held = items.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(v) for _, v in held.value}:
            own = [(q, v) for q, v in held.value if len(v) == n]
            by_size[n] = np.array([q for q, _ in own]), np.stack([v for _, v in own])
        for batch in batches:
            sizes = np.array([-1 if v is None else len(v) for v in batch["item_vec"]])
            for n, (ids, matrix) in by_size.items():
                part = batch[sizes == n]
                if not len(part):
                    continue
                key, m = part["item_id"].to_numpy(), np.stack([np.asarray(v, np.float64) for v in part["item_vec"]])
                for lo in range(0, len(ids), 1000):
                    score = matrix[lo : lo + 1000] @ m.T
                    score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6
                    q, i = np.nonzero(score >= least)
                    out = pd.DataFrame({"query_id": ids[lo + q], "item_id": key[i], "score": score[q, i]})
                    if len(out):
                        yield out.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    found = items.select("item_id", "item_vec").mapInPandas(run, "query_id long, item_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")
