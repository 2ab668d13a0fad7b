"""What every operator shares: table access, lineage cuts, skew handling and work on sorted groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows of one group that one task may hold at once; larger groups are cut into blocks and compared block by block.
GROUP_CAP = 4096
#: Hot keys (16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one if all runs in this one process (as in tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    if spark not in _TEMPORARY:
        _TEMPORARY[spark] = tempfile.mkdtemp(prefix="mnemoframe-")
    return "file://" + _TEMPORARY[spark]


_TEMPORARY: dict[SparkSession, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """The tables of this application only: others may share the folder."""
    return f"{_shared_folder(spark)}/mnemoframe-tables/{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: it cuts the lineage and survives lost executors.

    An RDD checkpoint would compute everything twice and store whole rows; a table is written once, by column, and read by column.
    """
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Delete all that checkpointed() wrote in this application; nothing lazy that rests on it may be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))


def few_rows(df: DataFrame, most: int = 100_000) -> list[Row]:
    """The rows of a table that is small by its nature; a larger one is an error, it is never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of {df.columns}")
    return rows


def hot_keys(df: DataFrame, key: str, cap: int) -> DataFrame:
    """(key, n_blocks) of the keys with more than cap rows. At most rows/cap of them, counted with map-side partial sums."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cap).select(key, F.ceil(F.col("_n") / cap).cast("int").alias("_blocks"))


def blocked(df: DataFrame, key: str, spread: str, cap: int = GROUP_CAP, counted: DataFrame | None = None) -> DataFrame:
    """Add _group and _block so that every pair of rows with equal key meets in exactly one _group of at most 2*cap rows.

    A key with up to cap rows is one group with _block 0. A hot key's rows are dealt to blocks by the hash of spread and every row is sent
    to each pair of blocks that holds its own; in a group of two different blocks only pairs across the blocks are to be compared
    (_cross is then true). Nothing is dropped, and no task holds a hot key. counted may give the rows to count keys over, if those that
    can be hot are had cheaper.
    """
    hot = checkpointed(hot_keys((df if counted is None else counted).select(key), key, cap).withColumnRenamed(key, "_hot"))
    found = hot.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return df.withColumns({"_block": F.lit(0), "_group": F.xxhash64(F.col(key)), "_cross": F.lit(False)})
    out = df.join(F.broadcast(hot) if found <= BROADCAST_KEYS else hot, F.col(key) == F.col("_hot"), "left").drop("_hot")
    n = F.coalesce(F.col("_blocks"), F.lit(1))
    out = out.withColumn("_block", F.pmod(F.xxhash64(F.col(spread)), n).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    lo, hi = F.least("_block", "_other"), F.greatest("_block", "_other")
    group = F.when(F.col("_blocks").isNull(), F.xxhash64(F.col(key))).otherwise(F.xxhash64(F.col(key), lo, hi))
    return out.withColumn("_group", group).withColumn("_cross", lo != hi).drop("_other", "_blocks")


def skew_join(left: DataFrame, right: DataFrame, key: str, other: str, spread: str, cap: int = 1 << 17) -> DataFrame:
    """left join of left.key with right.other, in which a key of left may be null or hold any share of its rows.

    Null keys are not shuffled. Keys with more than cap rows are dealt to blocks by the hash of spread, and the rows of right with such a key,
    which should be few, are copied to each block.
    """
    held = left.filter(F.col(key).isNotNull())
    none = left.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns])
    hot = checkpointed(hot_keys(held.select(key), key, cap).withColumnRenamed(key, "_hot"))
    found = hot.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return held.join(right, F.col(key) == F.col(other), "left").select(*left.columns, *right.columns).unionByName(none)
    small = F.broadcast(hot) if found <= BROADCAST_KEYS else hot
    a = held.join(small, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_blocks", F.lit(1))).cast("int")).drop("_hot", "_blocks")
    b = right.join(small, F.col(other) == F.col("_hot"), "left").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_hot", "_blocks")
    return a.join(b, (F.col(key) == F.col(other)) & (F.col("_salt") == F.col("_salt2")), "left").select(*left.columns, *right.columns).unionByName(none)


def over_groups(df: DataFrame, group: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, num: int | None = None) -> DataFrame:
    """Apply fn to batches that always hold whole groups, in one sorted pass without a Python call for each group.

    fn gets rows sorted by group, many groups at a time, and must keep groups apart itself. Groups must be bounded (see blocked()); at
    most one batch plus one group is held.
    """
    parts = (df.repartition(num, group) if num else df.repartition(group)).sortWithinPartitions(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch[group].iloc[-1]
            cut = int(batch[group].searchsorted(last, side="left"))
            if cut == 0 and rest and rest[-1][group].iloc[-1] == last:
                rest.append(batch)
                continue
            head = pd.concat([*rest, batch.iloc[:cut]], ignore_index=True)
            rest = [batch.iloc[cut:]]
            if len(head):
                yield fn(head)
        if rest:
            yield fn(pd.concat(rest, ignore_index=True))

    return parts.mapInPandas(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): (id, comp), comp being the smallest id of the component.

    Alternating large-star and small-star steps: each is one aggregation with map-side minimum and one join, and needs O(log n)
    rounds; the last is the one that changes nothing. Links stay distributed; each round is checkpointed. Nulls are dropped, self-loops kept as
    single members.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    cur = checkpointed(e.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = checkpointed(small.filter("u <> v").distinct())
        now = cur.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            break
        seen = now
    return nodes.join(cur.groupBy("u").agg(F.min("v").alias("comp")), F.col("id") == F.col("u"), "left").select("id", F.coalesce("comp", "id").alias("comp"))
