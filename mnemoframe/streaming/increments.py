"""Incremental work as Structured Streaming: digest queues, idempotent jobs, cursors, windows with late data, and keyed tree state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet folder as a stream of the files that are added to it."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give everything new to each(batch, id) and stop; what was given is remembered in checkpoint, also across restarts.

    If each fails the batch is not marked and comes again at the next run.
    """
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by event time window and keys, with a watermark."""
    t = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", size, slide) if slide else F.window("_t", size), *keys).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *keys, "n")


def session_counts(events: DataFrame, time_col: str, keys: list[str], late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    t = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.session_window("_t", gap), *keys).agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", *keys, "n")


def first_requests(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Each request once, whenever it comes again."""
    return requests.dropDuplicates([key])


#: Fixed value: the states of a digest job.
STATES = ("queued", "running", "succeeded", "failed")


def job_states(events: DataFrame) -> DataFrame:
    """(request_id, status, n_done) as a keyed state over (request_id, action, ok): submit, start, finish, retry.

    A job submitted again stays as it is; only failed ones can be retried; an action that does not fit the state changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, done = state.get if state.exists else ("", 0)
        for batch in batches:
            for action, ok in zip(batch["action"], batch["ok"]):
                status, done = next_state(status, done, action, bool(ok) if ok is not None else False)
        state.update((status, done))
        yield pd.DataFrame({"request_id": [key[0]], "status": [status], "n_done": [done]})

    return events.groupBy("request_id").applyInPandasWithState(step, "request_id string, status string, n_done long", "status string, n_done long", "update", GroupStateTimeout.NoTimeout)


def next_state(status: str, done: int, action: str, ok: bool) -> tuple[str, int]:
    moves = {("", "submit"): "queued", ("queued", "start"): "running", ("failed", "retry"): "queued"}
    if (status, action) in moves:
        return moves[status, action], done
    if status == "running" and action == "finish":
        return ("succeeded", done + 1) if ok else ("failed", done)
    return status, done


def due_for_reflection(messages: DataFrame, least: int = 10) -> DataFrame:
    """(persona_id, n) whenever a persona has said `least` things since the last time; the count starts anew then."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(int((b["role"] == "user").sum()) for b in batches)
        due = n >= least
        state.update((0 if due else n,))
        if due:
            yield pd.DataFrame({"persona_id": [key[0]], "n": [n]})

    return messages.groupBy("persona_id").applyInPandasWithState(step, "persona_id string, n long", "n long", "append", GroupStateTimeout.NoTimeout)


def tree_state(new_facts: DataFrame) -> DataFrame:
    """(entity_id, support, centroid): facts (entity_id, vec) carried per entity as a running mean."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, None)
        for batch in batches:
            for v in batch["vec"]:
                n += 1
                mean = [float(x) for x in v] if mean is None else [m + (float(x) - m) / n for m, x in zip(mean, v)]
        state.update((n, mean))
        yield pd.DataFrame({"entity_id": [key[0]], "support": [n], "centroid": [mean]})

    return new_facts.groupBy("entity_id").applyInPandasWithState(step, "entity_id string, support long, centroid array<double>", "support long, centroid array<double>", "update", GroupStateTimeout.NoTimeout)


def merged_index(stored: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """(chat_id, document_id, outcome) of new documents (with digest) against stored ones (with digest, version): 'indexed', 'already_indexed', 'reindexed' (older version) or 'conflict' (other content)."""
    s = stored.select("chat_id", "document_id", F.col("digest").alias("s_digest"), F.col("version").alias("s_version"))
    outcome = F.when(F.col("s_digest").isNull(), "indexed").when(F.col("s_digest") != F.col("digest"), "conflict").when(F.col("s_version") < version, "reindexed").otherwise("already_indexed")
    return new.join(s, ["chat_id", "document_id"], "left").select("chat_id", "document_id", outcome.alias("outcome"))
