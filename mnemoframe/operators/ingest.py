"""From messages to memory: storing, batching, extraction hooks, resolution, reuse of facts, and idempotent writes.

Tables are DataFrames in and out; writes are plans of what to append, found by anti-joins, so that doing them twice adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.hooks import retried
from mnemoframe.operators import memory as M
from mnemoframe.runtime import checkpointed


def added(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, one for each key, whose keys are not stored; null keys never count as stored."""
    first = new.dropDuplicates(keys)
    return first.join(stored.select(*keys).distinct(), keys, "left_anti")


def numbered(new: DataFrame, order: list[Column], last: int, name: str = "id") -> DataFrame:
    """new with ids after last, in order: rows are ranged over partitions, written, counted and numbered in each, so that no task sees all rows."""
    parts = checkpointed(new.withColumn("_o", F.struct(*order)).repartitionByRange("_o").withColumn("_p", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in parts.groupBy("_p").count().collect()}  # one row a partition
    before, total = {}, last
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return new.withColumn(name, F.lit(None).cast("long"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_p")]
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_o"))
    return parts.withColumn(name, (place + offset).cast("long")).drop("_o", "_p")


def store_messages(sessions: DataFrame, messages: DataFrame, task_id: int, chat_id: str, said: list[tuple[str, str, str | None]], time_raw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(session row, message rows) to append for one chat turn (speaker, content, time text), numbered after what is stored; an empty turn is an error."""
    if not said or not chat_id:
        raise ValueError("a chat id and messages are needed")
    spark = sessions.sparkSession
    top = sessions.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.max(F.when(F.col("task_id") == task_id, F.col("session_number"))), F.lit(0))).first()
    last = messages.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    session = spark.createDataFrame([(top[0] + 1, task_id, chat_id, top[1] + 1, time_raw)], "id long, task_id int, chat_id string, session_number int, session_time_raw string")
    rows = [(last + 1 + i, top[0] + 1, i, s, c, t) for i, (s, c, t) in enumerate(said)]
    return session, spark.createDataFrame(rows, "id long, session_id long, position int, speaker string, content string, message_time_raw string")


#: Output checks of the extraction hooks.
def valid_fact(text: Column) -> Column:
    """Has a reference, and only time marks whose resolved part is a date of any precision, a span, or an open span."""
    point = r"\d{4}(?:-\d{2}(?:-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?Z)?)?)?"
    dated = F.forall(X.time_marks(text), lambda m: m["resolved"].rlike(f"^(?:{point}|{point}/{point}|{point}/|/{point})$"))
    return F.coalesce((F.size(X.bracket_refs(text)) > 0) & dated, F.lit(False))


def uncovered_refs(text: Column, allowed: Column) -> Column:
    """References of a fact that were not extracted before; a fact is kept only without any."""
    return F.array_except(X.bracket_refs(text), allowed)


def short_enough(desc: Column, words: int = 60) -> Column:
    return F.coalesce(X.word_count(desc) <= words, F.lit(True))


def default_entities(lines: list[str]) -> list[str]:
    """Runs of capitalised words, first seen first."""
    import re

    return list(dict.fromkeys(m.strip() for t in lines for m in re.findall(r"(?:[A-ZÄÖÜ][\w'’-]+ ?){1,4}", t)))


def default_facts(lines: list[str], names: list[str]) -> list[str]:
    """Each line with a known name, the name in brackets."""
    out = []
    for t in lines:
        hit = next((n for n in names if n in t), None)
        if hit:
            out.append(t.replace(hit, f"[{hit}]", 1))
    return out


@dataclass
class Extraction:
    """Hooks of the digest: from a batch's lines to names, from lines and names to facts. A failing hook is tried again; if it goes on failing, its session stays to be done."""

    entities: Callable[[list[str]], list[str]] = default_entities
    facts: Callable[[list[str], list[str]], list[str]] = default_facts


@dataclass
class Profile:
    """How a kind of corpus is digested; fixed_entities replaces the entity hook."""

    name: str = "default"
    fixed_entities: list[str] | None = None
    extraction: Extraction = field(default_factory=Extraction)


#: Known profiles; unknown names get the default one.
PROFILES = {"default": Profile(), "personas": Profile("personas", ["User"])}


def profile(name: str | None) -> Profile:
    return PROFILES.get(name or "default", PROFILES["default"])


def batch_lines(messages: DataFrame, most_messages: int = 50, most_chars: int = 2000, tail: int = 15) -> DataFrame:
    """(session_id, batch_index, lines, context): the batches of each session as formatted lines, with the last lines of the batch before."""
    sizes = M.message_batches(messages, most_messages, most_chars)
    ends = sizes.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("batch_index", "n_messages"))).alias("b"))
    own = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", X.message_line(F.col("message_time_raw"), F.col("speaker"), F.col("content")).alias("t")))).alias("m"))
    both = own.join(ends, "session_id").select("session_id", F.col("b"), F.transform("m", lambda x: x["t"]).alias("t")).withColumn("x", F.explode("b"))
    start = F.aggregate(F.filter("b", lambda y: y["batch_index"] < F.col("x.batch_index")), F.lit(0).cast("long"), lambda a, y: a + y["n_messages"])
    lines = both.select("session_id", F.col("x.batch_index").alias("batch_index"), F.slice("t", (start + 1).cast("int"), F.col("x.n_messages").cast("int")).alias("lines"))
    return M.context_tails(lines, tail)


def attempted(batches: DataFrame, how: Profile | None = None) -> DataFrame:
    """(session_id, batch_index, fact_index, text, names, error) by the hooks, in Arrow batches; facts that fail the checks are left out. A batch whose hook still
    fails after retries gives one row with its error and no text."""
    how = how or profile(None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for s, b, lines in zip(frame["session_id"], frame["batch_index"], frame["lines"]):
                try:
                    names = how.fixed_entities or retried(how.extraction.entities)(list(lines))
                    rows += [(s, b, i, t, names, None) for i, t in enumerate(retried(how.extraction.facts)(list(lines), names))]
                except Exception as e:  # noqa: BLE001
                    rows.append((s, b, -1, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["session_id", "batch_index", "fact_index", "text", "names", "error"])

    out = batches.select("session_id", "batch_index", "lines").mapInPandas(run, "session_id long, batch_index int, fact_index int, text string, names array<string>, error string")
    return out.filter(F.col("error").isNotNull() | (valid_fact(F.col("text")) & (F.size(uncovered_refs(F.col("text"), F.col("names"))) == 0)))


def extracted(batches: DataFrame, how: Profile | None = None) -> DataFrame:
    """(session_id, batch_index, fact_index, text, names): what attempted() gives of batches whose hooks did not fail."""
    return attempted(batches, how).filter("error is null").drop("error")


def written(facts: DataFrame, sources: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts to add, sources to add) for extracted facts (task_id, session_id, text): a text of a task is one fact, reused if stored; each gets its session once.

    Different resolved times are different texts, and so different facts; the time a fact was told is not part of it.
    """
    fresh = added(facts, new.select("task_id", "text"), ["task_id", "text"])
    last = facts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = numbered(fresh, [F.col("task_id"), F.col("text")], last)
    every = facts.select("id", "task_id", "text").unionByName(rows.select("id", "task_id", "text"))
    known = every.groupBy("task_id", "text").agg(F.min("id").alias("fact_id"))
    links = added(sources, new.join(known, ["task_id", "text"]).select("fact_id", "session_id"), ["fact_id", "session_id"])
    return rows, links


def digest(sessions: DataFrame, messages: DataFrame, facts: DataFrame, sources: DataFrame, how: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts to add, sources to add, sessions done) of all sessions with digested_at null, in order of their numbers. A session with a batch whose hook failed gives nothing and is not done."""
    pending = sessions.filter("digested_at is null").select(F.col("id").alias("session_id"), "task_id", "session_number")
    own = messages.join(pending.select("session_id"), "session_id", "left_semi")
    tried = checkpointed(attempted(batch_lines(own), profile(how)))
    failed = tried.filter("error is not null").select("session_id").distinct()
    found = tried.join(failed, "session_id", "left_anti").join(pending, "session_id").select("task_id", "session_id", "text")
    rows, links = written(facts, sources, found)
    return rows, links, pending.select("session_id").join(failed, "session_id", "left_anti")
