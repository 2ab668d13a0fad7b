"""The memory corpus: clean tables out of the raw ones, and the relations between sessions, facts, entities and trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.runtime import table


@dataclass
class Corpus:
    """Tables with one row for each id, and what is derived from them. Nothing is read before it is used."""

    spark: SparkSession
    folder: str

    @cached_property
    def sessions(self) -> DataFrame:
        return table(self.spark, self.folder, "chat_sessions").distinct()

    @cached_property
    def messages(self) -> DataFrame:
        return table(self.spark, self.folder, "chat_messages").distinct()

    @cached_property
    def facts(self) -> DataFrame:
        return table(self.spark, self.folder, "facts").dropDuplicates(["id"])

    @cached_property
    def entities(self) -> DataFrame:
        return table(self.spark, self.folder, "entities").dropDuplicates(["id"])

    @cached_property
    def nodes(self) -> DataFrame:
        """The latest state of each node."""
        raw = table(self.spark, self.folder, "entity_tree_nodes")
        best = raw.groupBy("id").agg(F.max(F.struct("created_at", F.struct(*[c for c in raw.columns if c not in ("id", "created_at")]).alias("row"))).alias("m"))
        return best.select("id", "m.row.*", "m.created_at")

    @cached_property
    def chunks(self) -> DataFrame:
        return table(self.spark, self.folder, "file_chunks").dropDuplicates(["chunk_id"])

    @cached_property
    def refs(self) -> DataFrame:
        """(fact_id, task_id, alias_text, entity_id): each distinct reference of a fact and the entity of its task with that name, the first id if several; null if none."""
        named = self.entities.groupBy("task_id", F.col("canonical_ref").alias("alias_text")).agg(F.min(F.struct("id", "entity_id")).alias("e")).select("task_id", "alias_text", "e.entity_id")
        own = self.facts.select(F.col("id").alias("fact_id"), "task_id", F.explode(X.bracket_refs(F.col("text"))).alias("alias_text"))
        return own.join(named, ["task_id", "alias_text"], "left").select("fact_id", "task_id", "alias_text", "entity_id")

    @cached_property
    def sources(self) -> DataFrame:
        """(fact_id, session_id) by task and session number."""
        s = self.sessions.select("task_id", "session_number", F.col("id").alias("session_id"))
        return self.facts.filter("session_number is not null").select(F.col("id").alias("fact_id"), "task_id", "session_number").join(s, ["task_id", "session_number"]).select("fact_id", "session_id")

    @cached_property
    def annotations(self) -> DataFrame:
        """(fact_id, time_raw, time_resolved) of every time mark."""
        marks = self.facts.select(F.col("id").alias("fact_id"), F.explode(X.time_marks(F.col("text"))).alias("m"))
        return marks.select("fact_id", F.col("m.raw").alias("time_raw"), F.col("m.resolved").alias("time_resolved"))

    @cached_property
    def summaries(self) -> DataFrame:
        """(session_id, task_id, subject, content): the session's texts in order stand for its summary."""
        said = self.messages.filter("content is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "content"))).alias("m"))
        return said.join(self.sessions.select(F.col("id").alias("session_id"), "task_id", "session_number"), "session_id").select("session_id", "task_id", F.concat(F.lit("Session "), F.col("session_number").cast("string")).alias("subject"), F.array_join(F.transform("m", lambda x: x["content"]), " ").alias("content"))


def active(facts: DataFrame, task_id: int | None = None) -> DataFrame:
    """Facts whose status says active, whatever its spelling, of one task or all."""
    out = facts.filter(F.lower(F.trim("status")) == "active")
    return out if task_id is None else out.filter(F.col("task_id") == task_id)


def with_searched_text(facts: DataFrame) -> DataFrame:
    """facts with st, the text that is searched: the stored one, or built from the text where none is stored."""
    built = X.search_text(F.col("text"), F.array().cast("array<string>"))
    return facts.withColumn("st", F.coalesce(F.nullif(F.trim("search_text"), F.lit("")), built) if "search_text" in facts.columns else built)


def latest_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def session_scores(fact_scores: DataFrame, sources: DataFrame) -> DataFrame:
    """(session_id, score, n_facts): scores (id, score) of facts summed over the sessions they come from."""
    both = fact_scores.join(sources, F.col("id") == F.col("fact_id"))
    return both.groupBy("session_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("n_facts"))


def source_chats(sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """(fact_id, source_chat_ids): the chats of a fact, sorted and joined."""
    s = sessions.select(F.col("id").alias("session_id"), "chat_id")
    return sources.join(s, "session_id").groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("chat_id")), ",").alias("source_chat_ids"))


def new_tree_facts(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task_id, entity_id, fact_id) of referenced facts that have no node in the entity's tree."""
    placed = nodes.filter("fact_id is not null").select("task_id", "entity_id", "fact_id")
    return refs.filter("entity_id is not null").select("task_id", "entity_id", "fact_id").distinct().join(placed, ["task_id", "entity_id", "fact_id"], "left_anti")


def alias_map(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(task_id, name, entity_id): canonical names first, then aliases; the first id of each name."""
    canon = entities.select("task_id", F.col("canonical_ref").alias("name"), "entity_id", F.lit(0).alias("p"))
    other = refs.filter("entity_id is not null").select("task_id", F.col("alias_text").alias("name"), "entity_id", F.lit(1).alias("p"))
    best = canon.unionByName(other).groupBy("task_id", "name").agg(F.min(F.struct("p", "entity_id")).alias("b"))
    return best.select("task_id", "name", "b.entity_id")


def exact_reuse(new: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, fact_id): for new facts (key, task_id, text, entities) the stored fact (id, ...) of the task with the same text and the same set of entities, the smallest id.

    Without a column entities on both sides the text decides alone. Two people of one name are not one: their entities differ.
    """
    by = ["task_id", "text"] + ["entities"] * ("entities" in new.columns and "entities" in facts.columns)
    same = lambda df: df.withColumn("entities", F.array_sort(F.array_distinct(F.coalesce("entities", F.array().cast("array<string>"))))) if "entities" in by else df
    held = same(facts).groupBy(*by).agg(F.min("id").alias("fact_id"))
    return same(new).join(held, by).groupBy("key").agg(F.min("fact_id").alias("fact_id"))


def equivalent_facts(candidates: DataFrame, decide: Callable[[str, list[str]], int | None]) -> DataFrame:
    """(key, fact_id) of candidates (key, text, entities, fact_id, fact_text, fact_entities): what a hook takes for the same fact, by its place among the offered texts.

    Only candidates with the same set of entities are offered, in order of fact_id; an answer that is no place among them is none.
    """
    same = candidates.filter(F.array_sort(F.array_distinct("entities")) == F.array_sort(F.array_distinct("fact_entities")))
    offered = same.groupBy("key", "text").agg(F.array_sort(F.collect_list(F.struct("fact_id", "fact_text"))).alias("c")).select("key", "text", F.transform("c", lambda x: x["fact_id"]).alias("ids"), F.transform("c", lambda x: x["fact_text"]).alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, ids, texts in zip(batch["key"], batch["text"], batch["ids"], batch["texts"]):
                at = decide(text, list(texts))
                if at is not None and 0 <= at < len(ids):
                    rows.append((key, int(ids[at])))
            yield pd.DataFrame(rows, columns=["key", "fact_id"])

    return offered.mapInPandas(run, f"key {dict(candidates.dtypes)['key']}, fact_id long")


def chosen(spec: str, n: int) -> list[int]:
    """Places from 1 that a text like `1-3,8` names, in order and once each; a place that is not among n, or anything else, is an error."""
    out: dict[int, None] = {}
    for part in spec.split(","):
        ends = part.strip().split("-")
        if not all(x.strip().isdigit() for x in ends) or len(ends) > 2:
            raise ValueError(f"no places: {part!r}")
        lo, hi = int(ends[0]), int(ends[-1])
        if not 1 <= lo <= hi <= n:
            raise ValueError(f"{part!r} is not within 1-{n}")
        out.update(dict.fromkeys(range(lo, hi + 1)))
    return list(out)


def around_cursor(df: DataFrame, keys: list[str], at: Column, order: list[Column], back: int) -> DataFrame:
    """Of each group the rows after the cursor and the last `back` ones up to it; at tells whether a row is after it."""
    w = Window.partitionBy(*keys, "_after").orderBy(*order)
    placed = df.withColumn("_after", at).withColumn("_r", F.row_number().over(w))
    return placed.filter(F.col("_after") | (F.col("_r") <= back)).drop("_after", "_r")


def upserts(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(id, action) that turn the stored nodes old into new: 'insert', 'update' (one of columns differs), 'delete', 'keep'. A new node whose parent is not in new is an error."""
    orphans = new.filter("parent_id is not null").join(new.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").limit(1).count()
    if orphans:
        raise ValueError("a node without its parent")
    a = old.select(F.col("id").alias("o"), F.struct(*columns).alias("before"))
    b = new.select(F.col("id").alias("i"), F.struct(*columns).alias("now"))
    both = a.join(b, F.col("o") == F.col("i"), "full")
    action = F.when(F.col("o").isNull(), "insert").when(F.col("i").isNull(), "delete").when(F.col("before").eqNullSafe(F.col("now")), "keep").otherwise("update")
    return both.select(F.coalesce("i", "o").alias("id"), action.alias("action"))


def with_clamped_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The page at offset, the last one if offset lies behind the end."""
    total = df.count()
    at = max(0, min(offset, (max(total, 1) - 1) // limit * limit))
    return df.orderBy(*order).offset(at).limit(limit)


def message_batches(messages: DataFrame, most_messages: int = 50, most_chars: int = 2000) -> DataFrame:
    """(session_id, batch_index, n_messages, n_chars): messages in order, a new batch at the message that would exceed either limit; a longer message stands alone.

    The fold runs over a session's lengths only, which is a small array even of a long session.
    """
    own = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", F.length(F.coalesce("content", F.lit(""))).alias("len")))).alias("m"))
    kind = "array<struct<n:bigint,chars:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        opens = (F.size(acc) == 0) | F.coalesce((last["n"] >= most_messages) | (last["chars"] + x["len"] > most_chars), F.lit(True))
        fresh = F.concat(acc, F.array(F.struct(F.lit(1).cast("long").alias("n"), x["len"].cast("long").alias("chars"))))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["n"] + 1).alias("n"), (last["chars"] + x["len"]).alias("chars"))))
        return F.when(opens, fresh).otherwise(grown)

    first = F.array().cast(kind)
    folded = own.select("session_id", F.aggregate("m", first, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(F.lit(1).cast("long").alias("n"), x["len"].cast("long").alias("chars")))).otherwise(step(acc, x))).alias("b"))
    return folded.select("session_id", F.posexplode("b").alias("batch_index", "b")).select("session_id", "batch_index", F.col("b.n").alias("n_messages"), F.col("b.chars").alias("n_chars"))


def token_windows(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, window, content, n_tokens): white-space windows of size with overlap, the last one ending with the text."""
    words = df.select(F.col(id_col).alias("id"), F.filter(F.split(text_col, r"\s+"), lambda x: x != "").alias("w")).filter(F.size("w") > 0)
    step = size - overlap
    last = F.greatest(F.ceil((F.size("w") - size) / F.lit(step)).cast("int"), F.lit(0))
    cut = words.withColumn("window", F.explode(F.sequence(F.lit(0), last))).withColumn("p", F.slice("w", F.col("window") * step + 1, size))
    return cut.select("id", "window", F.array_join("p", " ").alias("content"), F.size("p").alias("n_tokens"))


def count_windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of windows over n items: steps of size, or of size - overlap where the items do not divide evenly."""
    step = size - overlap if overlap and n % size else size
    return [(a, min(a + size, n)) for a in range(0, n, max(1, step))] if n else []


def context_tails(batches: DataFrame, keep: int = 15) -> DataFrame:
    """batches (session_id, batch_index, lines) with context: the last lines of the batch before."""
    w = Window.partitionBy("session_id").orderBy("batch_index")
    before = F.lag("lines").over(w)
    return batches.withColumn("context", F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.slice(before, F.greatest(F.size(before) - keep + 1, F.lit(1)), keep)))


def forward_filled(df: DataFrame, keys: list[str], order: str, col: str) -> DataFrame:
    """col with blanks taking the value before; rows before the first value are left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(F.nullif(F.trim(F.col(col)), F.lit("")), ignorenulls=True).over(w)
    return df.withColumn(col, filled).filter(F.col(col).isNotNull())


def trunk(df: DataFrame, keys: list[str], order: list[Column], most: int, step: int) -> DataFrame:
    """The last rows of each group: as many as are left when whole steps are taken from the front until at most `most` remain."""
    every = Window.partitionBy(*keys)
    back = Window.partitionBy(*keys).orderBy(*order)
    total = F.count(F.lit(1)).over(every)
    keep = F.when(total > most, total - F.ceil((total - most) / F.lit(step)) * step).otherwise(total)
    return df.withColumn("_keep", keep).withColumn("_at", F.row_number().over(back)).filter(F.col("_at") <= F.col("_keep")).drop("_keep", "_at")


def backfilled_times(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, session_id, message_time): a session without any message time gives its own to all of its messages; others stay as they are."""
    any_time = F.max("message_time").over(Window.partitionBy("session_id"))
    s = sessions.select(F.col("id").alias("session_id"), "session_time")
    return messages.select("id", "session_id", "message_time").withColumn("_any", any_time).join(s, "session_id", "left").select("id", "session_id", F.when(F.col("_any").isNull(), F.col("session_time")).otherwise(F.col("message_time")).alias("message_time"))
