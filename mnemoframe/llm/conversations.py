"""Rebuilding conversations from message rows.

Rows come as export fragments: stretches that stand one after the other by id and go on position by position; a message exported again makes fragments
overlap. Fragments are matched by their message hashes (the end of one with the beginning of another, or its next position with it), form an
overlap graph, and unambiguous paths are merged. The turns are read off the merged path. A session is sound if one path is left that starts
at 0 or 1 and its turns keep the rules; all others are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.operators.hierarchy import CYCLE, FRAGMENT_ROWS, solve
from mnemoframe.runtime import checkpointed, few_rows

#: Ids of one block, at whose bounds fragments end: a fragment has at most so many messages.
BLOCK_IDS = 2048
_BLANK = "^[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u0085\\u001c-\\u001f]*$"


def with_roles(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """messages with role: the letters of speaker, lower-cased, looked up in aliases (alias, role), a table of a few rows; any other is 'user'."""
    names = {r[0]: r[1] for r in few_rows(aliases.filter("alias is not null").select("alias", "role"))}
    key = F.lower(F.regexp_replace("speaker", "[^\\p{L}]", ""))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key] if names else F.lit(None)
    return messages.withColumn("role", F.coalesce(known, F.lit("user")))


def fragments(messages: DataFrame, aliases: DataFrame, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """(turns, fragments). turns: (session_id, frag, at, role, speaker, content), the messages of each different fragment, at from 0.
    fragments: one row for each, with first, last, hashes in order, and what the rules need. Equal fragments are one, however many.
    """
    blank = F.coalesce(F.col("speaker").rlike(_BLANK), F.lit(True)) | F.coalesce(F.col("content").rlike(_BLANK), F.lit(True))
    rows = with_roles(messages.filter("session_id is not null").select("id", "session_id", "position", "speaker", "content"), aliases)
    rows = rows.withColumn("blank", blank).withColumn("h", F.xxhash64("position", "speaker", "content", F.col("speaker").isNull(), F.col("content").isNull())).distinct()
    # a message without an id stands alone, else all of them would share a block
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("id") / block_ids), F.col("h"))).withColumn("bare", F.col("id").isNull())
    inside = Window.partitionBy("session_id", "bare", "block").orderBy("id", "position", "h")  # at most block_ids ids
    step = F.when(F.col("position") == F.lag("position").over(inside) + 1, 0).otherwise(1)
    rows = rows.withColumn("_new", step).withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = checkpointed(rows.withColumn("frag", F.xxhash64("session_id", "bare", "block", "_run")).drop("id", "bare", "block", "_new", "_run"))
    spoken = F.when(F.col("role") != "system", F.struct("position", "role"))
    frags = rows.groupBy("session_id", "frag").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.sort_array(F.collect_list(F.struct("position", "h"))).alias("chain"),
        F.max("blank").alias("blank"), F.max(F.col("role") == "user").alias("user"), F.max(F.col("role") == "assistant").alias("assistant"), F.max(spoken).alias("spoken"), F.max(F.col("position").isNull()).alias("unplaced"),
    )
    frags = frags.withColumn("chain", F.transform("chain", lambda x: x["h"]))
    same = frags.groupBy("session_id", F.xxhash64("chain").alias("_c")).agg(F.min_by(F.struct(*frags.columns), "frag").alias("f"))
    frags = checkpointed(same.select("f.*"))
    turns = rows.join(frags.select("frag", "first"), "frag").select("session_id", "frag", (F.col("position") - F.col("first")).alias("at"), "role", "speaker", "content")
    return turns, frags


def overlap_edges(frags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contained, edges): fragments that lie wholly in another one, and the mutually best links a -> b of suffix and prefix among the rest.

    A link has overlap >= 1 where the end of a equals the beginning of b, message by message, and 0 where b goes on right after a. Among
    several links of a fragment the longest overlap counts; where two different fragments tie, the way is ambiguous and no link remains.
    """
    base = frags.filter("not unplaced").select("session_id", "frag", "first", "last", "chain")
    inner = base.select("session_id", F.col("frag").alias("a"), F.col("last").alias("a_last"), F.posexplode("chain").alias("at", "head"))
    other = base.select("session_id", F.col("frag").alias("b"), F.col("last").alias("b_last"), F.col("chain")[0].alias("head"))
    met = checkpointed(inner.join(other, ["session_id", "head"]).filter("a <> b"))
    met = met.join(base.select(F.col("frag").alias("a"), F.col("chain").alias("a_chain")), "a").join(base.select(F.col("frag").alias("b"), F.col("chain").alias("b_chain")), "b")
    n = F.least(F.size("a_chain") - F.col("at"), F.size("b_chain"))
    met = checkpointed(met.withColumn("n", n).filter(F.expr("slice(a_chain, at + 1, n) = slice(b_chain, 1, n)")).drop("a_chain", "b_chain"))
    within = (F.col("b_last") < F.col("a_last")) | ((F.col("b_last") == F.col("a_last")) & ((F.col("at") > 0) | (F.col("a") < F.col("b"))))
    contained = met.filter(within).select(F.col("b").alias("frag")).distinct()
    linked = met.filter("b_last > a_last and at > 0").select("session_id", "a", "b", "n")
    # b begins where a begins and goes on: then a lies in b, which the row with a and b exchanged has told
    after = base.select("session_id", F.col("frag").alias("a"), (F.col("last") + 1).alias("pos")).join(base.select("session_id", F.col("frag").alias("b"), F.col("first").alias("pos")), ["session_id", "pos"])
    links = linked.unionByName(after.select("session_id", "a", "b", F.lit(0).alias("n")))
    links = checkpointed(links.join(contained.withColumnRenamed("frag", "a"), "a", "left_anti").join(contained.withColumnRenamed("frag", "b"), "b", "left_anti"))

    def best(side: str) -> DataFrame:
        top = links.groupBy(F.col(side).alias("_s")).agg(F.max("n").alias("_n"))
        tied = links.join(top, (F.col(side) == F.col("_s")) & (F.col("n") == F.col("_n"))).groupBy(side).agg(F.first("n").alias("n"), F.min("a").alias("a_"), F.max("a").alias("a2"), F.min("b").alias("b_"), F.max("b").alias("b2"))
        return tied.filter("a_ = a2 and b_ = b2").select(F.col("a_").alias("a"), F.col("b_").alias("b"), "n")

    return contained, checkpointed(best("a").intersect(best("b")))


def assemble(sessions: DataFrame, messages: DataFrame, aliases: DataFrame, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """(verdicts, conversations).

    verdicts: (session_id, reason) of every id of sessions, reason null if the session is sound, else the first of: 'empty' (no message),
    'blank' (a blank speaker or content), 'broken' (not one unambiguous path of positions from 0 or 1), 'no_user', 'no_assistant', 'no_reply'
    (the last message, system ones aside, is not the assistant's). conversations: (session_id, turn, role, speaker, content) of the sound
    ones, turn from 0. Rows equal in session_id, position, speaker and content are one message; messages of unknown or null sessions
    are ignored; a null position breaks its session. Extra columns are ignored.
    """
    known = sessions.filter("id is not null").select(F.col("id").alias("session_id")).distinct()
    own = messages.select("id", "session_id", "position", "speaker", "content").join(known, "session_id", "left_semi")
    turns, frags = fragments(own, aliases, block_ids)
    contained, edges = overlap_edges(frags)
    kept = frags.join(contained, "frag", "left_anti")
    # every fragment hangs on the one before; what it adds to the path stands after all that those before it have added
    before = kept.select(F.col("frag").alias("a"), F.size("chain").alias("a_size")).join(edges, "a").select(F.col("b").alias("frag"), F.col("a").alias("parent"), "n", (F.col("a_size") - F.col("n")).cast("long").alias("w"))
    linked = checkpointed(kept.join(before, "frag", "left"))
    paths = solve(linked.select(F.col("frag").alias("id"), F.xxhash64("session_id").alias("loc"), "parent", F.coalesce("w", F.lit(0)).cast("long").alias("w")), FRAGMENT_ROWS, False)
    placed = checkpointed(linked.join(paths.withColumnRenamed("id", "frag"), "frag"))
    per = placed.groupBy("session_id").agg(
        (F.min("root") == F.max("root")).alias("one"), F.min(F.when(F.col("parent").isNull(), F.col("first"))).alias("first"), F.max("blank").alias("blank"), F.max("user").alias("user"),
        F.max("assistant").alias("assistant"), F.max("spoken").alias("spoken"), F.max(F.col("unplaced") | (F.col("root") == CYCLE)).alias("unplaced"),
    ).withColumn("known", F.lit(True))
    reason = (
        F.when(F.col("known").isNull(), "empty").when(F.col("blank"), "blank")
        .when(F.col("unplaced") | ~F.col("one") | ~F.coalesce(F.col("first").isin(0, 1), F.lit(False)), "broken")
        .when(~F.col("user"), "no_user").when(~F.col("assistant"), "no_assistant").when(F.col("spoken.role") != "assistant", "no_reply")
    )
    verdicts = known.join(per, "session_id", "left").select("session_id", reason.alias("reason"))
    sound = verdicts.filter("reason is null").select("session_id")
    # the merged path: of each fragment what lies behind its overlap with the one before
    path = placed.join(sound, "session_id", "left_semi").select("frag", "depth", F.coalesce("n", F.lit(0)).alias("n"))
    conversations = turns.join(path, "frag").filter("at >= n").select("session_id", (F.col("depth") + F.col("at")).cast("int").alias("turn"), "role", "speaker", "content")
    return verdicts, conversations
