"""The public surface: a memory store that takes messages and answers questions, and a file library.

Model calls are hooks with deterministic defaults, so that everything runs, and can be checked, without a network.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.functions import vectors as V
from mnemoframe.operators import memory as M
from mnemoframe.operators import search as S
from mnemoframe.operators import trees as G

DIMENSIONS = 64
#: Words that rewriting leaves out.
STOP_WORDS = frozenset("a an and are did do does for from had has have how i in is it me my of on or that the their to was were what when where which who why will with you your".split())


def hashed_embedding(text: str) -> list[float]:
    """Hashed bag of words of length 1; zeros for texts without words."""
    v = [0.0] * DIMENSIONS
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % DIMENSIONS] += 1.0 if h >> 32 & 1 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def without_stop_words(question: str) -> str:
    kept = [w for w in re.findall(r"[^\W_]+", question) if w.lower() not in STOP_WORDS]
    return " ".join(kept) or question


@dataclass
class Hooks:
    """Where models come in. A hook that raises is answered with its fallback: the question itself, no further queries, no ranking."""

    embed: Callable[[str], list[float]] = hashed_embedding
    rewrite: Callable[[str], str] = without_stop_words
    more_queries: Callable[[str], list[str]] = lambda q: []
    reflect: Callable[[str, list[str]], list[str]] = lambda q, known: []
    scorer: Callable | None = S.overlap_score

    def safely(self, name: str, default, *args):
        try:
            return getattr(self, name)(*args)
        except Exception:  # noqa: BLE001
            return default


@dataclass
class Found:
    facts: DataFrame
    sessions: DataFrame
    context: str
    n_tokens: int


@dataclass
class MemoryStore:
    """Searches one corpus; facts have id, task_id, text, status and text_embedding, sources link them to sessions."""

    spark: SparkSession
    facts: DataFrame
    sources: DataFrame
    sessions: DataFrame
    summaries: DataFrame
    hooks: Hooks = field(default_factory=Hooks)
    nodes: DataFrame | None = None
    entities: DataFrame | None = None
    refs: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, folder: str, hooks: Hooks | None = None) -> MemoryStore:
        c = M.Corpus(spark, folder)
        return cls(spark, c.facts, c.sources, c.sessions, c.summaries, hooks or Hooks(), c.nodes, c.entities, c.refs)

    def tree_facts(self, task_id: int, question: str, vec: list[float], entities: int = 5, width: int = 3, limit: int = 20) -> DataFrame:
        """(id, score): the facts that a beam finds in the trees of the entities which the question names or means, ranked by their vectors."""
        ents = self.entities.filter(F.col("task_id") == task_id)
        aliases = self.refs.filter((F.col("task_id") == task_id) & F.col("entity_id").isNotNull()).select(F.xxhash64("entity_id", "alias_text").alias("a"), "entity_id", "alias_text").distinct()
        named = S.Index(aliases, "a", "alias_text").search(question, 2 * entities).join(aliases, F.col("id") == F.col("a")).select("entity_id", "score")
        return G.tree_facts(self.nodes.filter(F.col("task_id") == task_id), M.active(self.facts, task_id), ents, named, vec, entities, width, limit)

    def _paths(self, task_id: int, queries: list[str], per_path: int) -> list[tuple[str, DataFrame]]:
        own = M.active(self.facts, task_id)
        index, out = S.Index(M.with_searched_text(own), "id", "st", True), []
        for i, q in enumerate(queries):
            out.append((f"bm25-{i}", index.search(q, per_path)))
            if "+" in q:  # a query with words that must occur; the plain path takes all as optional
                out[-1:] = [(f"parsed-{i}", index.search(q, per_path)), (f"bm25-{i}", index.search(q.replace("+", " "), per_path))]
            vec = self.hooks.safely("embed", None, q)
            if vec and any(vec):
                out.append((f"vector-{i}", V.top_by_vector(own, "text_embedding", vec, "id", per_path)))
                if self.nodes is not None and self.entities is not None and self.refs is not None:
                    out.append((f"tree-{i}", self.tree_facts(task_id, q, vec, limit=per_path)))
        return out

    def _within_aspects(self, pool: DataFrame) -> DataFrame:
        """pool (id, source, ...) with at most three facts of one aspect and eight of the one over it, in order; found words are safe from that."""
        if self.nodes is None or self.entities is None:
            return pool
        n = self.nodes.join(pool.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").select(F.col("id").alias("node"), "fact_id")
        keys = G.aspect_paths(self.nodes, self.entities).join(n, F.col("id") == F.col("node")).groupBy("fact_id").agg(F.min(F.struct("node", "leaf_key", "mid_key")).alias("k"))
        placed = pool.join(keys, F.col("id") == F.col("fact_id"), "left").select("id", "source", "score", "pool_position", F.col("k.leaf_key").alias("leaf"), F.col("k.mid_key").alias("mid"))
        # at most the rows of a few paths of limited length
        rows = placed.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pool_position", "id", "leaf", "mid"))).alias("m"), F.collect_set(F.when(F.col("source").startswith("bm25"), F.col("id"))).alias("safe"))
        kept = rows.select(F.explode(S.capped(F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), x["mid"].alias("mid"))), protected=F.col("safe"))).alias("k"))
        return pool.join(kept.select(F.col("k.id").alias("id")), "id", "left_semi")

    def search(self, task_id: int, question: str, mode: str = "direct", strategy: str = "rrf", top_k: int = 12, per_path: int = 20, fact_budget: int = 4500, session_budget: int = 1500) -> Found:
        """The facts and sessions of a task that answer a question best, and both packed into a text within the budgets.

        mode 'expand' adds the queries of a hook, 'reflect' also a second round on what was found, whose new facts follow with score 0.
        strategy 'rrf' fuses ranks, 'rerank' scores texts. Without any hit the result is empty.
        """
        if mode not in ("direct", "expand", "reflect") or strategy not in ("rrf", "rerank"):
            raise ValueError("unknown mode or strategy")
        queries = [question]
        if mode != "direct":
            queries += [q for q in (self.hooks.safely("rewrite", question, question), *self.hooks.safely("more_queries", [], question)) if q and q not in queries]
        texts = M.active(self.facts, task_id).select("id", "text", "fact_ts")
        pool = self._within_aspects(S.fuse(self._paths(task_id, queries, per_path))).join(texts, "id")
        top = S.rerank(pool, "text", question, top_k, self.hooks.scorer) if strategy == "rerank" else pool.orderBy(F.desc("score"), "pool_position").limit(top_k)
        rows = top.orderBy(F.desc("score"), "pool_position").collect()  # at most top_k
        if mode == "reflect" and rows:
            again = self.hooks.safely("reflect", [], question, [r["text"] for r in rows])[:2]
            if again:
                known = {r["id"] for r in rows}
                more = S.first_seen(self._paths(task_id, again, 15)).join(texts, "id").orderBy("id").collect()
                rows += [r for r in more if r["id"] not in known]
        known_ids = {r["id"]: i for i, r in enumerate(rows)}
        schema = "id long, score double, place int, text string, fact_ts string"
        scored = [(r["id"], float(r["score"]) if "pool_position" in r.asDict() else 0.0, known_ids[r["id"]], r["text"], r["fact_ts"]) for r in rows]
        facts = self.spark.createDataFrame(scored, schema)
        sessions = M.session_scores(facts.select("id", "score"), self.sources).orderBy(F.desc("score"), "session_id").limit(10).join(self.summaries.select("session_id", "subject", "content"), "session_id", "left")
        line = X.fact_line(F.col("text"), X.time_info(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("fact_ts")))
        kept = facts.select("id", "place", F.coalesce("fact_ts", F.lit("zzz")).alias("t"), line.alias("line")).orderBy("place").collect()
        used, lines = 0, []
        for r in kept:  # goes on past a fact that does not fit
            cost = len(r["line"]) // 4 + 1
            if used + cost <= fact_budget:
                used += cost
                lines.append((r["t"], r["place"], r["line"]))
        said = []
        for r in sessions.orderBy(F.desc("score"), "session_id").collect():  # stops at the first session that does not fit
            cost = len(r["content"] or "") // 4 + 1
            if cost > session_budget:
                break
            session_budget -= cost
            said.append(r["content"] or "")
        context = "\n".join([x[2] for x in sorted(lines)] + said)
        return Found(facts, sessions, context, len(context) // 4 + 1 if context else 0)


@dataclass
class FileLibrary:
    """Chunks of files by chat; searched by words and, if a hook gives vectors, by meaning."""

    chunks: DataFrame
    hooks: Hooks = field(default_factory=Hooks)

    def search(self, chat_id: str, query: str, document_ids: list[str] | None = None, top_k: int = 20) -> DataFrame:
        """(id, score, source, document_id, file_name, content) of a chat's best chunks; an empty list of documents is an error."""
        if document_ids is not None and not [d for d in document_ids if d.strip()]:
            raise ValueError("no document ids")
        own = self.chunks.filter(F.col("chat_id") == chat_id)
        if document_ids is not None:
            own = own.filter(F.col("document_id").isin(sorted({d.strip() for d in document_ids if d.strip()})))
        indexed = own.withColumn("_t", F.coalesce(F.nullif(F.trim("retrieval_text"), F.lit("")), F.col("content")) if "retrieval_text" in own.columns else F.col("content"))
        paths = [("bm25", S.Index(indexed, "chunk_id", "_t").search(query, 20))]
        if "embedding" in own.columns and any(vec := self.hooks.safely("embed", [], query)):
            paths.insert(0, ("vector", V.top_by_vector(own, "embedding", vec, "chunk_id", 20)))
        pool = S.fuse(paths, 20).join(own.select(F.col("chunk_id").alias("id"), "document_id", "file_name", "content"), "id")
        try:
            return S.rerank(pool, "content", query, top_k, self.hooks.scorer).drop("pool_position")
        except Exception:  # noqa: BLE001 the fused order is the fallback of a scorer that fails
            return pool.orderBy(F.desc("score"), "pool_position").limit(top_k).drop("pool_position")

    def packed(self, found: DataFrame, budget: int) -> str:
        """The found chunks as escaped markup within the budget, those that do not fit left out."""
        body = F.concat(F.lit('<chunk id="'), F.col("id").cast("string"), F.lit('" file="'), X.escaped(F.col("file_name")), F.lit('">'), X.escaped(F.col("content")), F.lit("</chunk>"))
        out, used = [], 2 * (len("<chunks>") // 4 + 1)
        for (text,) in found.orderBy(F.desc("score"), "id").select(body).collect():  # at most top_k
            cost = len(text or "") // 4 + 1
            if text and used + cost <= budget:
                used += cost
                out.append(text)
        return "<chunks>" + "".join(out) + "</chunks>" if out else ""

    def without(self, chat_id: str, document_id: str | None = None) -> tuple[DataFrame, int, int]:
        """The chunks left after deleting a document or a chat's whole library, and how many documents and chunks went."""
        gone = F.col("chat_id") == chat_id
        if document_id is not None:
            gone = gone & (F.col("document_id") == document_id)
        n = self.chunks.filter(gone).agg(F.countDistinct("document_id"), F.count(F.lit(1))).first()
        return self.chunks.filter(~F.coalesce(gone, F.lit(False))), int(n[0]), int(n[1])
