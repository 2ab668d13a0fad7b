"""Queries of windows, vectors, retrieval, resolution, trees and increments over the memory corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.functions import vectors as V
from mnemoframe.operators import memory as M
from mnemoframe.operators import resolution as E
from mnemoframe.operators import search as S
from mnemoframe.operators import trees as G
from mnemoframe.operators.hierarchy import hierarchy
from mnemoframe.plans.scalars import BASE

QUERIES, ORACLE = {}, {}
QUESTION = "braided kettle near the insurance harbour"
_TERMS = "('braided', 'harbour', 'insurance', 'kettle', 'near', 'the')"


def query(sql):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(M.Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE[fn.__name__] = BASE + sql
        return fn

    return add


_STEM = r"""lambda t: CASE WHEN regexp_matches(t, '[^ea]ies$') THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_matches(t, '[^aeo]es$') OR regexp_matches(t, '[^aeousi]s$') THEN regexp_replace(t, 's$', '') ELSE t END"""


def bm25(source: str, key: str, col: str, name: str, terms: str = _TERMS, stemmed: bool = False) -> str:
    """CTEs up to one called name with (id, score) of the rows of source."""
    cjk = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
    found = rf"regexp_extract_all(regexp_replace(lower({col}), '({cjk})', ' \1 ', 'g'), '{cjk}|[\p{{L}}\p{{N}}]+')"
    return f""",
{name}_w AS (SELECT {key} AS id, {f'list_transform({found}, {_STEM})' if stemmed else found} AS w FROM {source} WHERE {col} IS NOT NULL),
{name}_n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM {name}_w),
{name}_p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM {name}_w) WHERE term IN {terms} GROUP BY 1, 2, 3),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name} AS (SELECT id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_p JOIN {name}_d USING (term), {name}_n GROUP BY 1)"""


#: Active facts with the text that is searched: the stored one, or built from the text where none is stored.
_SEARCHED = r""",
srch AS (SELECT id, coalesce(nullif(trim(search_text), ''), regexp_replace(regexp_replace(text, '\[([^\[\]]+?)::([^\[\]]+)\]', '\1', 'g'), '\[([^\[\]:]+)\]', '\1', 'g')) AS st FROM act)"""


def facts_bm25(name: str, terms: str = _TERMS) -> str:
    return _SEARCHED + bm25("srch", "id", "st", name, terms, True)


def _facts(c):
    return M.active(c.facts)


def _fact_index(c):
    return S.Index(M.with_searched_text(_facts(c)), "id", "st", True)


def _vector(c, fact_id: int = 2) -> list[float]:
    """The vector of one fact, as the question's."""
    row = c.facts.filter((F.col("id") == fact_id) & V.is_vector(F.col("text_embedding"), 64)).select("text_embedding").first()
    return [float(x) for x in row[0]] if row else [0.0] * 64


_VEC = """,
q AS (SELECT text_embedding AS qv FROM facts WHERE id = 2 LIMIT 1),
fv AS (SELECT DISTINCT f.id, f.task_id, f.text_embedding AS v FROM facts f JOIN act a ON a.id = f.id WHERE len(f.text_embedding) = 64 AND len(list_filter(f.text_embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vec AS (SELECT fv.id, round(list_sum(list_transform(list_zip(v, qv), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score FROM fv, q)"""


@query("SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY position DESC, id DESC) AS r FROM messages) WHERE r = 1")
def w1_last_messages(c):
    return M.latest_of(c.messages, ["session_id"], [F.desc("position"), F.desc("id")]).select("session_id", "id")


@query("""SELECT session_id, id FROM (SELECT session_id, id, sum(length(coalesce(content, '')) // 4 + 1) OVER (PARTITION BY session_id ORDER BY position, id ROWS UNBOUNDED PRECEDING) AS used FROM messages) WHERE used <= 60""")
def w5_budget_prefix(c):
    cost = X.token_estimate(F.coalesce("content", F.lit("")))
    return S.pack_prefix(c.messages, ["session_id"], [F.col("position"), F.col("id")], cost, 60).select("session_id", "id")


@query(""", o AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY position, id) AS r, length(coalesce(content, '')) // 4 + 1 AS cost FROM messages),
f AS (SELECT session_id, id, r, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS used, cost <= 60 AS kept FROM o WHERE r = 1
  UNION ALL SELECT o.session_id, o.id, o.r, CASE WHEN f.used + o.cost <= 60 THEN f.used + o.cost ELSE f.used END, f.used + o.cost <= 60 FROM f JOIN o ON o.session_id = f.session_id AND o.r = f.r + 1)
SELECT session_id, id FROM f WHERE kept""")
def w6_budget_skipping(c):
    own = c.messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", X.token_estimate(F.coalesce("content", F.lit(""))).alias("n")))).alias("m"))
    items = F.transform("m", lambda x: F.struct(x["n"].alias("cost"), x["id"].alias("key")))
    return own.select("session_id", F.explode(S.pack_skipping(items, 60)).alias("k")).select("session_id", F.col("k.key").alias("id"))


@query(""", o AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY position, id) AS r, length(coalesce(content, '')) AS len FROM messages),
f AS (SELECT session_id, r, 0 AS batch_index, 1 AS n, len AS chars FROM o WHERE r = 1
  UNION ALL SELECT o.session_id, o.r, CASE WHEN f.n >= 5 OR f.chars + o.len > 400 THEN f.batch_index + 1 ELSE f.batch_index END, CASE WHEN f.n >= 5 OR f.chars + o.len > 400 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 5 OR f.chars + o.len > 400 THEN o.len ELSE f.chars + o.len END
  FROM f JOIN o ON o.session_id = f.session_id AND o.r = f.r + 1)
SELECT session_id, batch_index, max(n) AS n_messages, max(chars) AS n_chars FROM f GROUP BY 1, 2""")
def w7_message_batches(c):
    return M.message_batches(c.messages, 5, 400)


@query(r""", t AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '[\s\x0b]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT id, i AS "window", array_to_string(w[i * 70 + 1:i * 70 + 80], ' ') AS content, len(w[i * 70 + 1:i * 70 + 80]) AS n_tokens FROM t, unnest(range(0, greatest(CAST(ceil((len(w) - 80) / 70.0) AS BIGINT), 0) + 1)) AS r(i) WHERE len(w) > 0""")
def w9_token_windows(c):
    return M.token_windows(M.table(c.spark, c.folder, "documents"), "doc_id", "text", 80, 10)


@query("SELECT id, task_id, fact_ts AS filled FROM (SELECT id, task_id, last_value(nullif(trim(fact_ts), '') IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS fact_ts FROM fcts) WHERE fact_ts IS NOT NULL")
def w11_forward_fill(c):
    return M.forward_filled(c.facts.select("id", "task_id", "fact_ts"), ["task_id"], "id", "fact_ts").select("id", "task_id", F.col("fact_ts").alias("filled"))


@query("SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY position, id) - 1 AS pos FROM messages")
def w12_renumbered(c):
    return c.messages.select("session_id", "id", (F.row_number().over(Window.partitionBy("session_id").orderBy("position", "id")) - 1).alias("pos"))


@query("""SELECT session_id, id FROM (SELECT session_id, id, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY position DESC, id DESC) AS r FROM messages)
WHERE r <= CASE WHEN n > 8 THEN n - CAST(ceil((n - 8) / 4.0) AS BIGINT) * 4 ELSE n END""")
def w13_trunk(c):
    return M.trunk(c.messages, ["session_id"], [F.desc("position"), F.desc("id")], 8, 4).select("session_id", "id")


@query("SELECT id, session_id, CASE WHEN a IS NULL THEN session_time ELSE message_time END AS message_time FROM (SELECT m.id, m.session_id, m.message_time, max(m.message_time) OVER (PARTITION BY m.session_id) AS a, s.session_time FROM messages m LEFT JOIN sessions s ON m.session_id = s.id)")
def w18_backfilled_times(c):
    return M.backfilled_times(c.sessions, c.messages)


@query(_VEC + " SELECT id, score FROM vec ORDER BY score DESC, id LIMIT 20")
def r2_vector_facts(c):
    return V.top_by_vector(_facts(c), "text_embedding", _vector(c), "id", 20)


@query(_VEC + " SELECT id, score FROM vec WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 5")
def f4_similar_enough(c):
    return V.top_by_vector(_facts(c), "text_embedding", _vector(c), "id", 5, 0.3)


@query(_VEC + """, qs AS (SELECT id AS query_id, v AS qv FROM fv WHERE id % 100 = 0),
sc AS (SELECT query_id, id AS item_id, round(list_sum(list_transform(list_zip(v, qs.qv), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score FROM fv, qs)
SELECT query_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM sc WHERE score >= 0.6) WHERE r <= 5""")
def j12_nearest_of_queries(c):
    ok = _facts(c).filter(V.is_vector(F.col("text_embedding"), 64)).select("id", "text_embedding")
    q = ok.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("text_embedding").alias("query_vec"))
    return V.nearest_of_few(q, ok.select(F.col("id").alias("item_id"), F.col("text_embedding").alias("item_vec")), 5, 0.6, 100_000)


@query(_VEC + " SELECT task_id, i AS pos, sum(CAST(v[i] AS DOUBLE)) / count(*) AS mean FROM fv, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2")
def a19_mean_vectors(c):
    ok = _facts(c).filter(V.is_vector(F.col("text_embedding"), 64))
    m = V.mean_vector(ok, ["task_id"], "text_embedding")
    return m.select("task_id", F.posexplode("centroid").alias("p", "m")).select("task_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("m").alias("mean"))


@query(facts_bm25("bm") + " SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def r1_bm25_facts(c):
    return _fact_index(c).search(QUESTION, 20)


@query(facts_bm25("bm", "('kettle', 'near')") + " SELECT id, score FROM bm WHERE id IN (SELECT id FROM bm_p WHERE term = 'kettle') ORDER BY score DESC, id LIMIT 20")
def r3_boolean_facts(c):
    return _fact_index(c).search("+kettle near", 20)


@query(bm25("messages", "id", "content", "bm", "('parser', 'regression')") + " SELECT b.id, b.score FROM bm b JOIN messages m ON b.id = m.id WHERE lower(trim(m.speaker)) = 'user' ORDER BY score DESC, b.id LIMIT 20")
def r4_bm25_messages(c):
    keep = c.messages.filter(F.lower(F.trim("speaker")) == "user").select("id")
    return S.Index(c.messages, "id", "content").search("parser regression", 20, keep)


@query(bm25("summaries", "session_id", "content", "bm", "('parser', 'regression')", True) + " SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
def r5_bm25_sessions(c):
    return S.Index(c.summaries, "session_id", "content", True).search("parser regression", 10)


@query(bm25("ents", "id", "canonical_ref", "bm", "('polar', 'association')") + " SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def r7_bm25_names(c):
    return S.Index(c.entities, "id", "canonical_ref").search("polar association", 20)


_FUSED = facts_bm25("bm") + _VEC + """,
pa AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm ORDER BY score DESC, id LIMIT 20),
pb AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vec ORDER BY score DESC, id LIMIT 20),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(o * 1000000 + rank) AS pos FROM (SELECT id, rank, 0 AS o FROM pa UNION ALL SELECT id, rank, 1 FROM pb) GROUP BY 1)"""


def _paths(c):
    return [("bm25", _fact_index(c).search(QUESTION, 20)), ("vector", V.top_by_vector(_facts(c), "text_embedding", _vector(c), "id", 20))]


@query(_FUSED + " SELECT id, score, CASE WHEN pos < 1000000 THEN 'bm25' ELSE 'vector' END AS source FROM fused ORDER BY score DESC, pos LIMIT 12")
def r14_fused_facts(c):
    return S.fuse(_paths(c), 12).select("id", "score", "source")


@query(_FUSED + " SELECT id, CASE WHEN pos < 1000000 THEN 'bm25' ELSE 'vector' END AS source FROM fused")
def w3_first_seen(c):
    return S.first_seen(_paths(c)).select("id", "source")


@query(_FUSED + ", top AS (SELECT * FROM fused ORDER BY score DESC, pos LIMIT 12) SELECT session_id, round(sum(score), 6) AS score, count(*) AS n_facts FROM top JOIN sources ON id = fact_id GROUP BY 1")
def r17_fact_sessions(c):
    return M.session_scores(S.fuse(_paths(c), 12).select("id", "score"), c.sources)


@query(_FUSED + r""", top AS (SELECT t.id, row_number() OVER (ORDER BY t.score DESC, t.pos) AS r, coalesce(nullif(f.fact_ts, ''), 'zzz') AS ts, length('- ' || regexp_replace(f.text, '\[([^\[\]]+?)::([^\[\]]+)\]', '[\2]', 'g')) // 4 + 1 AS cost FROM (SELECT * FROM fused ORDER BY score DESC, pos LIMIT 12) t JOIN act f USING (id)),
walk AS (SELECT 0::BIGINT AS r, 0::BIGINT AS used, NULL::BIGINT AS id, '' AS ts, false AS kept UNION ALL SELECT t.r, CASE WHEN w.used + t.cost <= 160 THEN w.used + t.cost ELSE w.used END, t.id, t.ts, w.used + t.cost <= 160 FROM walk w JOIN top t ON t.r = w.r + 1)
SELECT id, row_number() OVER (ORDER BY ts, r) AS place FROM walk WHERE kept""")
def r20_packed_facts(c):
    top = S.fuse(_paths(c), 12).join(_facts(c).select("id", "text", "fact_ts"), "id")
    cost = X.token_estimate(F.concat(F.lit("- "), X.inline_dates(F.col("text"))))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "pool_position"))  # at most 12 rows
    top = top.select("id", "fact_ts", cost.alias("cost"), rank.alias("r"))
    kept = top.agg(F.array_sort(F.collect_list(F.struct("r", "cost", "id"))).alias("m")).select(F.explode(S.pack_skipping(F.transform("m", lambda x: F.struct(x["cost"].alias("cost"), x["id"].alias("key"))), 160)).alias("k")).select(F.col("k.key").alias("id"))
    by_time = Window.orderBy(F.coalesce(F.nullif("fact_ts", F.lit("")), F.lit("zzz")), "r")
    return top.join(kept, "id").select("id", F.row_number().over(by_time).cast("long").alias("place"))


@query(None)
def r15_reranked_facts(c):
    pool = S.fuse(_paths(c)).join(_facts(c).select("id", "text"), "id")
    return S.rerank(pool, "text", QUESTION, 12).select("id", "score")


@query(bm25("chunks", "chunk_id", "content", "bm", "('parser', 'regression')") + " SELECT b.id, b.score, c.document_id FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT 20) b JOIN chunks c ON b.id = c.chunk_id")
def r24_file_search(c):
    found = S.Index(c.chunks, "chunk_id", "content").search("parser regression", 20)
    return found.join(c.chunks.select(F.col("chunk_id").alias("id"), "document_id"), "id")


@query("SELECT l.id, p.id AS parent, g.id AS grandparent, l.entity_id FROM nds l JOIN nds p ON l.parent_id = p.id LEFT JOIN nds g ON p.parent_id = g.id WHERE l.fact_id IS NOT NULL")
def j6_leaf_ancestry(c):
    p = c.nodes.select(F.col("id").alias("parent"), F.col("parent_id").alias("over"))
    g = c.nodes.select(F.col("id").alias("grandparent"))
    own = c.nodes.filter("fact_id is not null").join(p, F.col("parent_id") == F.col("parent")).join(g, F.col("over") == F.col("grandparent"), "left")
    return own.select("id", "parent", "grandparent", "entity_id")


@query("""SELECT l.id, CASE WHEN p.id IS NOT NULL AND p.parent_id IS NOT NULL AND g.id IS NOT NULL AND g.parent_id IS NOT NULL THEN coalesce(g.description, '') || ' > ' || coalesce(p.description, '')
   WHEN p.id IS NOT NULL AND p.parent_id IS NOT NULL THEN coalesce(p.description, '') ELSE '' END AS aspect_path
FROM nds l LEFT JOIN nds p ON l.parent_id = p.id LEFT JOIN nds g ON p.parent_id = g.id WHERE l.fact_id IS NOT NULL""")
def r12_aspect_paths(c):
    return G.aspect_paths(c.nodes, c.entities).select("id", "aspect_path")


_SHINGLES = r""", nm AS (SELECT id, task_id, entity_id, replace(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(canonical_ref), '\s+', ' ', 'g')), '[^a-z0-9'' ]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '') AS s FROM ents),
sh AS (SELECT id, task_id, CASE WHEN length(s) = 0 THEN []::VARCHAR[] WHEN length(s) < 3 THEN [s] ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) END AS g FROM nm)"""


@query(_SHINGLES + " SELECT id, unnest(g) AS shingle FROM sh")
def x16_shingles(c):
    return E.shingled(c.entities).select("id", F.explode("shingles").alias("shingle"))


@query(_SHINGLES + ", hs AS (SELECT DISTINCT id, seed, CAST('0x' || substring(md5(CAST(seed AS VARCHAR) || ':' || x), 1, 15) AS BIGINT) AS h FROM (SELECT id, unnest(g) AS x FROM sh), unnest(range(0, 32)) AS r(seed)) SELECT id, seed, min(h) AS least FROM hs GROUP BY 1, 2")
def e3_minhash(c):
    return E.signed(E.shingled(c.entities)).select("id", F.posexplode("signature").alias("seed", "least")).select("id", F.col("seed").cast("long").alias("seed"), "least")


@query(_SHINGLES + """, hs AS (SELECT id, task_id, seed, min(CAST('0x' || substring(md5(CAST(seed AS VARCHAR) || ':' || x), 1, 15) AS BIGINT)) AS h FROM (SELECT id, task_id, unnest(g) AS x FROM sh), unnest(range(0, 32)) AS r(seed) GROUP BY 1, 2, 3),
bands AS (SELECT id, task_id, seed // 4 AS band, string_agg(CAST(h AS VARCHAR), ',' ORDER BY seed) AS b FROM hs GROUP BY 1, 2, 3),
cand AS (SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM bands x JOIN bands y ON x.task_id = y.task_id AND x.band = y.band AND x.b = y.b AND x.id < y.id)
SELECT id_a, id_b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM cand JOIN sh a ON a.id = id_a JOIN sh b ON b.id = id_b WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.9""")
def e8_similar_names(c):
    return E.banded_pairs(E.signed(E.shingled(c.entities)), 0.9)


@query(r", nm AS (SELECT id, task_id, trim(regexp_replace(lower(canonical_ref), '\s+', ' ', 'g')) AS name FROM ents) SELECT task_id, name, count(*) AS n, CASE WHEN count(*) = 1 THEN 'merge' ELSE 'ambiguous' END AS verdict FROM nm GROUP BY 1, 2")
def e7_exact_names(c):
    return E.exact_layer(c.entities)


@query(r""", fz AS (SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(canonical_ref), '\s+', ' ', 'g')), '[^a-z0-9'' ]', ' ', 'g'), '\s+', ' ', 'g')) AS f FROM ents),
ch AS (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(string_split(replace(f, ' ', ''), '')) AS c FROM fz) WHERE c <> '' GROUP BY 1, 2),
h AS (SELECT id, -sum(p * log2(p)) AS h FROM (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM ch) GROUP BY 1)
SELECT id, (length(f) < 6 AND len(string_split_regex(f, '\s+')) < 2) OR coalesce(h, 0) < 1.5 AS rejected FROM fz LEFT JOIN h USING (id)""")
def e5_rejected_names(c):
    return c.entities.select("id", E.entropy_rejected(X.fuzzy_name(F.col("canonical_ref"))).alias("rejected"))


@query("SELECT task_id, text, min(id) AS kept, count(*) AS n FROM fcts GROUP BY 1, 2")
def e16_reused_facts(c):
    return c.facts.groupBy("task_id", "text").agg(F.min("id").alias("kept"), F.count(F.lit(1)).alias("n"))


@query("SELECT id, concat_ws(' | ', canonical_ref, nullif(trim(coalesce(\"desc\", '')), '')) AS text FROM ents")
def e17_entity_text(c):
    return c.entities.select("id", F.concat_ws(" | ", "canonical_ref", F.nullif(F.trim(F.coalesce("desc", F.lit(""))), F.lit(""))).alias("text"))


@query("SELECT id, CAST(round_even(2 + 1.3 * ln(support), 0) AS INTEGER) AS most_depth FROM nds WHERE support > 0")
def g7_depth_limits(c):
    return c.nodes.filter("support > 0").select("id", G.most_depth(F.col("support")).alias("most_depth"))


_PLACED = """, walk AS (
  SELECT id, id AS root_id, 0 AS depth FROM nds WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM nds)
  UNION ALL SELECT n.id, w.root_id, w.depth + 1 FROM nds n JOIN walk w ON n.parent_id = w.id),
width AS (SELECT parent_id AS id, count(*) AS width FROM nds WHERE parent_id IS NOT NULL GROUP BY 1)"""


@query(_PLACED + " SELECT id, depth FROM walk")
def g9_depths(c):
    return hierarchy(c.nodes, tree_col="entity_id").filter("depth is not null").select("id", "depth")


@query(_PLACED + """, debts AS (SELECT n.id, n.entity_id, round(coalesce(n.uncertainty_score, 0) + 3 * greatest(0, wd.width - (3 + 1.5 * log2(1 + greatest(coalesce(n.support, 0), 0)))) + 5 * greatest(0, w.depth - CASE WHEN n.support > 0 THEN CAST(round_even(2 + 1.3 * ln(n.support), 0) AS INTEGER) ELSE 999 END), 6) AS debt
  FROM nds n JOIN walk w USING (id) JOIN width wd USING (id)) SELECT id, entity_id, debt FROM debts""")
def g8_structural_debt(c):
    return G.with_debt(c.nodes)


@query(_PLACED + """, debts AS (SELECT n.id, n.entity_id, round(coalesce(n.uncertainty_score, 0) + 3 * greatest(0, wd.width - (3 + 1.5 * log2(1 + greatest(coalesce(n.support, 0), 0)))) + 5 * greatest(0, w.depth - CASE WHEN n.support > 0 THEN CAST(round_even(2 + 1.3 * ln(n.support), 0) AS INTEGER) ELSE 999 END), 6) AS debt
  FROM nds n JOIN walk w USING (id) JOIN width wd USING (id)) SELECT id, debt FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY debt DESC, id) AS p FROM debts WHERE debt >= 10) WHERE p <= 5""")
def g11_audit_candidates(c):
    return G.audit_candidates(G.with_debt(c.nodes)).select("id", "debt")


@query(_PLACED + """, up AS (SELECT id AS leaf, id AS spot FROM walk WHERE id NOT IN (SELECT id FROM width) UNION ALL SELECT u.leaf, n.parent_id FROM up u JOIN nds n ON u.spot = n.id WHERE n.parent_id IN (SELECT id FROM nds)) SELECT spot AS id, count(*) AS support FROM up GROUP BY 1""")
def g6_supports(c):
    return G.supports(c.nodes, hierarchy(c.nodes, tree_col="entity_id", with_paths=True).filter("root_id <> -1"))


@query("""SELECT parent_id, id, CAST(floor((r - 1) / ceil(n / ceil(n / 15.0))) AS INTEGER) AS part FROM (SELECT parent_id, id, count(*) OVER (PARTITION BY parent_id) AS n, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS r FROM nds WHERE parent_id IS NOT NULL) WHERE n > 15""")
def g14_split_groups(c):
    return G.split_groups(c.nodes)


_FLOOR = "(CASE WHEN abs(exp(({d} - 2) / 1.3) - round(exp(({d} - 2) / 1.3))) <= 0.1 THEN round(exp(({d} - 2) / 1.3)) ELSE ceil(exp(({d} - 2) / 1.3)) END)"


@query(_PLACED + f""", asp AS (SELECT n.id, n.parent_id, coalesce(n.support, 0) AS support, w.depth, p.parent_id IS NULL OR p.parent_id NOT IN (SELECT id FROM nds) AS under_root, coalesce(p.support, 0) AS p_support,
  (SELECT count(*) FROM nds k WHERE k.parent_id = n.id) AS kids FROM nds n JOIN walk w USING (id) JOIN nds p ON p.id = n.parent_id WHERE n.fact_id IS NULL)
SELECT id FROM asp WHERE kids <= 1 OR (NOT under_root AND support < {_FLOOR.format(d='depth')} AND p_support < {_FLOOR.format(d='(depth - 1)')})""")
def g15_dissolvable(c):
    return G.dissolvable(c.nodes)


@query("SELECT parent_id AS id, bool_and(id NOT IN (SELECT parent_id FROM nds WHERE parent_id IS NOT NULL)) AS flat FROM nds WHERE parent_id IS NOT NULL GROUP BY 1")
def n18_flat_nodes(c):
    return G.is_flat(c.nodes)


@query(_PLACED + """, ranked AS (SELECT id, parent_id, fact_id, row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(uncertainty_score, 0) DESC, id) AS r FROM nds WHERE parent_id IS NOT NULL),
lvl AS (SELECT id AS root_id, id AS spot, NULL::BIGINT AS fact_id FROM walk WHERE depth = 0 UNION ALL SELECT l.root_id, k.id, k.fact_id FROM lvl l JOIN ranked k ON k.parent_id = l.spot AND k.r <= 3 WHERE l.fact_id IS NULL)
SELECT DISTINCT root_id, fact_id FROM lvl WHERE fact_id IS NOT NULL""")
def r10_beam_facts(c):
    return G.beam(c.nodes, c.nodes.select("id", F.coalesce("uncertainty_score", F.lit(0.0)).alias("score")))


@query("SELECT count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents FROM chunks WHERE chat_id = 'chat-0000'")
def z8_library_counts(c):
    return c.chunks.filter("chat_id = 'chat-0000'").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"))


@query("SELECT id FROM messages WHERE session_id = 1 AND position >= (SELECT max(position) FROM messages WHERE session_id = 1) - 1")
def z9_from_message_on(c):
    last = c.messages.filter("session_id = 1").agg(F.max("position").alias("p"))
    return c.messages.filter("session_id = 1").join(F.broadcast(last), F.col("position") >= F.col("p") - 1).select("id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def z10_tumbling_windows(c):
    return M.table(c.spark, c.folder, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def z10_session_windows(c):
    e = M.table(c.spark, c.folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start")).select("user_id", "start", "n")


for _name in [n for n, sql in ORACLE.items() if _PLACED in sql or "\nf AS (SELECT session_id" in sql or "walk AS (SELECT 0" in sql]:
    ORACLE[_name] = ORACLE[_name].replace("WITH sessions", "WITH RECURSIVE sessions", 1)
