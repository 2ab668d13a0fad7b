"""Queries of the entity and tree paths of a search, stored indexes, reuse by identity and tree updates, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.functions import vectors as V
from mnemoframe.operators import memory as M
from mnemoframe.operators import search as S
from mnemoframe.operators import trees as G
from mnemoframe.operators.hierarchy import hierarchy
from mnemoframe.plans.retrieval import _PLACED, _VEC, _vector, bm25, facts_bm25
from mnemoframe.plans.scalars import BASE
from mnemoframe.runtime import _own_folder

QUERIES, ORACLE = {}, {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(M.Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE[fn.__name__] = BASE.replace("WITH sessions", "WITH RECURSIVE sessions", 1) + sql
        return fn

    return add


def _index(c):
    return S.Index(M.with_searched_text(M.active(c.facts)), "id", "st", True)


@query(facts_bm25("bm", "('kettle', 'insurance', 'harbour')") + " SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def s23_stored_index(c):
    """The index as written tables: a search reads the parts of its own terms only."""
    return _index(c).written(f"{_own_folder(c.spark)}/{uuid.uuid4().hex}").search("kettles insurance harbours", 20)


@query(facts_bm25("bm", "('猫', '和')") + " SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def r1_bm25_cjk(c):
    return _index(c).search("猫和", 20)


@query(facts_bm25("bm", "('für', 'über')") + " SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def r1_bm25_umlauts(c):
    return _index(c).search("für über", 20)


@query(bm25("summaries", "session_id", "content", "bm", "('parser', 'regression')", True) + " SELECT id, score FROM bm WHERE id IN (SELECT id FROM bm_p WHERE term = 'parser') ORDER BY score DESC, id LIMIT 5")
def r6_parsed_sessions(c):
    return S.Index(c.summaries, "session_id", "content", True).search("+parser regression", 5)


_LIBRARY = ", lib AS (SELECT chunk_id, document_id, coalesce(nullif(trim(retrieval_text), ''), content) AS t FROM chunks)"


@query(_LIBRARY + bm25("lib", "chunk_id", "t", "bm", "('parser', 'regression')") + """,
top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm ORDER BY score DESC, id LIMIT 20),
tk AS (SELECT id, list_distinct(regexp_extract_all(regexp_replace(lower(t), '([\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}])', ' \\1 ', 'g'), '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]|[\\p{L}\\p{N}]+')) AS w, r FROM top JOIN lib ON id = chunk_id)
SELECT id, round(len(list_intersect(w, ['parser', 'regression'])) / len(list_distinct(list_concat(w, ['parser', 'regression']))), 6) AS score FROM tk ORDER BY score DESC, r LIMIT 10""".replace("\\\\", "\\"))
def r24_reranked_chunks(c):
    """Chunks by the text that is made for retrieval, ranked again by the share of common words."""
    lib = c.chunks.withColumn("t", F.coalesce(F.nullif(F.trim("retrieval_text"), F.lit("")), F.col("content")))
    pool = S.fuse([("bm25", S.Index(lib, "chunk_id", "t").search("parser regression", 20))]).join(lib.select(F.col("chunk_id").alias("id"), "t"), "id")
    return S.rerank(pool, "t", "parser regression", 10).select("id", "score")


_ENTITY_VEC = """,
ev AS (SELECT DISTINCT id, entity_id, desc_embedding AS v FROM entities WHERE len(desc_embedding) = 64 AND len(list_filter(desc_embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
es AS (SELECT entity_id, max(CASE WHEN list_sum(list_transform(v, lambda x: abs(x))) = 0 THEN 0 ELSE round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) END) AS score FROM ev, q GROUP BY 1),
etop AS (SELECT entity_id, score, row_number() OVER (ORDER BY score DESC, entity_id) AS r FROM es ORDER BY score DESC, entity_id LIMIT 10)"""
_MATCHED = bm25("ents", "id", "canonical_ref", "an", "('polar', 'association')") + """,
atop AS (SELECT entity_id, row_number() OVER (ORDER BY s DESC, entity_id) AS r FROM (SELECT e.entity_id, max(a.score) AS s FROM an a JOIN ents e ON a.id = e.id GROUP BY 1) ORDER BY s DESC, entity_id LIMIT 10),
hit AS (SELECT entity_id, max(score) AS score, min(place) AS place FROM (SELECT entity_id, 1.0::DOUBLE AS score, r AS place FROM atop UNION ALL SELECT entity_id, score, 1000000 + r FROM etop) GROUP BY 1),
chosen AS (SELECT entity_id, score FROM hit ORDER BY score DESC, place LIMIT 5)"""


def _sides(c):
    q = F.array(*[F.lit(x) for x in _vector(c)])
    names = S.Index(c.entities, "id", "canonical_ref").search("polar association", None).join(c.entities.select("id", "entity_id"), "id").groupBy(F.col("entity_id")).agg(F.max("score").alias("score"))
    vectors = c.entities.filter(V.is_vector(F.col("desc_embedding"), 64)).select("entity_id", F.round(V.cosine(F.col("desc_embedding"), q), 6).alias("score")).groupBy(F.col("entity_id").alias("id")).agg(F.max("score").alias("score"))
    return names, vectors.orderBy(F.desc("score"), "id").limit(10)


@query(_VEC + _ENTITY_VEC + " SELECT entity_id, score FROM etop")
def r8_entity_vectors(c):
    return _sides(c)[1].select(F.col("id").alias("entity_id"), "score")


@query(_VEC + _ENTITY_VEC + _MATCHED + " SELECT entity_id, score FROM chosen")
def r9_matched_entities(c):
    names, vectors = _sides(c)
    top = names.select(F.col("entity_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(10)
    return S.matched_entities(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))), vectors)


@query(_VEC + _ENTITY_VEC + _MATCHED + _PLACED.replace("FROM nds", "FROM own").replace("own n JOIN", "own n JOIN").replace("nds n JOIN", "own n JOIN").replace(", walk AS", ", own_ AS (SELECT n.* FROM nds n JOIN chosen USING (entity_id)), walk AS").replace("FROM own", "FROM own_").replace("own n", "own_ n") + """,
lk AS (SELECT n.id, CASE WHEN fv.id IS NULL OR list_sum(list_transform(fv.v, lambda x: abs(x))) = 0 THEN 0 ELSE round(list_cosine_similarity(CAST(fv.v AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) END AS s FROM own_ n LEFT JOIN fv ON n.fact_id = fv.id, q),
ranked AS (SELECT n.id, n.parent_id, n.fact_id, row_number() OVER (PARTITION BY n.parent_id ORDER BY lk.s DESC, n.id) AS r FROM own_ n JOIN lk USING (id) WHERE n.parent_id IS NOT NULL),
lvl AS (SELECT id AS root_id, id AS spot, NULL::BIGINT AS fact_id FROM walk WHERE depth = 0 UNION ALL SELECT l.root_id, k.id, k.fact_id FROM lvl l JOIN ranked k ON k.parent_id = l.spot AND k.r <= 3 WHERE l.fact_id IS NULL)
SELECT DISTINCT v.id, v.score FROM vec v WHERE v.id IN (SELECT fact_id FROM lvl) ORDER BY score DESC, id LIMIT 20""")
def r11_tree_facts(c):
    return G.tree_facts(c.nodes, M.active(c.facts), c.entities, _sides(c)[0], _vector(c))


@query(_VEC + """, o AS (SELECT n.fact_id AS id, n.entity_id AS leaf, CAST(n.task_id AS VARCHAR) AS mid, row_number() OVER (ORDER BY v.score DESC, v.id) AS r FROM (SELECT DISTINCT id, score FROM vec ORDER BY score DESC, id LIMIT 60) v JOIN (SELECT fact_id, min(entity_id) AS entity_id, min(task_id) AS task_id FROM nds WHERE fact_id IS NOT NULL GROUP BY 1) n ON n.fact_id = v.id),
walk AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS l, []::VARCHAR[] AS m, NULL::BIGINT AS id, false AS kept
  UNION ALL SELECT o.r, CASE WHEN ok THEN list_append(l, leaf) ELSE l END, CASE WHEN ok THEN list_append(m, mid) ELSE m END, oid, ok FROM (SELECT o.r, o.leaf, o.mid, o.id AS oid, w.l, w.m, len(list_filter(w.l, lambda x: x = o.leaf)) < 1 AND len(list_filter(w.m, lambda x: x = o.mid)) < 2 AS ok FROM walk w JOIN o ON o.r = w.r + 1) o)
SELECT id FROM walk WHERE kept""")
def r13_capped_facts(c):
    """Of the best facts in order at most one of an entity and two of a task."""
    top = V.top_by_vector(M.active(c.facts), "text_embedding", _vector(c), "id", 60)
    n = c.nodes.filter("fact_id is not null").groupBy("fact_id").agg(F.min("entity_id").alias("leaf"), F.min("task_id").cast("string").alias("mid"))
    rows = top.join(n, F.col("id") == F.col("fact_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "leaf", "mid"))).alias("m"))
    items = F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), x["mid"].alias("mid")))
    return rows.select(F.explode(S.capped(items, 1, 2)).alias("k")).select(F.col("k.id").alias("id"))


_SETS = ", sets AS (SELECT f.id, f.task_id, f.text, coalesce(string_agg(DISTINCT r.entity_id, ',' ORDER BY r.entity_id), '') AS e FROM fcts f LEFT JOIN refs r ON r.fact_id = f.id GROUP BY 1, 2, 3)"


def _with_entities(c):
    e = c.refs.filter("entity_id is not null").groupBy("fact_id").agg(F.collect_set("entity_id").alias("entities"))
    return c.facts.select("id", "task_id", "text").join(e, F.col("id") == F.col("fact_id"), "left").drop("fact_id")


@query(_SETS + " SELECT id AS key, min(id) OVER (PARTITION BY task_id, text, e) AS fact_id FROM sets")
def e13_reused_by_identity(c):
    """The stored fact that each fact would be: same task, text and set of entities."""
    own = _with_entities(c)
    return M.exact_reuse(own.withColumnRenamed("id", "key"), own)


@query(_SETS + " SELECT id AS fact_id, task_id, min(id) OVER (PARTITION BY task_id, e) AS first_fact FROM sets WHERE contains(e, ',')")
def u5_entity_set_classes(c):
    """Facts of a task with the same set of entities, two at least, by the first fact of their class."""
    own = _with_entities(c).filter(F.size("entities") > 1).withColumn("entities", F.array_sort("entities"))
    first = own.groupBy("task_id", "entities").agg(F.min("id").alias("first_fact"))
    return own.join(first, ["task_id", "entities"]).select(F.col("id").alias("fact_id"), "task_id", "first_fact")


@query("SELECT session_id, id FROM (SELECT session_id, id, position > 4 AS a, row_number() OVER (PARTITION BY session_id, position > 4 ORDER BY position DESC, id DESC) AS r FROM messages WHERE position IS NOT NULL) WHERE a OR r <= 3")
def w14_around_cursor(c):
    """The messages after a cursor and the last three up to it."""
    return M.around_cursor(c.messages.filter("position is not null"), ["session_id"], F.col("position") > 4, [F.desc("position"), F.desc("id")], 3).select("session_id", "id")


@query(_VEC + _PLACED + """, leaf AS (SELECT n.id, fv.v FROM nds n JOIN walk USING (id) JOIN fv ON n.fact_id = fv.id), up AS (SELECT id AS leaf, id AS spot FROM leaf UNION ALL SELECT u.leaf, n.parent_id FROM up u JOIN nds n ON u.spot = n.id WHERE n.parent_id IN (SELECT id FROM nds))
SELECT spot AS id, i AS pos, avg(CAST(v[i] AS DOUBLE)) AS mean FROM up JOIN leaf ON up.leaf = leaf.id, unnest(range(1, 5)) AS r(i) GROUP BY 1, 2""")
def w16_ancestor_centroids(c):
    """The mean vector of the facts under every node, which is what a running mean along the ancestors ends with; its first four positions."""
    ok = M.active(c.facts).filter(V.is_vector(F.col("text_embedding"), 64)).select(F.col("id").alias("f_id"), F.slice("text_embedding", 1, 4).alias("v"))
    leaf = c.nodes.filter("fact_id is not null").join(ok, F.col("fact_id") == F.col("f_id")).select("id", "v")
    over = hierarchy(c.nodes, tree_col="entity_id", with_paths=True).filter("root_id <> -1").select("id", F.explode("path").alias("spot"))
    m = V.mean_vector(leaf.join(over, "id"), ["spot"], "v")
    return m.select(F.col("spot").alias("id"), F.posexplode("centroid").alias("p", "mean")).select("id", (F.col("p") + 1).cast("long").alias("pos"), "mean")


@query("SELECT task_id FROM (SELECT task_id, row_number() OVER (ORDER BY task_id) AS k FROM (SELECT DISTINCT task_id FROM fcts)) WHERE k IN (1, 2, 3, 8)")
def t7_chosen_tasks(c):
    tasks = c.facts.select("task_id").distinct().withColumn("at", F.row_number().over(Window.orderBy("task_id")))  # one row a task
    return tasks.filter(F.col("at").isin(M.chosen("1-3,8", tasks.count()))).select("task_id")


_OLD = ", old AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, parent_id NULLS FIRST) AS r FROM entity_tree_nodes) WHERE r = 1), fresh AS (SELECT * FROM nds WHERE parent_id IS NULL OR parent_id IN (SELECT id FROM nds WHERE parent_id IS NULL))"


@query(_OLD + " SELECT coalesce(f.id, o.id) AS id, CASE WHEN f.id IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'insert' WHEN f.parent_id IS NOT DISTINCT FROM o.parent_id AND f.support IS NOT DISTINCT FROM o.support AND f.uncertainty_score IS NOT DISTINCT FROM o.uncertainty_score THEN 'keep' ELSE 'update' END AS action FROM old o FULL JOIN fresh f ON o.id = f.id")
def s13_tree_changes(c):
    """What turns the first states of the nodes into the latest ones of the roots and the nodes right under them."""
    raw = M.table(c.spark, c.folder, "entity_tree_nodes")
    old = raw.groupBy("id").agg(F.min(F.struct("created_at", "parent_id", "support", "uncertainty_score")).alias("m")).select("id", "m.*")
    roots = c.nodes.filter("parent_id is null")
    new = roots.unionByName(c.nodes.join(roots.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(*roots.columns))
    return M.upserts(old, new, ["parent_id", "support", "uncertainty_score"])


@query(""", sn AS (SELECT session_id, id, left(trim(content), 60) AS p FROM messages WHERE trim(coalesce(content, '')) <> ''),
a AS (SELECT session_id, p, id, row_number() OVER (PARTITION BY session_id, p ORDER BY id) AS k FROM sn),
b AS (SELECT session_id, p, id, row_number() OVER (PARTITION BY session_id, p ORDER BY id DESC) AS k FROM sn)
SELECT a.session_id, a.id AS snippet_id, b.id AS message_id FROM a JOIN b USING (session_id, p, k)""")
def j18_snippets_to_messages(c):
    """Each snippet of 60 characters with the message that begins with it; of several equal ones the k-th with the k-th, here from the other end."""
    sn = c.messages.filter("trim(coalesce(content, '')) <> ''").select("session_id", "id", F.substring(F.trim("content"), 1, 60).alias("p"))
    k = lambda order: F.row_number().over(Window.partitionBy("session_id", "p").orderBy(order))
    a = sn.select("session_id", "p", F.col("id").alias("snippet_id"), k(F.col("id")).alias("k"))
    b = sn.select("session_id", "p", F.col("id").alias("message_id"), k(F.desc("id")).alias("k"))
    return a.join(b, ["session_id", "p", "k"]).select("session_id", "snippet_id", "message_id")


@query(_VEC + " SELECT DISTINCT id, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(qv AS DOUBLE[])), 5) AS cosine FROM fv, q WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0")
def v2_all_cosines(c):
    q = F.array(*[F.lit(x) for x in _vector(c)])
    ok = M.active(c.facts).filter(V.is_vector(F.col("text_embedding"), 64) & (V.norm(F.col("text_embedding")) > 0))
    return ok.select("id", F.round(V.cosine(F.col("text_embedding"), q), 5).alias("cosine"))


@query(None)
def g15_dissolved_trees(c):
    """(id, parent_id) of the nodes that stay when thin aspects have dissolved, round after round."""
    return G.dissolved(c.nodes).select("id", "parent_id")
