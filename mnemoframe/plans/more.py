"""Further queries of sources, joins, texts, retrieval and evaluation over the memory corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.functions import vectors as V
from mnemoframe.operators import ingest as I
from mnemoframe.operators import memory as M
from mnemoframe.operators import search as S
from mnemoframe.operators import trees as G
from mnemoframe.operators.hierarchy import hierarchy
from mnemoframe.plans.retrieval import _PLACED, _VEC, bm25
from mnemoframe.plans.scalars import BASE

QUERIES, ORACLE = {}, {}


def query(sql):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(M.Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE[fn.__name__] = BASE + sql
        return fn

    return add


@query("SELECT task_id, 'task-' || task_id AS name, row_number() OVER (ORDER BY task_id) AS pk FROM (SELECT DISTINCT task_id FROM fcts)")
def s10_tasks(c):
    tasks = c.facts.select("task_id").distinct()
    return tasks.select("task_id", F.concat(F.lit("task-"), F.col("task_id").cast("string")).alias("name"), F.row_number().over(Window.orderBy("task_id")).alias("pk"))


@query("SELECT fact_id, session_id FROM sources WHERE fact_id NOT IN (SELECT id FROM act)")
def s12_missing_sources(c):
    """What the writer would add if only active facts had their sources stored."""
    stored = c.sources.join(M.active(c.facts).select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    return I.added(stored, c.sources, ["fact_id", "session_id"])


@query("SELECT id FROM nds WHERE id NOT IN (SELECT id FROM nds WHERE support > 1)")
def s13_nodes_to_delete(c):
    return c.nodes.select("id").join(c.nodes.filter("support > 1").select("id"), "id", "left_anti")


@query("SELECT n.id, f.text FROM nds n LEFT JOIN act f ON n.fact_id = f.id WHERE n.fact_id IS NOT NULL")
def s14_tree_facts(c):
    f = M.active(c.facts).select(F.col("id").alias("fact_id"), "text")
    return c.nodes.filter("fact_id is not null").select("id", "fact_id").join(f, "fact_id", "left").select("id", "text")


@query("SELECT s.id AS session_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM summaries u WHERE u.session_id = s.id)")
def s15_sessions_without_summary(c):
    return c.sessions.select(F.col("id").alias("session_id")).join(c.summaries.select("session_id"), "session_id", "left_anti")


@query("SELECT dataset, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM eval_items WHERE answer IS NULL GROUP BY 1")
def s18_unanswered_by_dataset(c):
    g = M.table(c.spark, c.folder, "eval_items").filter("answer is null").groupBy("dataset").agg(F.array_sort(F.collect_list("item_id")).alias("i"))
    return g.select("dataset", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("items"))


@query(bm25("messages", "id", "content", "bm", "('parser')") + " SELECT id FROM bm")
def f7_messages_with_term(c):
    return S.Index(c.messages, "id", "content").search("parser", None).select("id")


@query("SELECT task_id, count(*) FILTER (WHERE lower(trim(status)) = 'active') > 0 AS has_active FROM fcts GROUP BY 1")
def f18_tasks_with_facts(c):
    return c.facts.groupBy("task_id").agg((F.count(F.when(F.lower(F.trim("status")) == "active", 1)) > 0).alias("has_active"))


@query("SELECT id, trim(part) AS part FROM (SELECT id, unnest(string_split(\"desc\", ',')) AS part FROM ents) WHERE trim(part) <> ''")
def f20_split_parts(c):
    return c.entities.select("id", F.explode(F.split("desc", ",")).alias("part")).select("id", F.trim("part").alias("part")).filter("part <> ''")


@query("SELECT s.id AS session_id, s.chat_id, u.content FROM summaries u JOIN sessions s ON u.session_id = s.id")
def j5_summaries_of_chats(c):
    return c.summaries.join(c.sessions.select(F.col("id").alias("session_id"), "chat_id"), "session_id").select("session_id", "chat_id", "content")


@query("SELECT a.chunk_id, a.document_id, d.n_chunks FROM chunks a JOIN (SELECT chat_id, document_id, count(*) AS n_chunks FROM chunks GROUP BY 1, 2) d USING (chat_id, document_id)")
def j11_chunks_documents(c):
    d = c.chunks.groupBy("chat_id", "document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return c.chunks.join(d, ["chat_id", "document_id"]).select("chunk_id", "document_id", "n_chunks")


@query(""", pairs AS (SELECT DISTINCT fact_id, alias_text, entity_id FROM refs WHERE entity_id IS NOT NULL),
o AS (SELECT fact_id, alias_text, entity_id, row_number() OVER (PARTITION BY fact_id ORDER BY alias_text, entity_id) AS r FROM pairs),
f AS (SELECT id AS fact_id, 0 AS r, text AS t FROM fcts UNION ALL SELECT f.fact_id, o.r, replace(f.t, '[' || o.alias_text || ']', '[' || o.entity_id || ']') FROM f JOIN o ON o.fact_id = f.fact_id AND o.r = f.r + 1)
SELECT fact_id AS id, arg_max(t, r) AS resolved FROM f GROUP BY 1""")
def j14_resolved_texts(c):
    p = c.refs.filter("entity_id is not null").select("fact_id", "alias_text", "entity_id").distinct().groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("alias_text").alias("alias"), F.col("entity_id").alias("canonical")))).alias("p"))
    none = F.array().cast("array<struct<alias:string,canonical:string>>")
    return c.facts.select("id", "text").join(p, "id", "left").select("id", X.resolve_aliases(F.col("text"), F.coalesce("p", none)).alias("resolved"))


@query("""SELECT a.item_id AS item_a, b.item_id AS item_b FROM (SELECT item_id, dataset, row_number() OVER (PARTITION BY dataset, category ORDER BY item_id) AS k, category FROM eval_items) a
JOIN (SELECT item_id, dataset, row_number() OVER (PARTITION BY dataset, category ORDER BY item_id DESC) AS k, category FROM eval_items) b ON a.dataset = b.dataset AND a.category = b.category AND a.k = b.k""")
def j18_kth_with_kth(c):
    t = M.table(c.spark, c.folder, "eval_items").select("item_id", "dataset", "category")
    a = t.withColumn("k", F.row_number().over(Window.partitionBy("dataset", "category").orderBy("item_id"))).withColumnRenamed("item_id", "item_a")
    b = t.withColumn("k", F.row_number().over(Window.partitionBy("dataset", "category").orderBy(F.desc("item_id")))).withColumnRenamed("item_id", "item_b")
    return a.join(b, ["dataset", "category", "k"]).select("item_a", "item_b")


@query("SELECT r.entity_id, r.fact_id FROM (SELECT DISTINCT task_id, entity_id, fact_id FROM refs WHERE entity_id IS NOT NULL) r LEFT JOIN fcts f ON r.fact_id = f.id WHERE NOT EXISTS (SELECT 1 FROM nds n WHERE n.entity_id = r.entity_id AND n.fact_id = r.fact_id)")
def j20_orphan_refs(c):
    own = c.refs.filter("entity_id is not null").select("task_id", "entity_id", "fact_id").distinct()
    return own.join(c.nodes.select("entity_id", "fact_id").distinct(), ["entity_id", "fact_id"], "left_anti").select("entity_id", "fact_id")


@query(_PLACED + ", vs AS (SELECT DISTINCT id, v FROM fv), kid AS (SELECT n.parent_id AS id, greatest(coalesce(n.support, 1), 1) AS w, vs.v FROM nds n JOIN vs ON n.fact_id = vs.id WHERE n.parent_id IS NOT NULL) SELECT id, i AS pos, sum(CAST(v[i] AS DOUBLE) * w) / sum(w) AS mean FROM kid, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2")
def a20_weighted_centroids(c):
    ok = M.active(c.facts).filter(V.is_vector(F.col("text_embedding"), 64)).select(F.col("id").alias("fact_id"), "text_embedding")
    kid = c.nodes.filter("parent_id is not null").select("fact_id", F.col("parent_id"), F.coalesce("support", F.lit(1)).alias("w")).join(ok, "fact_id")
    m = V.mean_vector(kid.withColumnRenamed("parent_id", "pid"), ["pid"], "text_embedding", "w")
    return m.select(F.col("pid").alias("id"), F.posexplode("centroid").alias("p", "mean")).select("id", (F.col("p") + 1).cast("long").alias("pos"), "mean")


ORACLE["a20_weighted_centroids"] = ORACLE["a20_weighted_centroids"].replace(_PLACED, _VEC)


@query("SELECT session_id, speaker, (dense_rank() OVER (PARTITION BY session_id ORDER BY f, speaker) - 1) % 5 AS colour FROM (SELECT session_id, speaker, min(position) AS f FROM messages WHERE speaker IS NOT NULL GROUP BY 1, 2)")
def w17_speaker_colours(c):
    first = c.messages.filter("speaker is not null").groupBy("session_id", "speaker").agg(F.min("position").alias("f"))
    return first.select("session_id", "speaker", ((F.dense_rank().over(Window.partitionBy("session_id").orderBy("f", "speaker")) - 1) % 5).cast("long").alias("colour"))


@query("SELECT session_id, id FROM (SELECT session_id, id, position, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY position, id) AS r FROM messages) WHERE r > n - 3 - 2")
def w14_lookback(c):
    """The last three messages of each session and two before them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    r = F.row_number().over(Window.partitionBy("session_id").orderBy("position", "id"))
    return c.messages.select("session_id", "id", n.alias("n"), r.alias("r")).filter("r > n - 5").select("session_id", "id")


@query("SELECT id, task_id, avg(uncertainty_score) OVER (PARTITION BY task_id ORDER BY id ROWS UNBOUNDED PRECEDING) > 2.5 AS high FROM nds WHERE uncertainty_score IS NOT NULL")
def w16_running_mean(c):
    w = Window.partitionBy("task_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return c.nodes.filter("uncertainty_score is not null").select("id", "task_id", (F.avg("uncertainty_score").over(w) > 2.5).alias("high"))


@query(", ks AS (SELECT id, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS r FROM nds), k2 AS (SELECT n.id, n.entity_id, n.parent_id, ks.r FROM nds n JOIN ks USING (id)) SELECT id, entity_id FROM k2 WHERE r <= 3")
def w2_ranked_nodes(c):
    w = Window.partitionBy("entity_id").orderBy("id")
    return c.nodes.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("id", "entity_id")


@query("SELECT id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY id) - 1 AS place FROM nds")
def w2_places(c):
    w = Window.partitionBy("entity_id").orderBy("id")
    return c.nodes.select("id", "entity_id", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("SELECT i AS pos, f.id, f.text FROM (VALUES (0, 40), (1, 2), (2, 17), (3, 999999999)) v(i, id) JOIN fcts f USING (id)")
def t5_in_given_order(c):
    wanted = c.spark.createDataFrame([(0, 40), (1, 2), (2, 17), (3, 999999999)], "pos int, id long")
    return F.broadcast(wanted).join(c.facts.select("id", "text"), "id").orderBy("pos").select("pos", "id", "text")


@query("SELECT id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT id, w, min(p) AS p FROM (SELECT id, unnest(string_split(canonical_ref, ' ')) AS w, generate_subscripts(string_split(canonical_ref, ' '), 1) AS p FROM ents) GROUP BY 1, 2) GROUP BY 1")
def u6_ordered_distinct(c):
    return c.entities.select("id", F.array_join(F.array_distinct(F.split("canonical_ref", " ")), " ").alias("words"))


@query("SELECT id FROM (SELECT id FROM act WHERE task_id = 7 UNION SELECT id FROM fcts WHERE batch_index = 0)")
def u2_appended_new(c):
    a, b = M.active(c.facts, 7).select("id"), c.facts.filter("batch_index = 0").select("id")
    return a.unionByName(b.join(a, "id", "left_anti"))


@query(r"SELECT id, trim(regexp_replace(regexp_replace(text, '[&|!{}\[\]^\"~*?:\\/`<>=]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM fcts".replace('\\"', '"'))
def x13_boolean_queries(c):
    return c.facts.select("id", X.sanitized_boolean_query(F.col("text")).alias("q"))


@query("SELECT task_id, entity_id, '- ' || name || coalesce(' | also known as: ' || also, '') || CASE WHEN trim(coalesce(d, '')) <> '' THEN ' | desc: ' || d ELSE '' END AS line FROM (SELECT task_id, entity_id, min(canonical_ref) AS name, min(\"desc\") AS d FROM ents GROUP BY 1, 2) LEFT JOIN (SELECT task_id, entity_id, string_agg(DISTINCT alias_text, ', ' ORDER BY alias_text) AS also FROM refs GROUP BY 1, 2) USING (task_id, entity_id)")
def x21_known_entities(c):
    e = c.entities.groupBy("task_id", "entity_id").agg(F.min("canonical_ref").alias("name"), F.min("desc").alias("d"))
    a = c.refs.filter("entity_id is not null").groupBy("task_id", "entity_id").agg(F.array_sort(F.collect_set("alias_text")).alias("a"))
    return e.join(a, ["task_id", "entity_id"], "left").select("task_id", "entity_id", X.known_entity_line(F.col("name"), F.coalesce("a", F.array().cast("array<string>")), F.col("d")).alias("line"))


@query(r"SELECT id, CASE WHEN length(t) > 40 THEN '（……）' || right(t, 40) ELSE t END AS short FROM (SELECT id, regexp_replace(content, '\n{2,}', chr(10), 'g') AS t FROM messages)")
def x22_shortened(c):
    return c.messages.select("id", X.shortened_reply(F.col("content"), 40).alias("short"))


@query("SELECT chunk_id, concat_ws(' | ', 'File: ' || file_name, 'Type: ' || upper(nullif(regexp_extract(file_name, '\\.([A-Za-z0-9]+)$', 1), '')), 'Part ' || (chunk_index + 1) || '/9', 'Page ' || page_number, 'Section: ' || nullif(trim(regexp_extract(content, '(?m)^#{1,6}\\s+(.+)$', 1)), '')) AS prefix FROM chunks")
def x33_chunk_prefixes(c):
    return c.chunks.select("chunk_id", X.chunk_prefix(F.col("file_name"), F.col("chunk_index"), F.lit(9), F.col("page_number"), F.col("content")).alias("prefix"))


@query("SELECT CAST(len(text_embedding) AS INTEGER) AS dims, count(DISTINCT id) AS n FROM facts WHERE text_embedding IS NOT NULL GROUP BY 1")
def v5_dimensions(c):
    return c.facts.filter("text_embedding is not null").groupBy(F.size("text_embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"))


@query(_VEC + ", sc AS (SELECT fv.id, round(list_sum(list_transform(list_zip(v, qv), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(qv, lambda x: CAST(x AS DOUBLE) * x)))), 5) AS cosine FROM fv, q WHERE list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x)) > 0) SELECT id, cosine FROM sc WHERE cosine > 0.25")
def v2_cosines(c):
    row = c.facts.filter("id = 2").select("text_embedding").first()
    q = F.array(*[F.lit(float(x)) for x in row[0]])
    ok = M.active(c.facts).filter(V.is_vector(F.col("text_embedding"), 64) & (V.norm(F.col("text_embedding")) > 0))
    return ok.select("id", F.round(V.cosine(F.col("text_embedding"), q), 5).alias("cosine")).filter("cosine > 0.25")


_SESSIONS = bm25("summaries", "session_id", "content", "sm", "('parser', 'regression')")


@query(_SESSIONS + ", agg AS (SELECT session_id AS id, round(sum(1.0::DOUBLE / (1 + fact_id % 10)), 6) AS score FROM sources GROUP BY 1 ORDER BY score DESC, id LIMIT 20), top AS (SELECT id, score FROM sm ORDER BY score DESC, id LIMIT 10) SELECT id, score, 'facts' AS source FROM agg UNION ALL SELECT id, score, 'words' FROM top WHERE id NOT IN (SELECT id FROM agg)")
def r18_session_pool(c):
    scored = M.session_scores(c.facts.select("id", (1.0 / (1 + F.col("id") % 10)).alias("score")), c.sources).select(F.col("session_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(20)
    words = S.Index(c.summaries, "session_id", "content").search("parser regression", 10)
    return S.first_seen([("facts", scored), ("words", words)])


@query(bm25("messages", "id", "content", "bm", "('parser', 'regression')") + " SELECT m.session_id, count(*) AS votes FROM (SELECT id FROM bm ORDER BY score DESC, id LIMIT 20) b JOIN messages m USING (id) GROUP BY 1")
def r26_session_votes(c):
    top = S.Index(c.messages, "id", "content").search("parser regression", 20)
    return top.join(c.messages.select("id", "session_id"), "id").groupBy("session_id").agg(F.count(F.lit(1)).alias("votes"))


@query("SELECT m.id, m.session_id FROM messages m WHERE m.session_id = (SELECT min(session_id) FROM summaries)")
def r26_whole_session(c):
    first = c.summaries.agg(F.min("session_id").alias("s"))
    return c.messages.join(F.broadcast(first), F.col("session_id") == F.col("s")).select("id", "session_id")


@query("SELECT id, len(string_split(trim(\"desc\"), ' ')) <= 60 AS ok FROM ents WHERE \"desc\" IS NOT NULL AND trim(\"desc\") <> ''")
def agent_description_limit(c):
    return c.entities.filter(F.trim("desc") != "").select("id", I.short_enough(F.col("desc")).alias("ok"))


@query(r"""SELECT f.id, len(list_filter(regexp_extract_all(text, '\[([^\[\]:]+)\]', 1), lambda x: TRUE)) > 0 AND coalesce(bool_and(regexp_matches(a.time_resolved, '^(\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2})?Z)?)?)?|\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2})?Z)?)?)?/|/\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2})?Z)?)?)?|\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2})?Z)?)?)?/\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2})?Z)?)?)?)$')), true) AS valid
FROM fcts f LEFT JOIN annotations a ON a.fact_id = f.id GROUP BY f.id, f.text""")
def agent_valid_facts(c):
    return c.facts.select("id", I.valid_fact(F.col("text")).alias("valid"))


@query("SELECT s.task_id, count(m.id) AS n_messages FROM sessions s LEFT JOIN messages m ON m.session_id = s.id GROUP BY 1")
def n6_messages_per_task(c):
    return c.sessions.select("task_id", F.col("id").alias("session_id")).join(c.messages.select("session_id", "id"), "session_id", "left").groupBy("task_id").agg(F.count("id").alias("n_messages"))


@query("SELECT m.id, coalesce(strftime(m.message_time, '%Y-%m-%dT%H:%M:%SZ'), '') AS at FROM messages m JOIN sessions s ON m.session_id = s.id")
def n5_message_times(c):
    s = c.sessions.select(F.col("id").alias("session_id"))
    return c.messages.join(s, "session_id").select("id", F.coalesce(F.date_format(F.col("message_time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("at"))


@query("SELECT id, CASE WHEN fact_id IS NOT NULL THEN (SELECT text FROM fcts f WHERE f.id = n.fact_id) ELSE description END AS shown FROM nds n")
def n16_node_texts(c):
    f = c.facts.select(F.col("id").alias("fact_id"), "text")
    return c.nodes.select("id", "fact_id", "description").join(f, "fact_id", "left").select("id", F.when(F.col("fact_id").isNotNull(), F.col("text")).otherwise(F.col("description")).alias("shown"))


@query("SELECT id FROM nds WHERE fact_id IS NULL AND fresh_count > 0")
def n17_dirty_nodes(c):
    return c.nodes.filter("fact_id is null and fresh_count > 0").select("id")


@query("SELECT item_id, regexp_matches(question, '(?i)how many|which of') AS single FROM eval_items")
def n22_question_routing(c):
    return M.table(c.spark, c.folder, "eval_items").select("item_id", F.col("question").rlike("(?i)how many|which of").alias("single"))


@query(_PLACED + " SELECT n.entity_id, max(w.depth) AS most_depth, count(*) AS n FROM nds n JOIN walk w USING (id) GROUP BY 1")
def n17_tree_sizes(c):
    return G.placed_nodes(c.nodes).filter("depth is not null").groupBy("entity_id").agg(F.max("depth").alias("most_depth"), F.count(F.lit(1)).alias("n"))


@query(_PLACED + ", up AS (SELECT n.id, n.parent_id AS above FROM nds n JOIN walk USING (id) WHERE n.parent_id IN (SELECT id FROM nds) UNION ALL SELECT u.id, p.parent_id FROM up u JOIN nds p ON u.above = p.id WHERE p.node_type = 'root' AND p.parent_id IN (SELECT id FROM nds)) SELECT u.id, u.above AS shown_parent FROM up u JOIN nds p ON u.above = p.id WHERE p.node_type IS DISTINCT FROM 'root' OR p.parent_id IS NULL OR p.parent_id NOT IN (SELECT id FROM nds)")
def g21_shown_parents(c):
    """The nearest node above that is no nested root."""
    h = hierarchy(c.nodes, tree_col="entity_id", with_paths=True).filter("root_id <> -1 and depth > 0").select("id", F.posexplode("path").alias("at", "above"), "depth").filter("above <> id")
    kind = c.nodes.select(F.col("id").alias("above"), (F.coalesce(F.col("node_type"), F.lit("")) == "root").alias("root"))
    best = h.join(kind, "above").filter("at = 0 or not root").groupBy("id").agg(F.max(F.struct("at", "above")).alias("m"))
    return best.select("id", F.col("m.above").alias("shown_parent"))


ORACLE = {k: v.replace("WITH sessions", "WITH RECURSIVE sessions", 1) if _PLACED in v or "\nf AS (SELECT id AS fact_id" in v else v for k, v in ORACLE.items()}
