"""Queries of filters, joins, aggregations, sorts and scalar functions over the memory corpus, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.operators import memory as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The same clean tables in SQL.
BASE = r"""
WITH sessions AS (SELECT DISTINCT * FROM chat_sessions),
messages AS (SELECT DISTINCT * FROM chat_messages),
fcts AS (SELECT DISTINCT id, task_id, text, search_text, batch_id, session_number, batch_index, fact_ts, status, created_at FROM facts),
act AS (SELECT * FROM fcts WHERE lower(trim(status)) = 'active'),
ents AS (SELECT DISTINCT id, task_id, entity_id, canonical_ref, "desc", batch_id, created_at FROM entities),
nds AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS r FROM entity_tree_nodes) WHERE r = 1),
chunks AS (SELECT DISTINCT * FROM file_chunks),
own AS (SELECT DISTINCT id AS fact_id, task_id, a AS alias_text FROM (SELECT id, task_id, unnest(regexp_extract_all(text, '\[([^\[\]:]+)\]', 1)) AS a FROM fcts)),
named AS (SELECT task_id, canonical_ref AS alias_text, arg_min(entity_id, id) AS entity_id FROM ents GROUP BY 1, 2),
refs AS (SELECT o.fact_id, o.task_id, o.alias_text, n.entity_id FROM own o LEFT JOIN named n USING (task_id, alias_text)),
sources AS (SELECT f.id AS fact_id, s.id AS session_id FROM fcts f JOIN sessions s USING (task_id, session_number)),
annotations AS (SELECT id AS fact_id, unnest(regexp_extract_all(text, '\[([^\[\]]+?)::([^\[\]]+)\]', 1)) AS time_raw, unnest(regexp_extract_all(text, '\[([^\[\]]+?)::([^\[\]]+)\]', 2)) AS time_resolved FROM fcts),
summaries AS (SELECT s.id AS session_id, s.task_id, 'Session ' || s.session_number AS subject, string_agg(m.content, ' ' ORDER BY m.position, m.id, m.content) AS content
              FROM messages m JOIN sessions s ON m.session_id = s.id WHERE m.content IS NOT NULL GROUP BY ALL)
"""


def query(sql: str | None) -> Callable:
    """Register the function under its name, with the SQL behind the clean tables that it is compared with."""

    def add(fn: Callable[[M.Corpus], DataFrame]) -> Callable[[M.Corpus], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(M.Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE[fn.__name__] = BASE + sql
        return fn

    return add


@query("SELECT session_id, id, position FROM messages")
def s2_session_messages(c):
    return c.messages.orderBy("session_id", "position", "id").select("session_id", "id", "position")


@query("SELECT id, CASE WHEN chat_id IS NULL OR trim(chat_id) = '' THEN 'legacy:' || task_id || ':' || session_number ELSE chat_id END AS chat_id FROM sessions")
def s24_legacy_chat_ids(c):
    blank = F.col("chat_id").isNull() | (F.trim("chat_id") == "")
    return c.sessions.select("id", F.when(blank, F.concat(F.lit("legacy:"), F.col("task_id").cast("string"), F.lit(":"), F.col("session_number").cast("string"))).otherwise(F.col("chat_id")).alias("chat_id"))


@query("SELECT chunk_id, CASE WHEN retrieval_text IS NULL OR trim(retrieval_text) = '' THEN content ELSE retrieval_text END AS retrieval_text FROM chunks")
def s24_legacy_retrieval_text(c):
    blank = F.col("retrieval_text").isNull() | (F.trim("retrieval_text") == "")
    return c.chunks.select("chunk_id", F.when(blank, F.col("content")).otherwise(F.col("retrieval_text")).alias("retrieval_text"))


@query("SELECT id, text FROM act WHERE task_id = 7")
def f1_active_facts(c):
    return M.active(c.facts, 7).select("id", "text")


@query("SELECT id, text FROM fcts WHERE id IN (SELECT fact_id FROM nds WHERE node_type = 'leaf')")
def f2_facts_of_leaves(c):
    return c.facts.join(c.nodes.filter("node_type = 'leaf'").select(F.col("fact_id").alias("id")), "id", "left_semi").select("id", "text")


@query("SELECT f.id FROM facts f WHERE text_embedding IS NOT NULL GROUP BY 1")
def f3_facts_with_vectors(c):
    return c.facts.filter("text_embedding is not null").select("id")


@query("SELECT id, speaker FROM messages WHERE lower(trim(speaker)) = 'user'")
def f8_messages_of_speaker(c):
    return c.messages.filter(F.lower(F.trim("speaker")) == "user").select("id", "speaker")


@query("SELECT session_id, subject FROM summaries WHERE subject ILIKE '%12%' OR content ILIKE '%insurance%'")
def f9_summary_search(c):
    return c.summaries.filter(F.col("subject").ilike("%12%") | F.col("content").ilike("%insurance%")).select("session_id", "subject")


@query("SELECT DISTINCT batch_id FROM fcts WHERE batch_id LIKE 'batch-0000%' ESCAPE '!'")
def f10_batches_by_prefix(c):
    return c.facts.filter(F.expr("batch_id like 'batch-0000%' escape '!'")).select("batch_id").distinct()


@query("SELECT item_id FROM eval_items WHERE regexp_matches(question, '(?i)kettle|easel') OR regexp_matches(coalesce(answer, ''), '(?i)kettle|easel')")
def f11_item_search(c):
    items = M.table(c.spark, c.folder, "eval_items")
    return items.filter(F.col("question").rlike("(?i)kettle|easel") | F.coalesce("answer", F.lit("")).rlike("(?i)kettle|easel")).select("item_id")


@query("SELECT session_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY position, id) AS hits FROM messages WHERE contains(lower(content), 'parser') GROUP BY 1")
def f12_message_search(c):
    hit = c.messages.filter(F.lower("content").contains("parser")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("m"))
    return hit.select("session_id", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",").alias("hits"))


@query("SELECT chunk_id FROM chunks WHERE chat_id = 'chat-0000' AND document_id IN (SELECT DISTINCT document_id FROM chunks WHERE file_name LIKE '%.md')")
def f13_library_scope(c):
    md = c.chunks.filter("file_name like '%.md'").select("document_id").distinct()
    return c.chunks.filter("chat_id = 'chat-0000'").join(md, "document_id", "left_semi").select("chunk_id")


@query("SELECT item_id, category FROM eval_items WHERE category = 'temporal' ORDER BY item_id LIMIT 10")
def f14_category_first(c):
    return M.table(c.spark, c.folder, "eval_items").filter("category = 'temporal'").orderBy("item_id").limit(10).select("item_id", "category")


@query("SELECT id, task_id, session_number FROM sessions WHERE digested_at IS NULL")
def f15_pending_sessions(c):
    return c.sessions.filter("digested_at is null").orderBy("task_id", "session_number").select("id", "task_id", "session_number")


@query("SELECT id, created_at FROM fcts WHERE created_at > TIMESTAMP '2024-01-01' ORDER BY created_at, id LIMIT 200")
def f16_cursor_rows(c):
    return c.facts.filter("created_at > timestamp_ntz'2024-01-01'").orderBy("created_at", "id").limit(200).select("id", "created_at")


@query("SELECT id, starts_with(ltrim(text, '- '), '[') AS constrained FROM fcts")
def f17_marker_partition(c):
    return c.facts.select("id", F.expr("trim(leading '- ' from text)").startswith("[").alias("constrained"))


@query("SELECT fact_id FROM refs GROUP BY 1 HAVING count(*) FILTER (WHERE entity_id IS NULL) = 0")
def f19_facts_with_known_refs(c):
    return c.refs.groupBy("fact_id").agg(F.count(F.when(F.col("entity_id").isNull(), 1)).alias("n")).filter("n = 0").select("fact_id")


@query("SELECT m.id, 'S' || s.session_number || ':' || m.position AS dia_id FROM messages m JOIN sessions s ON m.session_id = s.id")
def f21_dialogue_ids(c):
    s = c.sessions.select(F.col("id").alias("session_id"), "session_number")
    return c.messages.join(s, "session_id").select("id", F.concat(F.lit("S"), F.col("session_number").cast("string"), F.lit(":"), F.col("position").cast("string")).alias("dia_id"))


@query("SELECT task_id, string_agg(DISTINCT CAST(batch_index AS VARCHAR), ',' ORDER BY CAST(batch_index AS VARCHAR)) AS batches FROM fcts WHERE batch_index IS NOT NULL GROUP BY 1")
def f22_batch_options(c):
    return c.facts.filter("batch_index is not null").groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("batch_index").cast("string"))), ",").alias("batches"))


@query("SELECT r.fact_id, r.alias_text, e.canonical_ref FROM refs r JOIN (SELECT task_id, entity_id, min(canonical_ref) AS canonical_ref FROM ents GROUP BY 1, 2) e USING (task_id, entity_id)")
def j1_refs_entities(c):
    e = c.entities.groupBy("task_id", "entity_id").agg(F.min("canonical_ref").alias("canonical_ref"))
    return c.refs.join(e, ["task_id", "entity_id"]).select("fact_id", "alias_text", "canonical_ref")


@query("SELECT m.id, s.task_id, s.chat_id FROM messages m JOIN sessions s ON m.session_id = s.id")
def j2_messages_sessions(c):
    return c.messages.join(c.sessions.select(F.col("id").alias("session_id"), "task_id", "chat_id"), "session_id").select("id", "task_id", "chat_id")


@query("SELECT s.id, u.subject FROM sessions s LEFT JOIN summaries u ON u.session_id = s.id")
def j3_sessions_summaries(c):
    return c.sessions.select("id").join(c.summaries.select(F.col("session_id").alias("id"), "subject"), "id", "left").select("id", "subject")


@query("SELECT f.id AS fact_id, x.session_id, s.chat_id FROM sources x JOIN act f ON x.fact_id = f.id JOIN sessions s ON x.session_id = s.id")
def j4_fact_provenance(c):
    s = c.sessions.select(F.col("id").alias("session_id"), "chat_id")
    return c.sources.join(M.active(c.facts).select(F.col("id").alias("fact_id")), "fact_id").join(s, "session_id").select("fact_id", "session_id", "chat_id")


@query("SELECT DISTINCT r.task_id, r.entity_id, r.fact_id FROM refs r WHERE r.entity_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nds n WHERE n.task_id = r.task_id AND n.entity_id = r.entity_id AND n.fact_id = r.fact_id)")
def j7_new_tree_facts(c):
    return M.new_tree_facts(c.refs, c.nodes)


@query("SELECT DISTINCT entity_id FROM refs WHERE entity_id IS NOT NULL AND fact_id IN (SELECT id FROM fcts WHERE batch_id = 'batch-000001')")
def j8_touched_entities(c):
    batch = c.facts.filter("batch_id = 'batch-000001'").select(F.col("id").alias("fact_id"))
    return c.refs.filter("entity_id is not null").join(batch, "fact_id", "left_semi").select("entity_id").distinct()


@query("SELECT t.task_id, count(s.id) AS n_sessions FROM (SELECT DISTINCT task_id FROM fcts) t LEFT JOIN sessions s USING (task_id) GROUP BY 1")
def j9_tasks_sessions(c):
    return c.facts.select("task_id").distinct().join(c.sessions.select("task_id", "id"), "task_id", "left").groupBy("task_id").agg(F.count("id").alias("n_sessions"))


@query("SELECT a.id AS new_id, min(b.id) AS stored_id FROM fcts a JOIN fcts b ON a.task_id = b.task_id AND a.text = b.text AND b.id < a.id GROUP BY 1")
def j13_exact_fact_match(c):
    first = c.facts.groupBy("task_id", "text").agg(F.min("id").alias("stored_id"))
    return c.facts.select(F.col("id").alias("new_id"), "task_id", "text").join(first, ["task_id", "text"]).filter("stored_id < new_id").select("new_id", "stored_id")


@query("""SELECT task_id, name, entity_id FROM (
    SELECT task_id, name, entity_id, row_number() OVER (PARTITION BY task_id, name ORDER BY p, entity_id) AS r FROM (
      SELECT task_id, canonical_ref AS name, entity_id, 0 AS p FROM ents UNION ALL SELECT task_id, alias_text, entity_id, 1 FROM refs WHERE entity_id IS NOT NULL)) WHERE r = 1""")
def j21_alias_map(c):
    return M.alias_map(c.refs, c.entities)


@query("SELECT task_id, count(*) AS n_facts, count(DISTINCT batch_id) AS n_batches FROM fcts GROUP BY 1")
def a1_facts_per_task(c):
    return c.facts.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_facts"), F.countDistinct("batch_id").alias("n_batches"))


@query("SELECT t.task_id, (SELECT count(*) FROM sessions s WHERE s.task_id = t.task_id) AS n_sessions, (SELECT count(*) FROM ents e WHERE e.task_id = t.task_id) AS n_entities FROM (SELECT DISTINCT task_id FROM fcts) t")
def a2_counts_per_task(c):
    n = lambda df, name: df.groupBy("task_id").agg(F.count(F.lit(1)).alias(name))
    out = c.facts.select("task_id").distinct().join(n(c.sessions, "n_sessions"), "task_id", "left").join(n(c.entities, "n_entities"), "task_id", "left")
    return out.select("task_id", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


@query("SELECT x.fact_id, string_agg(DISTINCT s.chat_id, ',' ORDER BY s.chat_id) AS source_chat_ids FROM sources x JOIN sessions s ON x.session_id = s.id GROUP BY 1")
def a3_source_chats(c):
    return M.source_chats(c.sources, c.sessions)


@query("SELECT session_id, CAST(round(sum(1.0 / (1 + fact_id % 10)), 6) AS DOUBLE) AS score, count(*) AS n_facts FROM sources GROUP BY 1")
def a4_session_scores(c):
    return M.session_scores(c.facts.select("id", (1.0 / (1 + F.col("id") % 10)).alias("score")), c.sources)


@query("SELECT task_id, coalesce(max(session_number), 0) + 1 AS next_number FROM sessions GROUP BY 1")
def a6_next_session_number(c):
    return c.sessions.groupBy("task_id").agg((F.coalesce(F.max("session_number"), F.lit(0)) + 1).alias("next_number"))


@query("SELECT max(session_number) AS last_session, max(batch_index) AS last_batch FROM fcts")
def a7_last_positions(c):
    return c.facts.agg(F.max("session_number").alias("last_session"), F.max("batch_index").alias("last_batch"))


@query("SELECT DISTINCT alias_text FROM refs")
def a8_distinct_aliases(c):
    return c.refs.select("alias_text").distinct()


@query("SELECT coalesce(category, 'unknown') AS category, count(*) AS total, count(*) FILTER (WHERE length(passage) > length(question)) AS correct, round(count(*) FILTER (WHERE length(passage) > length(question)) / count(*), 4) AS accuracy FROM eval_items GROUP BY 1")
def a9_accuracy_by_category(c):
    good = F.count(F.when(F.length("passage") > F.length("question"), 1))
    return M.table(c.spark, c.folder, "eval_items").groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("total"), good.alias("correct"), F.round(good / F.count(F.lit(1)), 4).alias("accuracy"))


@query("SELECT dataset, round(avg(length(answer)), 6) AS mean_score FROM eval_items GROUP BY 1")
def a10_mean_score(c):
    return M.table(c.spark, c.folder, "eval_items").groupBy("dataset").agg(F.round(F.avg(F.length("answer")), 6).alias("mean_score"))


@query("SELECT doc_id, subject, count(*) AS votes, count(*) * 2 > (SELECT count(DISTINCT annotator) FROM subject_labels b WHERE b.doc_id = a.doc_id) AS majority FROM (SELECT DISTINCT * FROM subject_labels) a GROUP BY 1, 2")
def a11_majority_vote(c):
    own = M.table(c.spark, c.folder, "subject_labels").distinct()
    n = own.groupBy("doc_id").agg(F.countDistinct("annotator").alias("n"))
    return own.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("votes")).join(n, "doc_id").select("doc_id", "subject", "votes", (F.col("votes") * 2 > F.col("n")).alias("majority"))


@query("SELECT item_id, coalesce(upper(trim(answer)) = upper(trim(split_part(question, ' ', -1))), false) AS exact FROM eval_items")
def a12_exact_match(c):
    last = F.element_at(F.split("question", " "), -1)
    return M.table(c.spark, c.folder, "eval_items").select("item_id", F.coalesce(F.upper(F.trim("answer")) == F.upper(F.trim(last)), F.lit(False)).alias("exact"))


@query("SELECT event_type AS model, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(floor(value)) AS BIGINT) AS completion_tokens, round(sum(round((2 * CAST(json_extract(props, '$.k') AS BIGINT) + 8 * floor(value)) / 1e6, 8)), 6) AS cost FROM events GROUP BY 1")
def a13_usage_by_model(c):
    prompt, done = F.get_json_object("props", "$.k").cast("long"), F.floor("value").cast("long")
    cost = F.round((2 * prompt + 8 * done) / 1e6, 8)
    return M.table(c.spark, c.folder, "events").groupBy(F.col("event_type").alias("model")).agg(F.sum(prompt).alias("prompt_tokens"), F.sum(done).alias("completion_tokens"), F.round(F.sum(cost), 6).alias("cost"))


@query("SELECT entity_id, string_agg(DISTINCT alias_text, ' | ' ORDER BY alias_text) AS aliases FROM refs WHERE entity_id IS NOT NULL GROUP BY 1")
def a14_aliases(c):
    return c.refs.filter("entity_id is not null").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("alias_text")), " | ").alias("aliases"))


@query(r"SELECT r.entity_id, string_agg(regexp_replace(f.text, '\[([^\[\]:]+)::([^\[\]]+)\]', '\1 (\2)', 'g'), '; ' ORDER BY f.id) AS about FROM (SELECT DISTINCT entity_id, fact_id FROM refs WHERE entity_id IS NOT NULL) r JOIN fcts f ON r.fact_id = f.id GROUP BY 1")
def a15_entity_texts(c):
    own = c.refs.filter("entity_id is not null").select("entity_id", "fact_id").distinct().join(c.facts.select(F.col("id").alias("fact_id"), X.render_marks(F.col("text")).alias("t")), "fact_id")
    return own.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "t"))).alias("a")).select("entity_id", F.array_join(F.transform("a", lambda x: x["t"]), "; ").alias("about"))


@query("SELECT entity_id, count(DISTINCT fact_id) AS n_facts FROM refs WHERE entity_id IS NOT NULL GROUP BY 1")
def a16_entity_fact_counts(c):
    return c.refs.filter("entity_id is not null").groupBy("entity_id").agg(F.countDistinct("fact_id").alias("n_facts"))


@query("SELECT fact_id FROM refs GROUP BY 1 HAVING count(DISTINCT alias_text) >= 2")
def a17_shared_facts(c):
    return c.refs.groupBy("fact_id").agg(F.countDistinct("alias_text").alias("n")).filter("n >= 2").select("fact_id")


@query("SELECT task_id, count(*) AS total, count(digested_at) AS done, count(*) - count(digested_at) AS open FROM sessions GROUP BY 1")
def a18_run_status(c):
    return c.sessions.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"), F.count("digested_at").alias("done"), (F.count(F.lit(1)) - F.count("digested_at")).alias("open"))


@query("SELECT id, canonical_ref, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT id, canonical_ref, c, count(*) / sum(count(*)) OVER (PARTITION BY id) AS p FROM (SELECT id, canonical_ref, unnest(string_split(replace(canonical_ref, ' ', ''), '')) AS c FROM ents) WHERE c <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2")
def a21_name_entropy(c):
    return c.entities.select("id", "canonical_ref", F.round(X.char_entropy(F.col("canonical_ref")), 6).alias("entropy"))


@query("SELECT chat_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY session_number, id) AS session_ids FROM sessions GROUP BY 1")
def a22_sessions_by_chat(c):
    g = c.sessions.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("session_number", "id"))).alias("s"))
    return g.select("chat_id", F.array_join(F.transform("s", lambda x: x["id"].cast("string")), ",").alias("session_ids"))


@query("SELECT event_type, CASE WHEN value < 1 THEN 0 WHEN value < 5 THEN 1 WHEN value < 10 THEN 2 WHEN value < 50 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def a23_histogram(c):
    v = F.col("value")
    bucket = F.when(v < 1, 0).when(v < 5, 1).when(v < 10, 2).when(v < 50, 3).otherwise(4)
    return M.table(c.spark, c.folder, "events").groupBy("event_type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT session_id, count(*) AS n, count(*) FILTER (WHERE lower(trim(speaker)) = 'user') AS user_turns FROM messages GROUP BY 1")
def a24_turn_counts(c):
    return c.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.lower(F.trim("speaker")) == "user", 1)).alias("user_turns"))


@query("SELECT dataset, category, count(*) AS n, grouping(category) AS overall FROM eval_items GROUP BY ROLLUP (dataset, category)")
def a26_rollup_report(c):
    return M.table(c.spark, c.folder, "eval_items").rollup("dataset", "category").agg(F.count(F.lit(1)).alias("n"), F.grouping("category").cast("long").alias("overall"))


@query("SELECT id, uncertainty_score FROM nds ORDER BY uncertainty_score DESC, id LIMIT 20")
def t1_top_nodes(c):
    return c.nodes.orderBy(F.desc("uncertainty_score"), "id").limit(20).select("id", "uncertainty_score")


@query("SELECT id FROM fcts ORDER BY coalesce(nullif(fact_ts, ''), 'zzz'), id LIMIT 100")
def t3_chronological(c):
    return c.facts.orderBy(F.coalesce(F.nullif("fact_ts", F.lit("")), F.lit("zzz")), "id").limit(100).select("id")


@query("SELECT id, coalesce(nullif(fact_ts, ''), 'zzz') AS sort_key FROM fcts ORDER BY sort_key, id")
def t3_whole_order(c):
    return c.facts.select("id", F.coalesce(F.nullif("fact_ts", F.lit("")), F.lit("zzz")).alias("sort_key")).orderBy("sort_key", "id")


@query("SELECT session_id FROM summaries ORDER BY session_id OFFSET (SELECT least(100000, (count(*) - 1) // 20 * 20) FROM summaries) LIMIT 20")
def t4_last_page(c):
    return M.with_clamped_page(c.summaries.select("session_id"), [F.col("session_id")], 100000, 20)


@query("SELECT id, task_id FROM (SELECT id, task_id, row_number() OVER (PARTITION BY task_id ORDER BY uncertainty_score DESC, id) AS r FROM nds WHERE uncertainty_score >= 3) WHERE r <= 5")
def t6_top_per_task(c):
    w = Window.partitionBy("task_id").orderBy(F.desc("uncertainty_score"), "id")
    return c.nodes.filter("uncertainty_score >= 3").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("id", "task_id")


@query("SELECT task_id FROM (SELECT task_id, row_number() OVER (ORDER BY task_id) AS place FROM (SELECT DISTINCT task_id FROM sessions)) WHERE place BETWEEN 1 AND 5 OR place = 8")
def t7_tasks_by_place(c):
    w = Window.orderBy("task_id")  # one row a task
    return c.sessions.select("task_id").distinct().withColumn("at", F.row_number().over(w)).filter("at between 1 and 5 or at = 8").select("task_id")


@query("SELECT id FROM fcts EXCEPT SELECT fact_id FROM nds")
def u3_facts_outside_trees(c):
    return c.facts.select("id").exceptAll(c.nodes.filter("fact_id is not null").select(F.col("fact_id").alias("id")).distinct())


@query("SELECT id FROM fcts INTERSECT SELECT fact_id FROM nds")
def u4_facts_in_trees(c):
    return c.facts.select("id").intersect(c.nodes.select(F.col("fact_id").alias("id")))


@query("SELECT fact_id, alias_text FROM own")
def x1_bracket_refs(c):
    return c.facts.select(F.col("id").alias("fact_id"), F.explode(X.bracket_refs(F.col("text"))).alias("alias_text"))


@query("SELECT fact_id, time_raw, time_resolved FROM annotations")
def x2_time_marks(c):
    return c.annotations


@query(r"""SELECT f.id, regexp_replace(regexp_replace(f.text, '\[([^\[\]]+?)::([^\[\]]+)\]', '\1', 'g'), '\[([^\[\]:]+)\]', '\1', 'g') || coalesce(' [' || e.names || ']', '') AS search_text
    FROM fcts f LEFT JOIN (SELECT fact_id, string_agg(DISTINCT entity_id, ', ' ORDER BY entity_id) AS names FROM refs WHERE entity_id IS NOT NULL GROUP BY 1) e ON e.fact_id = f.id""")
def x3_search_text(c):
    names = c.refs.filter("entity_id is not null").groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_set("entity_id")).alias("n"))
    return c.facts.join(names, "id", "left").select("id", X.search_text(F.col("text"), F.coalesce("n", F.array().cast("array<string>"))).alias("search_text"))


@query(r"SELECT id, regexp_replace(text, '\[([^\[\]:]+)::([^\[\]]+)\]', '\1 (\2)', 'g') AS shown FROM fcts")
def x5_rendered(c):
    return c.facts.select("id", X.render_marks(F.col("text")).alias("shown"))


@query(r"SELECT id, regexp_replace(text, '\[([^\[\]]+?)::([^\[\]]+)\]', '[\2]', 'g') AS shown FROM fcts")
def x6_inline_dates(c):
    return c.facts.select("id", X.inline_dates(F.col("text")).alias("shown"))


@query(r"""SELECT fact_id, time_raw || ' [' || CASE WHEN contains(time_resolved, '/') THEN split_part(time_resolved, '/', 1) || ', ' || regexp_extract(time_resolved, '/(.*)$', 1) ELSE time_resolved END || ']' AS info FROM annotations""")
def x9_time_info(c):
    return c.annotations.select("fact_id", X.time_info(F.col("time_raw"), F.col("time_resolved"), F.lit(None).cast("string")).alias("info"))


@query("SELECT id, length(text) // 4 + 1 AS n FROM fcts")
def x10_token_estimates(c):
    return c.facts.select("id", X.token_estimate(F.col("text")).alias("n"))


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '[+\-&|!(){}\[\]^"~*?:\\/`<>=]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM fcts""")
def x12_sanitized(c):
    return c.facts.select("id", X.sanitized_query(F.col("text")).alias("q"))


@query(r"SELECT id, trim(regexp_replace(lower(canonical_ref), '\s+', ' ', 'g')) AS name, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(canonical_ref), '\s+', ' ', 'g')), '[^a-z0-9'' ]', ' ', 'g'), '\s+', ' ', 'g')) AS fuzzy FROM ents")
def x14_normalized_names(c):
    return c.entities.select("id", X.normalized_name(F.col("canonical_ref")).alias("name"), X.fuzzy_name(F.col("canonical_ref")).alias("fuzzy"))


@query(r"""SELECT id, CASE WHEN length(trim(session_time_raw)) > 10 AND regexp_matches(substring(trim(session_time_raw), 9), '\d{1,2}:\d{2}') THEN trim(session_time_raw) ELSE substring(trim(session_time_raw), 1, 10) END AS label FROM sessions""")
def x19_session_labels(c):
    return c.sessions.select("id", X.session_label(F.col("session_time_raw")).alias("label"))


@query("""SELECT session_id, string_agg(CASE WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' ELSE '' END || coalesce(content, ''), chr(10) ORDER BY position, id) AS lines FROM messages GROUP BY 1""")
def x20_session_text(c):
    own = c.messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", X.message_line(F.lit(None).cast("string"), F.col("speaker"), F.col("content")).alias("t")))).alias("m"))
    return own.select("session_id", F.array_join(F.transform("m", lambda x: x["t"]), "\n").alias("lines"))


@query("SELECT chunk_id, sha256(content) AS digest, regexp_matches(sha256(content), '^[0-9a-f]{64}$') AS valid FROM chunks WHERE content IS NOT NULL")
def x34_digests(c):
    d = F.sha2("content", 256)
    return c.chunks.filter("content is not null").select("chunk_id", d.alias("digest"), X.is_sha256(d).alias("valid"))


@query("""SELECT chunk_id, replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM chunks""")
def x35_escaped(c):
    return c.chunks.select("chunk_id", X.escaped(F.col("content")).alias("safe"))


@query("SELECT id, 'ent_' || substring(md5(task_id || '|' || entity_id), 1, 8) AS stable FROM ents")
def x37_stable_ids(c):
    return c.entities.select("id", X.stable_id("ent_", F.col("task_id").cast("string"), F.col("entity_id")).alias("stable"))


@query("SELECT id, CASE WHEN length(content) > 50 THEN substring(content, 1, 50) || '...' ELSE content END AS title FROM (SELECT id, content FROM messages WHERE position = 0)")
def x43_titles(c):
    return c.messages.filter("position = 0").select("id", X.title_of(F.col("content")).alias("title"))


@query("SELECT id, regexp_replace(content, '(?i)(parser)', '<mark>\\1</mark>', 'g') AS shown FROM messages WHERE contains(lower(content), 'parser')")
def x44_highlights(c):
    return c.messages.filter(F.lower("content").contains("parser")).select("id", X.highlighted(F.col("content"), "parser").alias("shown"))
