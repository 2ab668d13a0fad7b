import json
import zipfile

import pytest
from pyspark.sql import functions as F

from mnemoframe.sources import files
from mnemoframe.streaming import increments


def test_dialogues(spark, tmp_path):
    item = {
        "sample_id": "conv-1", "conversation": {"speaker_a": "Ann", "session_1_date_time": "1:56 pm on 8 May, 2023", "session_1": [{"speaker": "Ann", "text": "hi"}, {"speaker": "Bob", "text": "look", "blip_caption": "a cat"}], "session_2": []},
        "qa": [{"question": "q1", "answer": "a1", "category": 2, "evidence": ["D1:2", "bad"]}, {"question": "q2", "answer": "a2", "category": 5, "evidence": []}],
    }
    (tmp_path / "d.json").write_text(json.dumps([item]))
    messages, questions = files.dialogues(spark, str(tmp_path / "d.json"))
    assert [(r.position, r.content, r.session_time_raw) for r in messages.orderBy("position").collect()] == [(0, "hi", "1:56 pm on 8 May, 2023"), (1, "look [a cat]", "1:56 pm on 8 May, 2023")]
    assert [(r.question, r.evidence) for r in questions.collect()] == [("q1", "S1:1")]


def test_haystacks(spark, tmp_path):
    turns = [[{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]]
    item = {"question_id": "q", "question": "?", "answer": "!", "question_type": "t", "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_session_ids": ["s1"], "haystack_sessions": turns, "answer_session_ids": ["s1"]}
    (tmp_path / "h.json").write_text(json.dumps([item]))
    _, plain = files.haystacks(spark, str(tmp_path / "h.json"))
    assert plain.first().evidence == "S1"
    item["haystack_sessions"][0][1]["has_answer"] = True
    (tmp_path / "o.json").write_text(json.dumps([item]))
    messages, flagged = files.haystacks(spark, str(tmp_path / "h.json"), str(tmp_path / "o.json"))
    assert flagged.first().evidence == "S1:1" and messages.filter("has_answer").count() == 1


def test_personas_and_diaries(spark, tmp_path):
    (tmp_path / "p.csv").write_text('persona_id,user_query,correct_answer,incorrect_answers,conversation_scenario\n7,"{\'role\': \'user\', \'content\': \'what?\'}",tea,"[\'milk\', \'gin\', \'rum\']",home\n')
    row = files.persona_rows(spark, str(tmp_path / "p.csv")).first()
    assert row.question == "what?" and row.options.split(" | ")["ABCD".index(row.gold)] == "tea" and sorted(row.options.split(" | ")) == ["gin", "milk", "rum", "tea"]
    folder = tmp_path / "diary" / "ann"
    folder.mkdir(parents=True)
    (folder / "entries.json").write_text(json.dumps([{"id": 1, "timestamp": "", "a": "lost"}, {"id": 2, "timestamp": "2020-05-01", "a": "x"}, {"id": 3, "timestamp": "", "b": "y"}, {"id": 4, "timestamp": "2021-01-01", "c": None}]))
    got = files.diaries(spark, str(tmp_path / "diary")).orderBy("session_number", "position").collect()
    assert [(r.session_number, r.position, r.content) for r in got] == [(1, 0, "[a: x]"), (1, 1, "[b: y]"), (2, 0, "(empty)")]


def test_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"\xef\xbb\xbfhello\x00")
    (folder / "b.html").write_text("<script>x</script><p>one &amp; two</p>")
    (folder / "c.exe").write_bytes(b"MZ")
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>in a </w:t><w:t>document</w:t></w:p></w:document>')
    got = {r.file_name: (r.content, r.error) for r in files.read_files(spark, str(folder)).collect()}
    assert got["a.txt"] == ("hello", None) and got["b.html"][0] == "one & two" and got["d.docx"][0] == "in a document" and "not supported" in got["c.exe"][1]
    assert set(files.ADAPTERS) == {"dialogues", "haystacks", "personas", "diaries"}


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_json_lines(spark.createDataFrame([(1, "a")], "q long, label string"), path)
    files.append_json_lines(spark.createDataFrame([(2, "b")], "q long, label string"), path)
    assert {r.q for r in files.resume(spark, path, "q long, label string", "q").collect()} == {1, 2}
    (tmp_path / "log" / "part-bad.json").write_text("{broken")
    with pytest.raises(Exception):
        files.resume(spark, path, "q long, label string", "label").collect()


def test_runs(spark, tmp_path):
    runs = files.Runs(spark, f"file://{tmp_path}/runs")
    tables = {"facts": spark.range(3), "session_summaries": spark.range(2)}
    runs.save("one", tables)
    with pytest.raises(FileExistsError):
        runs.save("one", tables)
    runs.copy("one", "two")
    runs.truncate("two")
    assert runs.names() == ["one", "two"] and runs.tables("one") == ["facts", "session_summaries"]
    assert (runs.load("one", "facts").count(), runs.load("two", "facts").count(), runs.load("two", "session_summaries").count()) == (3, 0, 2)
    assert runs.drop("one") and runs.names() == ["two"]


def test_queue_remembers(spark, tmp_path):
    source, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    spark.createDataFrame([(1, "a")], "id long, v string").coalesce(1).write.mode("append").parquet(source)
    each = lambda batch, n: seen.extend(r.id for r in batch.collect())
    increments.run_available(increments.table_stream(spark, source), each, state)
    spark.createDataFrame([(2, "b")], "id long, v string").coalesce(1).write.mode("append").parquet(source)
    increments.run_available(increments.table_stream(spark, source), each, state)
    assert seen == [1, 2]


def streamed(spark, tmp_path, df, build, mode="append"):
    source, out = str(tmp_path / "src"), []
    df.coalesce(1).write.parquet(source)
    q = build(increments.table_stream(spark, source)).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: out.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_windows_equal_batch(spark, tmp_path):
    e = spark.range(0, 500).select((F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000)).alias("ts"), (F.col("id") % 3).alias("k"))
    got = streamed(spark, tmp_path, e, lambda s: increments.windowed_counts(s, "ts", ["k"]), "update")
    assert sum(r.n for r in got) == 500


def test_sessions_stream(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (60, 1), (7200, 1), (90000, 9)], "s long, k long").select(F.timestamp_seconds("s").alias("ts"), "k")
    got = streamed(spark, tmp_path, e, lambda s: increments.session_counts(s, "ts", ["k"]))
    assert sorted(r.n for r in got if r.k == 1) == [1, 2]


def test_jobs(spark, tmp_path):
    assert increments.next_state("running", 0, "submit", True) == ("running", 0)
    rows = [("a", "submit", None), ("a", "start", None), ("a", "finish", False), ("a", "retry", None), ("a", "start", None), ("a", "finish", True), ("b", "finish", True)]
    got = streamed(spark, tmp_path, spark.createDataFrame(rows, "request_id string, action string, ok boolean"), increments.job_states, "update")
    assert {(r.request_id, r.status, r.n_done) for r in got} == {("a", "succeeded", 1), ("b", "", 0)}


def test_tree_state_and_reflection(spark, tmp_path):
    f = spark.createDataFrame([("e", [1.0, 0.0]), ("e", [0.0, 1.0])], "entity_id string, vec array<double>")
    got = streamed(spark, tmp_path, f, increments.tree_state, "update")
    assert [(r.support, list(r.centroid)) for r in got] == [(2, [0.5, 0.5])]
    m = spark.createDataFrame([("p", "user")] * 12 + [("q", "user"), ("p", "assistant")], "persona_id string, role string")
    assert [(r.persona_id, r.n) for r in streamed(spark, tmp_path / "m", m, increments.due_for_reflection)] == [("p", 12)]


def test_index_versions(spark):
    stored = spark.createDataFrame([("c", "d1", "x", 2), ("c", "d2", "x", 1), ("c", "d3", "x", 2)], "chat_id string, document_id string, digest string, version int")
    new = spark.createDataFrame([("c", "d1", "x"), ("c", "d2", "x"), ("c", "d3", "y"), ("c", "d4", "z")], "chat_id string, document_id string, digest string")
    assert {r.document_id: r.outcome for r in increments.merged_index(stored, new, 2).collect()} == {"d1": "already_indexed", "d2": "reindexed", "d3": "conflict", "d4": "indexed"}
