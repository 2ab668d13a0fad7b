"""Sources and sinks: evaluation sets in JSON and CSV, document files, JSON lines, and versioned table folders."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X

#: Question categories of dialogue sets that are kept, and file types that can be read.
CATEGORIES = {1: "Multi Hop", 2: "Temporal", 3: "Open Domain", 4: "Single Hop"}
TEXT_SUFFIXES = frozenset("txt md markdown csv tsv json jsonl log html htm".split())
OFFICE_SUFFIXES = frozenset("docx pptx xlsx".split())

_TURN = "struct<speaker:string,text:string,blip_caption:string>"


def dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, questions) of a JSON array of items with dynamic keys session_1, session_1_date_time and so on.

    messages: task_id, session_number, session_time_raw, position, speaker, content; a picture's caption follows its text in brackets.
    questions: task_id, question_id, question, answer, category, evidence (joined S1:2 refs), only of the four categories, by their names.
    """
    raw = spark.read.option("multiLine", True).schema("sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>").json(path)
    entry = raw.select(F.col("sample_id").alias("task_id"), F.explode("conversation").alias("key", "value"))
    turns = entry.filter(F.col("key").rlike(r"^session_\d+$")).select("task_id", F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("session_number"), F.posexplode(F.from_json("value", f"array<{_TURN}>")).alias("position", "t"))
    times = entry.filter(F.col("key").rlike(r"^session_\d+_date_time$")).select("task_id", F.regexp_extract("key", r"_(\d+)_", 1).cast("int").alias("session_number"), F.col("value").alias("session_time_raw"))
    said = F.coalesce("t.text", F.lit(""))
    caption = F.when(F.coalesce("t.blip_caption", F.lit("")) != "", F.concat(F.when(said != "", F.lit(" ")).otherwise(""), F.lit("["), F.col("t.blip_caption"), F.lit("]"))).otherwise("")
    messages = turns.join(times, ["task_id", "session_number"], "left").select("task_id", "session_number", "session_time_raw", "position", F.col("t.speaker").alias("speaker"), F.concat(said, caption).alias("content"))
    qa = raw.select(F.col("sample_id").alias("task_id"), F.posexplode("qa").alias("n", "q")).filter(F.col("q.category").isin(*CATEGORIES))
    refs = F.filter(F.transform("q.evidence", X.evidence_ref), lambda r: r.isNotNull())
    questions = qa.select("task_id", F.concat("task_id", F.lit("-q"), F.col("n").cast("string")).alias("question_id"), "q.question", "q.answer", F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[F.col("q.category")].alias("category"), F.array_join(refs, ", ").alias("evidence"))
    return messages, questions


def haystacks(spark: SparkSession, path: str, oracle_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, questions) of items with parallel arrays of sessions, dates and session ids.

    With an oracle file its has_answer flags are laid over by question, session and position. evidence names flagged messages, else the
    answer's sessions.
    """
    turn = "struct<role:string,content:string,has_answer:boolean>"
    schema = f"question_id string, question string, answer string, question_type string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<{turn}>>, answer_session_ids array<string>"

    def exploded(p: str) -> tuple[DataFrame, DataFrame]:
        raw = spark.read.option("multiLine", True).schema(schema).json(p)
        zipped = F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), F.col("haystack_dates").alias("at"), F.col("haystack_sessions").alias("turns"))
        s = raw.select("question_id", F.posexplode(zipped).alias("n", "s"))
        return raw, s.select("question_id", (F.col("n") + 1).alias("session_number"), F.col("s.session_id").alias("session_id"), F.col("s.at").alias("session_time_raw"), F.posexplode("s.turns").alias("position", "t"))

    raw, turns = exploded(path)
    flag = F.coalesce("t.has_answer", F.lit(False))
    messages = turns.select("question_id", "session_number", "session_id", "session_time_raw", "position", F.col("t.role").alias("speaker"), F.when(F.col("t.role") == "assistant", X.shortened_reply(F.col("t.content"))).otherwise(X.shortened_question(F.col("t.content"))).alias("content"), flag.alias("has_answer"))
    if oracle_path:
        known = exploded(oracle_path)[1].select("question_id", "session_id", "position", F.coalesce("t.has_answer", F.lit(False)).alias("o")).groupBy("question_id", "session_id", "position").agg(F.max("o").alias("o"))
        messages = messages.join(known, ["question_id", "session_id", "position"], "left").withColumn("has_answer", F.coalesce("o", "has_answer")).drop("o")
    by_flag = messages.filter("has_answer").groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct("session_number", "position"))).alias("e"))
    flagged = by_flag.select("question_id", F.array_join(F.transform("e", lambda x: F.concat(F.lit("S"), x["session_number"].cast("string"), F.lit(":"), x["position"].cast("string"))), ", ").alias("by_message"))
    whole = messages.select("question_id", "session_id", "session_number").distinct().join(raw.select("question_id", F.explode("answer_session_ids").alias("session_id")), ["question_id", "session_id"])
    by_session = whole.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("session_number")), lambda n: F.concat(F.lit("S"), n.cast("string"))), ", ").alias("by_session"))
    questions = raw.select("question_id", "question", "answer", F.col("question_type").alias("category")).join(flagged, "question_id", "left").join(by_session, "question_id", "left")
    return messages, questions.select("question_id", "question", "answer", "category", F.coalesce("by_message", "by_session", F.lit("")).alias("evidence"))


def persona_rows(spark: SparkSession, csv_path: str) -> DataFrame:
    """(task_id, question_id, question, answer, options, gold, category): rows of a CSV by persona, options in an order fixed by the row, gold the letter A to D."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv_path)
    wrong = F.transform(F.split(F.regexp_replace("incorrect_answers", r"^\[|\]$", ""), r",\s*(?=['\"])"), lambda s: F.regexp_replace(F.trim(s), r"^['\"]|['\"]$", ""))
    question = F.coalesce(F.nullif(F.regexp_extract("user_query", r"['\"]content['\"]\s*:\s*(['\"])(.*?)\1\s*[,}]", 2), F.lit("")), F.col("user_query"))
    numbered = raw.withColumn("_n", F.row_number().over(Window.partitionBy("persona_id").orderBy("user_query", "correct_answer")) - 1)
    key = F.concat_ws("-", "persona_id", F.col("_n").cast("string"))
    options = X.shuffled(F.concat(F.array("correct_answer"), wrong), key)
    out = numbered.select(F.col("persona_id").alias("task_id"), key.alias("question_id"), question.alias("question"), F.col("correct_answer").alias("answer"), options.alias("o"), F.col("conversation_scenario").alias("category"))
    letter = F.substring(F.lit("ABCDEFGH"), F.array_position("o", F.col("answer")).cast("int"), F.lit(1))
    return out.select("task_id", "question_id", "question", "answer", F.array_join("o", " | ").alias("options"), letter.alias("gold"), "category")


def diaries(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, session_number, position, session_time_raw, content): entries of each folder's entries.json as one session a year.

    A blank timestamp takes the one before; entries before the first are left out. Free keys become `[k: v]` parts.
    """
    raw = spark.read.option("wholetext", True).text(f"{folder}/*/entries.json").select(F.regexp_extract(F.input_file_name(), r"([^/]+)/entries\.json$", 1).alias("task_id"), F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("n", "e"))
    w = Window.partitionBy("task_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.nullif(F.trim(F.col("e")["timestamp"]), F.lit("")), ignorenulls=True).over(w)
    filled = raw.withColumn("at", at).filter("at is not null").withColumn("year", F.substring("at", 1, 4))
    session = F.dense_rank().over(Window.partitionBy("task_id").orderBy("year"))
    position = F.row_number().over(Window.partitionBy("task_id", "year").orderBy("n")) - 1
    return filled.select("task_id", session.alias("session_number"), position.alias("position"), F.col("at").alias("session_time_raw"), X.diary_content(F.col("e")).alias("content"))


#: Readers of evaluation sets by name.
ADAPTERS: dict[str, Callable] = {"dialogues": dialogues, "haystacks": haystacks, "personas": persona_rows, "diaries": diaries}


def _office_text(data: bytes, suffix: str) -> list[tuple[str, int | None]]:
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        wanted = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide(\d+)\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet(\d+))\.xml"}[suffix]
        for name in sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            if m := re.fullmatch(wanted, name):
                lines = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in ElementTree.fromstring(z.read(name)).iter() if p.tag.endswith(("}p", "}si"))]
                if body := "\n".join(x for x in lines if x.strip()):
                    parts.append((body, int(m.group(1)) if m.groups() and m.group(1) and suffix == "pptx" else None))
    return parts


def _markup_text(text: str) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)
    text = re.sub(r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", "\n", text)
    return html.unescape(re.sub(r"<[^>]+>", " ", text))


def parse_file(data: bytes, file_name: str) -> list[tuple[str, int | None]]:
    """(text, page) sections of a file: text and markup, JSON, tables and office documents; other types raise ValueError."""
    suffix = file_name.rpartition(".")[2].lower()
    if suffix in OFFICE_SUFFIXES:
        return _office_text(data, suffix)
    if suffix not in TEXT_SUFFIXES:
        raise ValueError(f"file type not supported: {suffix}")
    text = data.decode("utf-8-sig")
    if suffix in ("html", "htm"):
        text = _markup_text(text)
    if suffix == "json":
        text = json.dumps(json.loads(text), ensure_ascii=False, indent=1)
    pages = [(p.replace("\x00", " ").strip(), None) for p in [text]]
    return [(p, n) for p, n in pages if p]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, digest, section, page, content, error): sections of every file under path, parsed on the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.sha2("content", 256).alias("digest"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, digest, data in zip(batch["file_name"], batch["digest"], batch["content"]):
                try:
                    rows += [(name, digest, i, page, text, None) for i, (text, page) in enumerate(parse_file(bytes(data), name))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((name, digest, 0, None, None, str(e)[:400]))
            out = pd.DataFrame(rows, columns=["file_name", "digest", "section", "page", "content", "error"])
            yield out.assign(page=out["page"].astype("Int64"))

    return raw.mapInPandas(run, "file_name string, digest string, section int, page long, content string, error string")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def resume(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Distinct keys already in the JSON lines at path; a corrupt line raises an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(key).distinct()


class Runs:
    """Versioned table folders: root/<run>/<table> in parquet with a manifest of what was saved."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, run: str, tables: dict[str, DataFrame], replace: bool = False) -> None:
        """Write all tables beside the run and move them into place at the end; an existing run is an error unless replace."""
        target, fs = self._fs(f"{self.root}/{run}")
        if fs.exists(target) and not replace:
            raise FileExistsError(run)
        staged = f"{self.root}/.{run}.staged"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{staged}/{name}")
        counts = [(name, self.spark.read.parquet(f"{staged}/{name}").count()) for name in tables]
        self.spark.createDataFrame(counts, "name string, n_rows long").coalesce(1).write.mode("overwrite").json(f"{staged}/_manifest")
        fs.delete(target, True)
        fs.rename(self._fs(staged)[0], target)

    def load(self, run: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{run}/{name}")

    def tables(self, run: str) -> list[str]:
        return [r[0] for r in self.spark.read.schema("name string, n_rows long").json(f"{self.root}/{run}/_manifest").orderBy("name").collect()]

    def copy(self, run: str, to: str) -> None:
        self.save(to, {n: self.load(run, n) for n in self.tables(run)})

    def truncate(self, run: str, keep: frozenset[str] = frozenset({"session_summaries"})) -> None:
        """Empty every table but those in keep."""
        self.save(f"{run}.new", {n: self.load(run, n) if n in keep else self.load(run, n).limit(0) for n in self.tables(run)}, replace=True)
        old, fs = self._fs(f"{self.root}/{run}")
        fs.delete(old, True)
        fs.rename(self._fs(f"{self.root}/{run}.new")[0], old)

    def drop(self, run: str) -> bool:
        path, fs = self._fs(f"{self.root}/{run}")
        return bool(fs.delete(path, True))

    def names(self) -> list[str]:
        path, fs = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and not s.getPath().getName().startswith(".")) if fs.exists(path) else []
