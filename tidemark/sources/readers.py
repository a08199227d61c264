"""Readers and sinks: JSON lines, curated entries, aliases, transcripts, plan files, tails, append and replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators.dedup import latest
from tidemark.operators.order import positions

ENTRY = "type string, content string, tags array<string>, timestamp string, session_id string, source string, section string, priority int"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_num, line) of text files in file order, 1-based over all files by name; blank lines have no number."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"))
    placed = positions(raw.where(T.strip(F.col("line")) != "").withColumn("at", F.struct("file", "id")), "at")
    return placed.select((F.col("pos") + 1).alias("line_num"), "line")


def parsed_entries(lines: DataFrame) -> DataFrame:
    """(line_num, type, content, tags, timestamp, session_id, source, section, priority) of JSON lines; blank and broken lines
    are dropped, a missing session is 'unknown'."""
    e = F.from_json("line", ENTRY + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.where("line is not null").withColumn("e", e).where("e is not null and e._broken is null and line rlike '^\\\\s*\\\\{'")
    return rows.select("line_num", "e.type", "e.content", "e.tags", "e.timestamp", F.coalesce("e.session_id", F.lit("unknown")).alias("session_id"), "e.source", "e.section", "e.priority")


def memory_log(spark: SparkSession, path: str) -> DataFrame:
    return parsed_entries(lines(spark, path)).drop("section", "priority").withColumnRenamed("timestamp", "logged_at")


def core_tagged(spark: SparkSession, path: str) -> DataFrame:
    rows = parsed_entries(lines(spark, path))
    return rows.select(F.col("line_num").alias("core_id"), "section", "content", "tags", "priority", "type")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias_key, expansions) of one JSON object; a broken file has none."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("alias_key", "expansions"))


def core_memory(spark: SparkSession, path: str) -> DataFrame:
    """(text, n_lines) of the one text of core memory."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.size(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("n_lines"))


def plan_files(spark: SparkSession, folder: str, modified_after: str | None = None) -> DataFrame:
    """(path, stem, text) of the Markdown files of 100 characters or more."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.md")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.load(folder).select("path", F.decode("content", "UTF-8").alias("text")).where("length(text) >= 100")
    return rows.select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), "text")


def tail(rows: DataFrame, by: str, max_bytes: int) -> DataFrame:
    """The last rows of a log whose lines end less than max_bytes bytes before its end, all if the whole log is shorter.

    A line has a byte or more, so only the last max_bytes rows can be among them: a top-k, then a sum over those.
    """
    last = rows.where(F.col(by).isNotNull()).orderBy(F.desc(by)).limit(max_bytes)
    upto = F.sum(F.octet_length("line") + 1).over(Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0))
    return last.withColumn("_upto", upto).where(F.col("_upto") < max_bytes).drop("_upto")


def transcript_file(spark: SparkSession, folder: str, session_id: str | None = None) -> str | None:
    """The file of a session, or else the one changed last; null without any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    own = F.col("path").endswith(f"/{session_id}.jsonl") if session_id else F.lit(False)
    got = files.orderBy(F.desc(own), F.desc("modificationTime"), "path").limit(1).collect()
    return got[0]["path"] if got else None


def transcript(spark: SparkSession, folder: str, session_id: str | None = None, max_bytes: int = 500_000, n_lines: int = 200) -> DataFrame:
    """(text) of a session's transcript: of the last max_bytes bytes the last n_lines lines, user lines behind [USER]."""
    path = transcript_file(spark, folder, session_id)
    if path is None:
        return spark.createDataFrame([], "text string")
    numbered = lines(spark, path).select(F.col("line_num").alias("pos"), "line")
    last = tail(numbered, "pos", max_bytes).orderBy(F.desc("pos")).limit(n_lines).withColumn("doc_id", F.lit(0))
    said = transcript_messages(last).select("pos", F.concat(F.when(F.col("role") == "user", "[USER] ").otherwise(""), "text").alias("text"))
    return said.agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts")).select(F.expr("array_join(transform(parts, p -> p.text), '\n')").alias("text"))


def transcript_messages(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, role, text) of JSON transcript lines (doc_id, pos, line) in both layouts: role and content, or type
    and message; content is a string or blocks of text.  Other roles and broken lines are dropped."""
    role = F.coalesce(F.get_json_object("line", "$.role"), F.get_json_object("line", "$.message.role"), F.get_json_object("line", "$.type"))
    content = F.coalesce(F.get_json_object("line", "$.content"), F.get_json_object("line", "$.message.content"))
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
    text = F.when(F.startswith(T.strip(content), F.lit("[")), joined).otherwise(content)
    return lines.select("doc_id", "pos", role.alias("role"), text.alias("text")).where("role in ('user', 'assistant') and text <> ''")


def transcript_tail(docs: DataFrame, n_lines: int = 200) -> DataFrame:
    """(doc_id, n_lines, n_user, text): the last lines of each transcript that say anything."""
    parts = docs.select("doc_id", F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "").alias("all"))
    last = parts.select("doc_id", F.expr(f"slice(all, greatest(size(all) - {n_lines - 1}, 1), {n_lines})").alias("lines"))
    user = F.size(F.filter("lines", lambda x: F.startswith(x, F.lit("[USER] "))))
    return last.select("doc_id", F.size("lines").alias("n_lines"), user.alias("n_user"), F.array_join("lines", "\n").alias("text"))


def append_observations(rows: DataFrame, path: str) -> None:
    """Append observations (date, project_tags, topic_tags, content, session_id, source, priority, type) as JSON lines; what is
    missing is left out of the line, rows without content are dropped."""
    names = ["date", "project_tags", "topic_tags", "content", "session_id", "source", "priority", "type"]
    append(rows.where("content is not null").select(*[c for c in names if c in rows.columns]), path)


def append(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines; the commit protocol takes the place of a lock."""
    entries.write.mode("append").json(path)


def replace_lines(versions: DataFrame, changes: DataFrame, path: str) -> DataFrame:
    """Write the changes (line_num, ..., version) as new versions to an append-only table and return it as it stands."""
    changes.select(*versions.columns).write.mode("append").parquet(path)
    return latest(versions.sparkSession.read.parquet(path))
