"""The prepared-entry cache: full build, incremental sync, inline append, dirty mark, kept word weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import corpus
from tidemark.operators.staging import exists, remove, touch


def prepared(log: DataFrame) -> DataFrame:
    """(line_num, tokens, stems, soundex_codes, tag_tokens, tag_soundex, entry_type, content_hash) of every entry; sets are
    sorted and joined by spaces."""
    def joined(words):
        return F.array_join(F.array_sort(F.array_distinct(words)), " ")

    def codes(words):
        return F.filter(F.transform(words, T.soundex), lambda c: c != "")

    tokens = T.tokens(T.searchable(F.col("content"), F.col("tags"), F.col("type")))
    tags = T.tokens(T.tags_text(F.col("tags")))
    rows = log.where("line_num is not null").select("line_num", tokens.alias("t"), tags.alias("g"), F.lower(T.text(F.col("type"))).alias("entry_type"), T.content_hash(T.text(F.col("content"))).alias("content_hash"))
    return rows.select(
        "line_num", joined(F.col("t")).alias("tokens"), joined(F.expr(f"transform(t, w -> {T.stem_sql('w')})")).alias("stems"), joined(codes(F.col("t"))).alias("soundex_codes"),
        joined(F.col("g")).alias("tag_tokens"), joined(codes(F.col("g"))).alias("tag_soundex"), "entry_type", "content_hash",
    )


def _fingerprint(log: DataFrame, upto: int | None = None) -> dict:
    """(rows, last line, a sum over the hashes of rows) of the log up to a line; it changes with any line."""
    rows = log.where("line_num is not null")
    if upto is not None:
        rows = rows.where(F.col("line_num") <= upto)
    one = F.xxhash64("line_num", "type", "content", F.to_json(F.array("tags"))).cast("decimal(38,0)")
    got = rows.agg(F.count("*").alias("n"), F.max("line_num").alias("last"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("sum")).first()
    return {"n": got["n"], "last": got["last"], "sum": got["sum"]}


def _meta(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, f"{path}/meta/_SUCCESS") or exists(spark, f"{path}/_dirty"):
        return None
    return spark.read.schema("n long, last long, sum string").json(f"{path}/meta").first().asDict()


def _note(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(meta["n"], meta["last"], meta["sum"])], "n long, last long, sum string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def sync(log: DataFrame, path: str) -> DataFrame:
    """Bring the cache at a path up to date and return it.  New lines are appended; a cache that was marked dirty, or whose lines
    are no longer those of the log (it shrank, or a line was replaced, by one of equal length too), is built anew."""
    spark = log.sparkSession
    meta = _meta(spark, path)
    if meta is not None and _fingerprint(log, meta["last"] if meta["last"] is not None else -(2**63)) == meta:
        fresh = log if meta["last"] is None else log.where(F.col("line_num") > meta["last"])
        prepared(fresh).write.mode("append").parquet(f"{path}/entries")
    else:
        remove(spark, f"{path}/meta")
        prepared(log).write.mode("overwrite").parquet(f"{path}/entries")
        remove(spark, f"{path}/_dirty")
    _note(spark, path, _fingerprint(log))
    return spark.read.parquet(f"{path}/entries")


def append_inline(entries: DataFrame, log: DataFrame, path: str) -> DataFrame:
    """Append entries that were just added to the log without a look at the others; if they are not the next lines, the cache
    is marked dirty instead.  log: the log with them."""
    spark = log.sparkSession
    meta, first = _meta(spark, path), entries.agg(F.min("line_num")).first()[0]
    if meta is None or first is None or (meta["last"] is not None and first <= meta["last"]):
        mark_dirty(spark, path)
    else:
        prepared(entries).write.mode("append").parquet(f"{path}/entries")
        _note(spark, path, _fingerprint(log))
    return spark.read.parquet(f"{path}/entries")


def mark_dirty(spark: SparkSession, path: str) -> None:
    """The next sync builds the cache anew."""
    touch(spark, f"{path}/_dirty")


def idf_at(path: str, now: str, *entries: DataFrame, hours: float = 24, rows: int = 50) -> DataFrame:
    """(token, df, weight) as kept at a path; counted again if it is older than so many hours or the collection has
    grown or shrunk by so many rows since."""
    spark = entries[0].sparkSession
    n = sum(e.count() for e in entries)
    if exists(spark, f"{path}/meta/_SUCCESS"):
        meta = spark.read.schema("n long, at timestamp").json(f"{path}/meta").select("n", (F.unix_seconds(F.to_timestamp(F.lit(now))) - F.unix_seconds("at")).alias("age")).first()
        if meta["age"] < hours * 3600 and abs(n - meta["n"]) < rows:
            return spark.read.parquet(f"{path}/weights")
    remove(spark, f"{path}/meta")
    corpus.idf(*entries).write.mode("overwrite").parquet(f"{path}/weights")
    spark.range(1).select(F.lit(n).alias("n"), F.to_timestamp(F.lit(now)).alias("at")).write.mode("overwrite").json(f"{path}/meta")
    return spark.read.parquet(f"{path}/weights")
