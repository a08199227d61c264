"""Sequential ingest of a stream of entries: every decision sees those before it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions import text as T
from tidemark.operators.dedup import Tail, latest
from tidemark.operators.staging import exists, remove

STORE = "shard string, line_num long, version long, content string, hash string"
_WORD = re.compile(r"\w+")
_FOLDED = STORE + ", kind string, place int"


def fold(rows: pd.DataFrame, config: EngineConfig = DEFAULT) -> pd.DataFrame:
    """Decide new rows in order against the tail before them, as it stands after each decision.

    rows: shard, line_num, version, content, hash, fresh, place; of the rows that aren't fresh, the tail, place is their order.  Returns
    the versions to write (kind 'version': an appended row under its own line, a superseding one under the line it
    replaces) and the tail after them (kind 'tail').
    """
    rows = rows.sort_values(["fresh", "place", "line_num"])
    tail, held, seen, out = Tail(config), {}, set(), []
    for r in rows.itertuples():
        content, words = r.content, frozenset(_WORD.findall(r.content.lower()))
        start, size = content[:80].lower(), len(content.encode()) + 1
        line = r.line_num
        if r.fresh:
            if content:
                if r.hash in seen:
                    continue
                same, old = tail.compare(len(content), start, words)
                if same:
                    continue
                if old is not None:
                    line = old[0]
                    old[1:] = size, len(content), start, words
            seen.add(r.hash)
            out.append((r.shard, line, r.version, content, r.hash, "version", 0))
        if line == r.line_num:
            tail.add(line, size, len(content), start, words)
        held[line] = (r.version, content, r.hash)
    shard = rows["shard"].iloc[0]
    out += [(shard, item[0], *held[item[0]], "tail", k) for k, item in enumerate(tail.held)]
    return pd.DataFrame(out, columns=["shard", "line_num", "version", "content", "hash", "kind", "place"])


class Ingest:
    """An append-only versioned store at a path; `shard` names a log of its own, decided in order by one task for each
    micro-batch, whose size the source's own limit bounds.

      versions/batch=  the versions each micro-batch wrote, under the bucket of their hash
      tail/batch=      the last rows of every shard after it, as they stand

    A micro-batch reads the tail of the one before and the hash buckets its contents fall in, never the whole store.  Folders
    bear the number of the micro-batch, so one that is repeated writes the same folders again.
    """

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = DEFAULT):
        self.spark, self.path, self.config = spark, path, config

    def _before(self, batch_id: int) -> int | None:
        """The micro-batch before that has a tail."""
        if not exists(self.spark, f"{self.path}/tail"):
            return None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tail")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n[6:]) for n in names if n.startswith("batch=") and exists(self.spark, f"{self.path}/tail/{n}/_SUCCESS")]
        return max((n for n in done if n < batch_id), default=None)

    def _versions(self) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/versions"):
            return None
        return self.spark.read.schema(STORE + ", bucket string, batch long").parquet(f"{self.path}/versions")

    def current(self) -> DataFrame:
        """The store as it stands."""
        versions = self._versions()
        if versions is None:
            return self.spark.createDataFrame([], STORE)
        by_shard = versions.withColumn("key", F.struct("shard", "line_num"))
        return latest(by_shard, "key").drop("key", "bucket", "batch")

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        """One micro-batch of (shard, line_num, content); rows without line_num are dropped, null contents are empty."""
        new = rows.where("line_num is not null").select(F.coalesce("shard", F.lit("")).alias("shard"), "line_num", F.col("line_num").alias("version"), T.text(F.col("content")).alias("content"))
        new = new.withColumn("hash", T.content_hash(F.col("content"))).dropDuplicates(["shard", "line_num", "content"])
        versions, before = self._versions(), self._before(batch_id)
        if versions is not None and before is not None:
            touched = [r[0] for r in new.select(F.substring("hash", 1, 2).alias("b")).distinct().collect()]  # 256 at most
            known = versions.where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id)).select("shard", "hash").where("hash is not null").distinct()
            new = new.where("content <> ''").join(known, ["shard", "hash"], "left_anti").unionByName(new.where("content = ''"))
        new = new.withColumn("fresh", F.lit(True)).withColumn("place", F.lit(0))
        if before is not None:
            tail = self.spark.read.schema(STORE + ", place int").parquet(f"{self.path}/tail/batch={before}")
            new = new.unionByName(tail.withColumn("fresh", F.lit(False)))
        config = self.config
        columns = ["shard", "line_num", "version", "content", "hash", "fresh", "place"]
        folded = new.select(*columns).groupBy("shard").applyInPandas(lambda p: fold(p, config), _FOLDED)
        work = f"{self.path}/work"
        folded.write.mode("overwrite").parquet(work)
        decided = self.spark.read.schema(_FOLDED).parquet(work)
        wrote = decided.where("kind = 'version'").drop("kind", "place").withColumn("bucket", F.substring("hash", 1, 2)).withColumn("batch", F.lit(batch_id).cast("long"))
        wrote.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{self.path}/versions")
        decided.where("kind = 'tail'").drop("kind").write.mode("overwrite").parquet(f"{self.path}/tail/batch={batch_id}")
        if before is not None:  # an older tail can no longer be asked for
            older = self._before(before)
            if older is not None:
                remove(self.spark, f"{self.path}/tail/batch={older}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
