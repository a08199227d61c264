"""Tables written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Where it is unset, a session on one machine (local master) gets a temporary folder
    that is deleted at its end; on a cluster that would lose data, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
        _delete_on_exit(spark, where)
    return where.rstrip("/")


def _delete_on_exit(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, deleted when the driver's JVM ends."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, where)
    return where


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = _path(spark, where)
    return fs.exists(path)


def touch(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.create(path, True).close()


def remove(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.delete(path, True)


def stamp(spark: SparkSession, where: str) -> str:
    """Names, lengths and times of the files of a table."""
    path, fs = _path(spark, where)
    files = fs.listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return ",".join(sorted(out))


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write (in folders by the given columns) and read back: lineage ends in files that outlive any executor; they go when
    the driver's JVM ends."""
    where = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
