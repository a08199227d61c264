"""Positions in a total order without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.staging import staged


def positions(rows: DataFrame, by: str, name: str = "pos") -> DataFrame:
    """The rows with their 0-based position by a unique column.

    Rows are range-partitioned, numbered inside their partition and shifted by the rows of the partitions before;
    the driver sees one number for each partition.
    """
    part = staged(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = part.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, before = [], 0
    for r in counts:
        starts.append((r["_part"], before))
        before += r["n"]
    shift = rows.sparkSession.createDataFrame(starts, "_part int, _before long")  # a row for each partition
    inside = part.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    return inside.join(F.broadcast(shift), "_part").select(*rows.columns, (F.col("_before") + F.col("_place") - 1).alias(name))
