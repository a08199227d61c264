"""python -m tidemark QUERY FOLDER: run a registered query over a folder of tables and show its rows."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tidemark.plans import catalog


def main(args: list[str]) -> None:
    known = catalog.queries()
    if len(args) != 2 or args[0] not in known:
        sys.exit(f"{__doc__}\nQueries: {' '.join(known)}")
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    known[args[0]](spark, args[1]).show(50, 100)


if __name__ == "__main__":
    main(sys.argv[1:])
