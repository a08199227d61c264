"""Interface to text completion.  No backend is part of the library; without one every answer is null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    def complete(self, prompt: str) -> str | None: ...


def cache_key(prompt: Column) -> Column:
    return F.substring(F.md5(prompt), 1, 16)


def verdict_key(text: Column) -> Column:
    """The key under which a classifier's verdict on a text is kept."""
    return F.substring(F.md5(text), 1, 12)


def complete(prompts: DataFrame, memo: DataFrame | None = None, backend: Callable[[], Backend] | None = None) -> DataFrame:
    """(id, prompt, key, response) of (id, prompt): from the memo table (key, response) where it knows the prompt, else from
    the backend, made once in each task; a backend that fails answers null."""
    rows = prompts.select("id", "prompt", cache_key(F.col("prompt")).alias("key"))
    if memo is not None:
        rows = rows.join(memo.select("key", F.col("response").alias("known")), "key", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    rows = rows.select("id", "prompt", "key", F.col("known").alias("response"))
    if backend is None:
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()

        def ask(prompt: str) -> str | None:
            try:
                return model.complete(prompt)
            except Exception:
                return None

        for b in batches:
            b = b.copy()
            open_ = b["response"].isna() & b["prompt"].notna()
            b.loc[open_, "response"] = b.loc[open_, "prompt"].map(ask)
            yield b

    return rows.mapInPandas(run, rows.schema)
