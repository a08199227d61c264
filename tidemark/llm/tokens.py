"""Sizes of texts in tokens of a public byte-level BPE tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary as ranks, one "base64-token rank" in a line; the driver sends the file to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("tidemark", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def counted(documents: DataFrame, *columns: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, the further columns) of the documents that have any token; null and empty texts have none."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *columns).where("doc_id is not null and text <> ''")
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*columns).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, *b.columns[2:]], names=["doc_id", "n_tokens", *b.schema.names[2:]])

    return rows.mapInArrow(run, "doc_id long, n_tokens long" + (f", {kinds}" if columns else "")).where("n_tokens > 0")
