"""Token counts: pieces are counted once per distinct pre-token and summed by its frequencies; no ids are kept.

A pre-token is a run of white space with the run of other characters behind it (see bytebpe). Rows of
one pre-token meet in one task, which counts its pieces once; a pre-token in very many documents of a
chunk is salted, and then counted once per salt.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.bytebpe import ByteBPE, Encoder
from plantpulse.llm.postings import document_sums, postings

#: Larger than the default: fewer chunks repeat fewer pre-tokens.
CHUNK_BYTES = 16 << 20
#: Postings of more bytes are dealt out by chunk as well as by pre-token.
LONG_POSTING = 1024


def piece_counter(path: str) -> Callable[[pa.RecordBatch], list[np.ndarray]]:
    encoder = Encoder(path)

    def count(batch: pa.RecordBatch) -> list[np.ndarray]:
        numbers = encoder.numbers(batch.column("term").to_pylist())
        return [encoder.sizes[numbers]]

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row of ``docs``.

    ``path`` is a byte-level BPE file. Special strings inside a text count as the library takes them by
    default (one token). A null text is empty; a null or repeated doc_id gives one row for each row.
    Other columns of ``docs`` are not read.
    """
    salt = F.when(F.octet_length("posting") > LONG_POSTING, F.col("chunk")).otherwise(0)
    rows = postings(docs, lambda: ByteBPE(path).units, chunk_bytes=CHUNK_BYTES).select("chunk", "term", "posting", "about").repartition("term", salt)
    return document_sums(rows, lambda: piece_counter(path), ["n_tokens"]).select(
        "doc_id", "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("n_tokens") > limit).alias("over_limit")
    )
