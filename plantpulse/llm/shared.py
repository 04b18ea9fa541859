"""Helpers of the training-data operators: tables, written intermediates, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from plantpulse.session import checkpoint_dir


#: Rows of a group of texts; places in it take 16 bits.
MOST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; a cluster, whose executors would
    not find it, a ValueError.
    """
    own = tempfile.mkdtemp(prefix="spark-llm-") if spark.sparkContext.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None) else None
    return f"{checkpoint_dir(spark, own).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: later steps neither recompute nor lose them."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def groups_of_texts(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut or join batches so that each holds about ``most`` bytes of ``column``, and at most MOST_ROWS rows.

    A single row is never cut.
    """
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        first = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for row, length in enumerate(lengths):
            size, rows = size + length, rows + 1
            if size >= most or rows >= MOST_ROWS:
                held.append(batch.slice(first, row + 1 - first))
                yield _joined(held)
                held, size, rows, first = [], 0, 0, row + 1
        if first < len(lengths):
            held.append(batch.slice(first))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
