"""Token ids in files of fixed-width bits, with block offsets for vectorised and random reading.

A file holds, in this order: blocks of ``BLOCK`` ids, each id in the least number of bits that the
vocabulary needs, lowest bit first, each block starting on a byte; a footer of little-endian 64-bit
integers (for each document whether it has an id, the id, the place behind its last token id; then the
byte at which each block starts, and the end); the four numbers documents, ids, bits and block size;
the magic text. Files are numbered in the order of their documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.bytebpe import shared_encoder
from plantpulse.llm.shared import groups_of_texts, new_folder, written

BLOCK = 4096
MAGIC = b"PLIDS001"
#: Widths of whole bytes: the same layout, without shifts.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill ``bits`` bytes; the last eight are filled up with zeros."""
    if bits in WHOLE:
        return np.concatenate([ids, np.zeros(-len(ids) % 8, np.uint32)]).astype(WHOLE[bits]).tobytes()
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits + 8), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of what pack() made."""
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits])[:count].astype(np.uint32)
    rows = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.zeros((len(rows), 8), np.uint32)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(len(rows), np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= rows[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:count]


class PackedWriter:
    """Appends documents to one file; only a block of ids is held."""

    def __init__(self, file, bits: int):
        self.file, self.bits = file, bits
        self.rest = np.zeros(0, np.uint32)
        self.docs: list[int | None] = []
        self.ends: list[np.ndarray] = []
        self.offsets, self.count = [0], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs += doc_ids
        self.ends.append(self.count + np.cumsum(sizes))
        self.count += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        self._blocks(self.rest[:whole])
        self.rest = self.rest[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.file.write(data)
        step = BLOCK * self.bits // 8
        start = self.offsets[-1]
        self.offsets += [min(start + step * (k + 1), start + len(data)) for k in range(-(-len(ids) // BLOCK))]

    def close(self) -> None:
        self._blocks(self.rest)
        ends = np.concatenate(self.ends) if self.ends else np.zeros(0, np.int64)
        footer = [[x is not None for x in self.docs], [x or 0 for x in self.docs], ends, self.offsets, [len(self.docs), self.count, self.bits, BLOCK]]
        self.file.write(b"".join(np.array(x, "<i8").tobytes() for x in footer) + MAGIC)
        self.file.close()


class PackedFile:
    """Reads one file: its documents, and any range of ids."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._at(size - 40, 40)
        if tail[32:] != MAGIC:
            raise ValueError("not a packed token file, or cut off")
        docs, self.count, self.bits, self.block = np.frombuffer(tail[:32], "<i8").tolist()
        n_blocks = -(-self.count // self.block)
        long = 8 * (3 * docs + n_blocks + 1)
        numbers = np.frombuffer(self._at(size - 40 - long, long), "<i8")
        self.has_id, self.doc_ids, self.ends = numbers[: 3 * docs].reshape(3, docs)
        self.offsets = numbers[3 * docs :]

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self._at(self.offsets[first], self.offsets[last + 1] - self.offsets[first])
        out = unpack(data, self.bits, min((last + 1) * self.block, self.count) - first * self.block)
        return out[start - first * self.block : stop - first * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """For runs of documents of about ``most`` ids: the first, the one behind the last, and their ids."""
        low = 0
        while low < len(self.ends):
            begin = self.ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(self.ends, begin + most, "right")))
            yield low, high, self.ids(int(begin), int(self.ends[high - 1]))
            low = high


def write_packed(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode ``text`` (null: empty) of all documents, each ended by ``end_id``, to files below ``folder``.

    Documents stand in ascending order of doc_id, a null id first; rows with one id in the order of their
    texts' hashes and texts. Returns the files: file, part (its rank), n_docs, n_ids. A file is named by the attempt
    that wrote it, so a repeated task leaves at most a file that no row names.
    """
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, writer = TaskContext.get(), None
        for batch in groups_of_texts(batches, "text", 2 << 20):
            if writer is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base)
                name = f"{base}/ids-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                encoder = shared_encoder(path)
                writer = PackedWriter(store.open_output_stream(name), max(1, (max(encoder.bpe.size - 1, end_id)).bit_length()))
            ids, sizes = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            ends = np.cumsum(sizes)
            writer.add(batch.column("doc_id").to_pylist(), np.insert(ids, ends, end_id), sizes + 1)
        if writer is not None:
            writer.close()
            row = {"file": [name], "part": [task.partitionId()], "n_docs": [len(writer.docs)], "n_ids": [writer.count]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return written(ordered.mapInArrow(run, "file string, part int, n_docs bigint, n_ids bigint"), "packed-files")


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens (with the end id) and ids_crc32 of every document.

    ids_crc32 is the unsigned crc32 of the document's ids as little-endian unsigned 32-bit integers.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a given number of partitions is not merged, so that files are read side by side
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("start")).repartition(max(1, files.count()), "file")
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                packed = PackedFile(store.open_input_file(row["file"]))
                begins = np.concatenate([[0], packed.ends])[:-1] if len(packed.ends) else packed.ends
                for low, high, ids in packed.documents():
                    data = memoryview(ids.astype("<u4").tobytes())
                    cut = ((packed.ends[low:high] - begins[low]) * 4).tolist()
                    sums = [zlib.crc32(data[a:b]) for a, b in zip([0, *cut], cut, strict=False)]
                    columns = [
                        pa.array(packed.doc_ids[low:high], mask=packed.has_id[low:high] == 0),
                        pa.array(row["start"] + begins[low:high]),
                        pa.array(packed.ends[low:high] - begins[low:high]),
                        pa.array(sums, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return starts.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def packed_round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids to a new shared folder and read them back, one row per row of ``docs``.

    An empty table gives no file and no row. Columns other than doc_id and text are not read.
    """
    folder = new_folder(docs.sparkSession, "packed-ids")
    return read_documents(write_packed(docs, path, folder, end_id), folder)
