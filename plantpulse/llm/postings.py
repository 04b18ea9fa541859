"""Per-document sums of a value per term, where neither terms nor documents fit one machine.

Documents are taken in chunks of a few MB. A chunk has one row per distinct term with a posting: the
place in the chunk of every occurrence's document, so that a document's frequency of the term is how
often its place stands there. Terms meet their values, and the products are summed per chunk and place
inside each task before they go to their chunk. Nothing is collected.

Chunks follow the order in which a task reads its rows. Use documents that a retried task reads in the
same order: a table, or a checkpoint.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plantpulse.llm.shared import groups_of_texts

CHUNK_BYTES = 8 << 20

#: ``posting``: the number of documents of the chunk, then the places. ``about`` (one row per chunk, else
#: null): for each document whether it has an id, the id, its bytes, its terms and what it carries. ``counted``: see postings().
ROWS = "chunk bigint, term string, posting binary, counted bigint, about binary"
SCHEMA = pa.schema([("chunk", pa.int64()), ("term", pa.string()), ("posting", pa.binary()), ("counted", pa.int64()), ("about", pa.binary())])


def postings(
    docs: DataFrame,
    splitter: Callable[[], Callable[[str], list[str]]],
    counts: Callable[[int | None], bool] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    carry: str | None = None,
) -> DataFrame:
    """One row per chunk and distinct term, and one per chunk that tells its documents.

    ``docs`` has ``doc_id`` and ``text`` (null: empty). ``splitter`` makes, in each task, the function
    from a text to its terms. ``counted`` is the term's occurrences in documents whose id ``counts``.
    ``carry`` names a bigint column, never null, that document_sums() is to return.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = splitter()
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(groups_of_texts(batches, "text", chunk_bytes)):
            yield from _chunk(task << 32 | number, batch, split, counts, carry)

    return docs.select("doc_id", "text", *([carry] if carry else [])).mapInArrow(run, ROWS)


def _chunk(chunk: int, batch: pa.RecordBatch, split: Callable, counts: Callable | None, carry: str | None) -> Iterator[pa.RecordBatch]:
    ids, codes, sizes, n_bytes = batch.column("doc_id").to_pylist(), [], [], []
    seen: dict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    for text in batch.column("text"):
        text = text.as_py() or ""
        terms = split(text)
        n_bytes.append(len(text.encode()))
        sizes.append(len(terms))
        codes.append(np.fromiter(map(seen.__getitem__, terms), np.int64, len(terms)))
    width = len(ids)
    keys = np.sort((np.concatenate(codes) << 16) | np.repeat(np.arange(width), sizes))
    bounds = np.searchsorted(keys, np.arange(len(seen) + 1) << 16)
    learns = np.array([counts(x) for x in ids], bool) if counts else np.zeros(width, bool)
    counted = np.diff(np.concatenate([[0], np.cumsum(learns[keys & 0xFFFF])])[bounds])
    places = np.insert((keys & 0xFFFF).astype("<u2"), bounds[:-1], width)
    bounds = bounds + np.arange(len(bounds))
    names = list(seen)
    for low in range(0, len(names), 20_000):
        some = names[low : low + 20_000]
        cut = bounds[low : low + len(some) + 1]
        offsets = pa.py_buffer(((cut - cut[0]) * 2).astype(np.int32).tobytes())
        posting = pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(places[cut[0] : cut[-1]].tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), chunk)), pa.array(some, pa.string()), posting, pa.array(counted[low : low + len(some)]), pa.nulls(len(some), pa.binary())],
            schema=SCHEMA,
        )
    carried = [batch.column(carry).to_numpy()] if carry else []
    about = np.array([[x is not None for x in ids], [x or 0 for x in ids], n_bytes, sizes, *carried], np.int64)
    # a term of its own, so that these rows spread over the partitions
    name = f"\x00{uuid.uuid5(uuid.NAMESPACE_OID, str(chunk))}"
    yield pa.RecordBatch.from_pydict({"chunk": [chunk], "term": [name], "posting": [None], "counted": [0], "about": [about.tobytes()]}, schema=SCHEMA)


def document_sums(rows: DataFrame, values: Callable[[], Callable[[pa.RecordBatch], list[np.ndarray]]], columns: list[str], carry: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_terms, and for each of ``columns`` the sum of a value over all terms of the document.

    ``rows`` come from :func:`postings`, dealt out in any way and with more columns or not; ``carry`` as given there. ``values``
    makes, in each task, the function from some rows to one array of values per column.
    """
    partial = "chunk bigint, places binary, sums binary, about binary"
    kinds = pa.schema([("chunk", pa.int64()), ("places", pa.binary()), ("sums", pa.binary()), ("about", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        found = values()

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, sums in held.items():
                places = np.flatnonzero(sums.any(axis=0))
                row = {"chunk": [chunk], "places": [places.astype("<u2").tobytes()], "sums": [np.ascontiguousarray(sums[:, places]).tobytes()]}
                yield pa.RecordBatch.from_pydict(row | {"about": [None]}, schema=kinds)
            held.clear()

        for batch in batches:
            told = batch.filter(pc.is_valid(batch.column("about")))
            if told.num_rows:
                none = pa.nulls(told.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([told.column("chunk"), none, none, told.column("about")], schema=kinds)
            batch = batch.filter(pc.is_valid(batch.column("posting")))
            if not batch.num_rows:
                continue
            sizes = pc.binary_length(batch.column("posting")).to_numpy() // 2
            places = np.frombuffer(b"".join(batch.column("posting").to_pylist()), "<u2").astype(np.int64)
            heads = np.cumsum(sizes) - sizes
            chunks, codes = np.unique(batch.column("chunk").to_numpy(), return_inverse=True)
            widths = np.zeros(len(chunks), np.int64)
            widths[codes] = places[heads]
            base = np.cumsum(widths) - widths
            slots = np.repeat(base[codes], sizes - 1) + np.delete(places, heads)
            total = np.stack([np.bincount(slots, np.repeat(x, sizes - 1), widths.sum()) for x in found(batch)])
            for chunk, start, width in zip(chunks.tolist(), base, widths, strict=True):
                part = total[:, start : start + width]
                if chunk in held:
                    held[chunk] += part
                else:
                    held[chunk] = part.copy()
            if sum(x.size for x in held.values()) > 4_000_000:
                yield from flush()
        yield from flush()

    own = ["n_bytes", "n_terms", *([carry] if carry else [])]
    result = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in own), *(f"{c} double" for c in columns)])

    def finish(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        about = np.frombuffer(next(x["about"] for x in parts if x["about"] is not None), np.int64).reshape(2 + len(own), -1)
        sums = np.zeros((len(columns), about.shape[1]))
        for row in parts:
            if row["places"]:
                places = np.frombuffer(row["places"], "<u2")
                sums[:, places] += np.frombuffer(row["sums"]).reshape(len(columns), -1)
        ids = pa.array(about[1], mask=about[0] == 0)
        return pa.table([ids, *map(pa.array, about[2:]), *map(pa.array, sums)], names=["doc_id", *own, *columns])

    return rows.mapInArrow(add, partial).groupBy("chunk").applyInArrow(finish, result)
