"""Benchmark decontamination: an FM-index per shard of documents, searched backwards for every benchmark window.

A shard is a few MB of whole documents inside one task. Words that no benchmark item has can be in no
match; they cut a document into runs, and runs shorter than the shortest window hold no match either.
The index is built over the rest. Matches are located and merged to spans of words.

The benchmark comes to the tasks in blocks of about ``BLOCK_WORDS`` words. One block is usual; with more,
every block searches all documents in turn within the same tasks, and spans and items add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from plantpulse.llm.bytebpe import ranges
from plantpulse.llm.fmindex import FMIndex
from plantpulse.llm.shared import groups_of_texts

#: Words of a window, words of a block of the benchmark, bytes of text in a shard.
WINDOW = 10
BLOCK_WORDS = 200_000
SHARD_BYTES = 8 << 20

#: Lower-cases A-Z; everything in ASCII that is neither letter nor digit becomes a space.
FOLD = bytes((i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32) for i in range(256))

SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
FOUND = {"n_words": LongType(), "spans": ArrayType(SPAN), "items": ArrayType(StringType())}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows_of(items: list[tuple], size: int) -> SimpleNamespace:
    """The distinct windows of some benchmark items, as numbers of a vocabulary, and the items that have them.

    A plain namespace, as broadcasts pickle classes by name.
    """
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple, set[str]] = {}
    for name, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for at in range(max(1, len(numbers) - size + 1) if numbers else 0):
            owners.setdefault(tuple(numbers[at : at + size]), set()).add("" if name is None else str(name))
    patterns = np.zeros((len(owners), size), np.int32)
    for row, window in enumerate(owners):
        patterns[row, size - len(window) :] = window
    names = sorted(set().union(*owners.values()))
    number = {name: i for i, name in enumerate(names)}
    return SimpleNamespace(
        vocabulary=vocabulary,
        patterns=patterns,
        lengths=np.array([len(w) for w in owners], np.int64),
        names=names,
        items=np.array([number[x] for some in owners.values() for x in some], np.int64),
        many=np.array([len(some) for some in owners.values()], np.int64),
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, spans (merged ranges of word places hit) and items (sorted ids, as text, that occur).

    ``benchmark`` has item_id and text. An item of fewer words than a window is one window; one of none has
    none. Null texts have no words; an item's null id is listed as the empty text; repeated rows of either
    table change nothing for other rows. The three names start with ``prefix``; columns of ``docs`` with
    these names are replaced, others kept.
    """
    size = F.greatest(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    found = [StructField(prefix + name, kind) for name, kind in FOUND.items()]
    out = docs.drop(*[f.name for f in found])
    for block in range(blocks):
        chosen = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        out = _search(out, windows_of([tuple(x) for x in chosen.select("item_id", "text").collect()], window), found, first=block == 0)
    return out


def _search(docs: DataFrame, windows: SimpleNamespace, found: list[StructField], first: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    kept = [f for f in docs.schema.fields if first or f.name not in [x.name for x in found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_texts(batches, "text", SHARD_BYTES):
            before = None if first else [{"spans": s, "items": i} for s, i in zip(*(batch.column(f.name).to_pylist() for f in found[1:]), strict=True)]
            n_words, spans, items = search_shard(batch.column("text"), shared.value, before)
            columns = [
                pa.array(n_words, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[f.name for f in [*kept, *found]])

    return docs.mapInArrow(run, StructType([*kept, *found]))


def search_shard(texts: pa.Array, windows: SimpleNamespace, before: list[dict] | None = None) -> tuple[np.ndarray, list, list]:
    """Number of words, merged spans and sorted items of each text; ``before`` has earlier blocks' spans and items."""
    get, numbers, sizes = windows.vocabulary.get, [], []
    end = np.zeros(1, np.int32)
    for text in texts:
        words = words_of(text.as_py())
        sizes.append(len(words))
        numbers += [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), end]
    sizes = np.array(sizes, np.int64)
    flat = np.concatenate(numbers) if numbers else end
    base = np.cumsum(sizes + 1) - sizes - 1  # each text's first place in ``flat``; a 0 stands behind each text
    place, row = _occurrences(flat, windows)
    length = windows.lengths[row]
    if before is not None:
        old = [(base[i] + s["start"], s["stop"] - s["start"]) for i, x in enumerate(before) for s in x["spans"] or []]
        place = np.concatenate([place, np.array([a for a, _ in old], np.int64)])
        length = np.concatenate([length, np.array([b for _, b in old], np.int64)])
    cover = np.cumsum(np.bincount(place, minlength=len(flat) + 1) - np.bincount(place + length, minlength=len(flat) + 1)) > 0
    edge = np.flatnonzero(np.diff(cover, prepend=False, append=False)).reshape(-1, 2)
    owner = np.searchsorted(base, edge[:, 0], "right") - 1
    spans: list[list] = [[] for _ in sizes]
    for text, (start, stop) in zip(owner.tolist(), (edge - base[owner, None]).tolist(), strict=True):
        spans[text].append({"start": start, "stop": stop})
    items = [set(x["items"] or []) for x in before] if before is not None else [set() for _ in sizes]
    where = np.searchsorted(base, place[: len(row)], "right") - 1
    pairs = np.unique(where * max(1, len(windows.lengths)) + row)
    where, row = np.divmod(pairs, max(1, len(windows.lengths)))
    starts = np.cumsum(windows.many) - windows.many
    for text, item in zip(np.repeat(where, windows.many[row]).tolist(), windows.items[ranges(starts[row], windows.many[row])].tolist(), strict=True):
        items[text].add(windows.names[item])
    return sizes, spans, [sorted(x) for x in items]


def _occurrences(flat: np.ndarray, windows: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``flat`` and row of every occurrence of a window."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(windows.lengths):
        return none
    bounds = np.flatnonzero(np.diff(flat != 0, prepend=False, append=False)).reshape(-1, 2)
    bounds = bounds[bounds[:, 1] - bounds[:, 0] >= windows.lengths.min()]
    if not len(bounds):
        return none
    sizes = bounds[:, 1] - bounds[:, 0] + 1  # behind each run stands a word of no item, or a text's end: 0
    index = FMIndex(flat[ranges(bounds[:, 0], sizes)], len(windows.vocabulary) + 1)
    row, low, high = index.search(windows.patterns, windows.lengths)
    at = index.locate(ranges(low, high - low))
    starts = np.cumsum(sizes) - sizes
    run = np.searchsorted(starts, at, "right") - 1
    return bounds[run, 0] + at - starts[run], np.repeat(row, high - low)


def leak_counts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the comma-joined items) and contaminated of every row."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return find_leaks(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, unchanged."""
    return find_leaks(docs, benchmark, prefix="__leak_").where(F.size("__leak_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(docs: DataFrame) -> DataFrame:
    """Documents of find_leaks() with the words of all spans, and what stands between them, cut out of ``text``."""
    at = [f.name for f in docs.schema.fields].index("text")

    def cut(text: str, spans: list[dict]) -> str:
        data = text.encode()
        folded, place, out, kept = data.translate(FOLD), 0, [], 0
        begins, ends = [], []
        for piece in folded.split():
            place = folded.index(piece, place)
            begins.append(place)
            place += len(piece)
            ends.append(place)
        for span in spans:
            out.append(data[kept : begins[span["start"]]])
            kept = ends[span["stop"] - 1]
        return b"".join([*out, data[kept:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
