"""Ranked lexical search by dense matrix tiles: item vocabulary tiles times document impact tiles.

A first pass over the documents counts the terms that some item has; the counts of a document are its row
of a table in the shared folder, and document frequencies come from that table. A second pass multiplies
tiles: ``ITEMS`` items by ``TERMS`` terms of their own compact vocabulary (weight times repeats) with
``TERMS`` terms by ``DOCS`` documents (impacts), as float64. Weights are cut at ``LARGEST`` and the rest
goes to a further product, so every partial sum is a whole number below 2^53 and exact; products are added
up as 64-bit integers. The best k of a tile are chosen with all ties of the k-th score, then by id.

Items come in blocks of about ``BLOCK_TERMS`` terms. A block is the only thing broadcast; its result is
written before the next block is fetched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plantpulse.llm.decontaminate import FOLD
from plantpulse.llm.shared import groups_of_texts, written

#: Items, terms and documents of a tile; the largest weight in a tile; an impact is below IMPACT.
ITEMS = 256
TERMS = 2048
DOCS = 1024
IMPACT = 10**6
LARGEST = 2**53 // (TERMS * IMPACT)
#: Terms of a block of items (repeats counted), bytes of text in a group of documents, bytes cut to words at once.
BLOCK_TERMS = 500_000
GROUP_BYTES = 4 << 20
CUT_BYTES = 1 << 20


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased, in lists of about CUT_BYTES."""
    data = (text or "").encode().translate(FOLD)
    low = 0
    while low < len(data):
        high = data.find(b" ", low + CUT_BYTES)
        high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def block_of(items: list[tuple]) -> SimpleNamespace:
    """Items (id, text) as numbers of their vocabulary: one entry per item and different term, items in order."""
    vocabulary: dict[bytes, int] = {}
    item, code, times = [], [], []
    for row, (_, text) in enumerate(items):
        for term, n in Counter(t for some in terms_of(text) for t in some).items():
            item.append(row)
            code.append(vocabulary.setdefault(term, len(vocabulary)))
            times.append(n)
    entry = [np.array(x, np.int64) for x in (item, code, times)]
    return SimpleNamespace(ids=[x[0] for x in items], vocabulary=vocabulary, item=entry[0], code=entry[1], times=entry[2])


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), codes (those in ``vocabulary``) and tfs (their counts); documents without terms go."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in groups_of_texts(batches, "text", GROUP_BYTES):
            n, keys, counts = [], [], []
            for row, text in enumerate(batch.column("text")):
                numbers = [np.fromiter(map(get, terms, repeat(-1)), np.int64, len(terms)) for terms in terms_of(text.as_py())]
                numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
                n.append(len(numbers))
                found, times = np.unique(numbers[numbers >= 0], return_counts=True)
                keys.append(found | row << 32)
                counts.append(times)
            keys, counts, n = np.concatenate(keys), np.concatenate(counts), np.array(n, np.int64)
            offsets = pa.array(np.searchsorted(keys >> 32, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys & 0xFFFFFFFF, counts)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "codes", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, codes array<int>, tfs array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n docs) div terms; the latter in unbounded integers."""
    sizes, place = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * x * docs // terms for x in sizes.tolist()], np.int64)[place]
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def tiles(block: SimpleNamespace, values: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ITEMS items from ``first`` on: codes and the dense weights (items by codes), each at most LARGEST."""
    low, high = np.searchsorted(block.item, [first, first + ITEMS])
    item, code, value = block.item[low:high] - first, block.code[low:high], values[low:high].copy()
    while len(value):
        codes, column = np.unique(code, return_inverse=True)
        for start in range(0, len(codes), TERMS):
            some = (column >= start) & (column < start + TERMS)
            dense = np.zeros((ITEMS, min(TERMS, len(codes) - start)))
            dense[item[some], column[some] - start] = np.minimum(value[some], LARGEST)
            yield codes[start : start + TERMS], dense
        rest = value > LARGEST
        item, code, value = item[rest], code[rest], value[rest] - LARGEST


def best_of(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best positive scores, ties by ascending id and a missing id last."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        some = some[scores[some] >= np.partition(scores[some], -k)[-k]]  # with all ties of the k-th
    some = some[np.lexsort((ids[some], null[some], -scores[some]))[:k]]
    return scores[some], ids[some], null[some]


def _search(counts: DataFrame, block: SimpleNamespace, values: np.ndarray, totals: tuple[int, int], k: int, id_type: pa.DataType) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast((block.ids, block.item, block.code, values))
    n_codes = len(block.vocabulary)
    kinds = pa.schema([("q", pa.int32()), ("item_id", id_type), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, item, code, weights = shared.value
        items = SimpleNamespace(item=item, code=code)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(names)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            codes, tfs = batch.column("codes"), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            sizes = codes.value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(ids)), sizes)
            impact = impacts(tfs, np.repeat(batch.column("n").to_numpy(), sizes), *totals).astype(float)
            codes = codes.flatten().to_numpy()
            cut = np.searchsorted(doc, np.arange(0, len(ids) + DOCS, DOCS))
            for first in range(0, len(names), ITEMS):
                scores = np.zeros((ITEMS, len(ids)), np.int64)
                for own, dense in tiles(items, weights, first):
                    column = np.full(n_codes, -1)
                    column[own] = np.arange(len(own))
                    for number, (low, high) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        place, base = column[codes[low:high]], number * DOCS
                        some = np.flatnonzero(place >= 0)
                        right = np.zeros((len(own), min(DOCS, len(ids) - base)))
                        right[place[some], doc[low:high][some] - base] = impact[low:high][some]
                        scores[:, base : base + DOCS] += (dense @ right).astype(np.int64)
                for q in range(first, min(first + ITEMS, len(names))):
                    found = best_of(scores[q - first], ids, null, k)
                    held[q] = best_of(*(np.concatenate(x) for x in zip(held[q], found, strict=True)), k)
        many = [len(x[0]) for x in held]
        score, ids, null = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in range(3))
        q = np.repeat(np.arange(len(names)), many)
        columns = [q.astype(np.int32), pa.array(names, id_type).take(pa.array(q)), pa.array(ids, mask=null.astype(bool)), score]
        yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=kinds)

    fields = [StructField("q", IntegerType()), StructField("item_id", block.kind), StructField("doc_id", LongType()), StructField("score", LongType())]
    return counts.mapInArrow(run, StructType(fields))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text).

    Returns item_id, rank (from 1), doc_id and score, scores above 0 only, ties by ascending doc_id and a
    missing one last. Weights, impacts and scores are as the query's contract has them. Null and empty texts
    have no terms: such a document counts nowhere, such an item has no rows. Repeated rows of ``docs`` are
    documents of their own; rows of ``items`` equal in id and text are one item, others with the same id are
    items of their own. Other columns are not read. Jobs run while the result is built.
    """
    kind = items.schema["item_id"].dataType
    asked = items.select("item_id", "text").where(F.length("text") > 0).distinct()
    total = asked.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    parts = []
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).orderBy("item_id", "text")
        block = block_of([tuple(x) for x in rows.collect()])
        block.kind = kind
        counts = written(term_counts(docs, block.vocabulary), "lexical-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not len(block.item):
            continue
        df = np.zeros(len(block.vocabulary), np.int64)
        for code, many in counts.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
            df[code] = many
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = _search(counts, block, block.times * weight[block.code], (n_docs, n_terms), k, to_arrow_type(kind))
        parts.append(written(found.withColumn("block", F.lit(number)), "lexical-best"))
    if not parts:
        return docs.sparkSession.createDataFrame([], StructType([StructField("item_id", kind)])).selectExpr(
            "item_id", "CAST(NULL AS INT) AS rank", "CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS BIGINT) AS score"
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
