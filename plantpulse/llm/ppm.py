"""Language-model scores by prediction by partial matching (PPM) over the bytes of the running text.

The model codes a document's bytes, A-Z lower-cased, and then an end symbol. The context of a symbol is the
``ORDER`` bytes before it, white space included; only the document's start cuts it, where start marks stand
in the places of missing bytes. A context that was seen N times, T different symbols with it, gives a symbol
seen n times (n - 1/2) / N and keeps T / 2N for escape (method D). On escape the context loses its first byte,
and the symbols of the longer context are excluded from all counts there. Below the empty context every symbol
left of ``SYMBOLS`` is equally likely.

A symbol's probability depends on it and its context alone, so Spark computes it once per different gram
(context and symbol) of all documents:

1. Documents go to chunks of about ``CHUNK_BYTES``, written once. A chunk asks for its different grams, each
   with its occurrences in training documents.
2. Grams are summed over all chunks. Every shorter context's counts are sums of these, so they are found in the
   same rows: grams of the same last two context bytes go to one task, in blocks that hold whole such groups.
   Contexts of one byte and none have at most 65,536 rows for any input; these alone are sent to all tasks.
3. Chunks get the probabilities of their grams by a join, and add them up along their texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.postings import document_sums, postings
from plantpulse.llm.shared import groups_of_texts, remainder, written

ORDER = 5
CHUNK_BYTES = 64 << 20
#: Bytes of text whose grams are taken at once.
SLICE = 1 << 20
#: Rows of the model that are computed at once; a group of the same last two context bytes is never cut.
BLOCK = 300_000
WORD_CHUNK_BYTES = 16 << 20

#: Bytes that no UTF-8 text holds; the start mark is never a symbol.
START, END = 0xFF, 0xFE
SYMBOLS = 255
GRAM = "gram bigint"  # context bytes, the farthest first, and the symbol


def splitter() -> Callable[[str], list[str]]:
    find = re.compile("[^\x20\x09-\x0d]+").findall
    return lambda text: find(text.encode().lower().decode())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every symbol of all texts, text by text, and how many each text has."""
    data = np.frombuffer(b"".join(bytes([START]) * ORDER + x.lower() + bytes([END]) for x in texts), np.uint8)
    width = len(data) - ORDER
    out = np.zeros(max(width, 0), np.int64)
    for place in range(ORDER + 1 if len(texts) else 0):
        out <<= 8
        out |= data[place : place + width]
    return out[(out & 0xFF) != START], np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    for part in groups_of_texts([batch], "text", SLICE):
        yield [x.as_py().encode() for x in part.column("text")], part


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` (text, never null) with chunk, dealt round robin, so that neither a source nor copies crowd a chunk."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in groups_of_texts(batches, "text", SLICE):
            if held >= CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += batch.column("text").nbytes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, chunk))], names=[*batch.schema.names, "chunk"])

    dealt = docs.repartition(max(1, -(-size // CHUNK_BYTES)))
    return written(dealt.mapInArrow(run, f"{kinds}, chunk bigint"), "ppm-chunks")


def asked_grams(chunks: DataFrame) -> DataFrame:
    """chunk, gram and n (occurrences where ``learns``) of the different grams of every chunk."""
    kinds = pa.schema([("chunk", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])

    def reduced(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        own, keys, counts = -1, empty, empty

        def told() -> Iterator[pa.RecordBatch]:
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), own)), pa.array(keys), pa.array(counts)], schema=kinds)

        for batch in batches:
            chunk_of = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.diff(chunk_of, prepend=-1)).tolist() + [batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if chunk_of[low] != own:
                    yield from told()
                    own, keys, counts = int(chunk_of[low]), empty, empty
                for texts, part in _slices(batch.slice(low, high - low)):
                    found, sizes = grams(texts)
                    marked = np.sort(found << 1 | np.repeat(part.column("learns").to_numpy(zero_copy_only=False), sizes))
                    first = np.flatnonzero(np.diff(marked >> 1, prepend=-1))
                    keys, counts = reduced(np.concatenate([keys, marked[first] >> 1]), np.concatenate([counts, np.add.reduceat(marked & 1, first)]))
        yield from told()

    return written(chunks.select("chunk", "learns", "text").mapInArrow(run, f"chunk bigint, {GRAM}, n bigint"), "ppm-asked")


class Order:
    """Contexts of one length: for sorted ``keys`` (context and symbol) counts, context sums, and ``back``.

    ``back`` is the symbol's probability after an escape from its context here; ``plain``, that in this
    context with nothing excluded.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, lower: Order | None):
        self.keys, self.n = keys, n
        heads = np.flatnonzero(np.diff(keys >> 8, prepend=-1))
        sizes = np.diff(np.append(heads, len(keys)))
        per = lambda x: np.repeat(np.add.reduceat(x, heads), sizes) if len(heads) else x
        self.total, self.kinds = per(n), per((n > 0).astype(np.int64))
        with np.errstate(divide="ignore", invalid="ignore"):
            if lower is None:
                self.back = 1 / (SYMBOLS - self.kinds)
            else:
                at = np.searchsorted(lower.keys, keys & ((1 << 8 * lower.width()) - 1))
                up_n = lower.n[at]
                left = lower.total[at] - per(np.where(n > 0, up_n, 0))
                escape = np.where(left > 0, (lower.kinds[at] - self.kinds) / 2 / left, 1.0)
                self.back = np.where(up_n > 0, (up_n - 0.5) / left, escape * lower.back[at])
            self.depth = 0 if lower is None else lower.depth + 1
            seen = np.where(n > 0, (n - 0.5) / self.total, self.kinds / 2 / self.total * self.back)
            self.plain = np.where(self.total > 0, seen, self.back)

    def width(self) -> int:
        return self.depth + 1


def shortest_orders(counted: DataFrame) -> Order:
    """Contexts of one byte, on those of none: at most 65,536 rows, whatever was counted."""
    rows = counted.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    by = np.argsort(keys)
    return Order(keys[by], n[by], Order(*summed(keys, n, 1), None))


def summed(keys: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different last ``width`` bytes of ``keys`` and their counts."""
    short, into = np.unique(keys & ((1 << 8 * width) - 1), return_inverse=True)
    out = np.zeros(len(short), np.int64)
    np.add.at(out, into, n)
    return short, out


def model(asked: DataFrame) -> DataFrame:
    """gram and logp, log10 of the symbol's probability in its context, for every gram that is asked for."""
    counted = written(asked.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
    low = shortest_orders(counted)

    def solved(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(keys)
        keys, n = keys[by], n[by]
        order = low
        for width in range(3, ORDER + 2):
            order = Order(*(summed(keys, n, width) if width <= ORDER else (keys, n)), order)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(order.plain))], names=["gram", "logp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BLOCK:
                continue
            keys, n = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("gram", "n"))
            pair = keys >> 8 & 0xFFFF
            last = int(np.argmax(pair == pair[-1]))  # the last group may go on
            if last:
                yield solved(keys[:last], n[:last])
            held = [pa.RecordBatch.from_arrays([pa.array(keys[last:]), pa.array(n[last:])], names=["gram", "n"])]
            size = len(keys) - last
        if size:
            yield solved(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("gram", "n")))

    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = counted.withColumn("pair", pair).repartition("pair").sortWithinPartitions("pair").select("gram", "n")
    return written(dealt.mapInArrow(run, f"{GRAM}, logp double"), "ppm-model")


class Lookup:
    """Values of different keys (not negative) by open addressing; every key asked for must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            own = slot[left]
            free = self.keys[own] < 0
            self.keys[own[free]] = keys[left[free]]
            placed = self.keys[own] == keys[left]
            self.values[own[placed]] = values[left[placed]]
            left = left[~placed]
            slot[left] = self._next(slot[left])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out, left = self.values[slot], np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            if (self.keys[slot[left]] < 0).any():
                raise KeyError("a gram without a probability")
            slot[left] = self._next(slot[left])
            out[left] = self.values[slot[left]]
            left = left[self.keys[slot[left]] != keys[left]]
        return out


def text_scores(docs: DataFrame) -> DataFrame:
    """rid and score (log10 of the probability under PPM) of every row of ``docs`` (rid, learns, text)."""
    chunks = chunked(docs)
    asked = asked_grams(chunks)
    known = asked.select("chunk", "gram").join(model(asked), "gram")
    kinds = pa.schema([("rid", pa.int64()), ("score", pa.float64())])

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        logp = Lookup(*(values.column(c).to_numpy() for c in ("gram", "logp")))
        out = []
        for batch in texts.to_batches():  # not combined: that copies a whole chunk
            for some, part in _slices(batch):
                found, sizes = grams(some)
                value = logp.of(found)
                out.append(pa.RecordBatch.from_arrays([part.column("rid"), pa.array(np.add.reduceat(value, np.cumsum(sizes) - sizes))], schema=kinds))
        return pa.Table.from_batches(out, schema=kinds)

    texts = chunks.select("chunk", "rid", "text").groupBy("chunk")
    return written(texts.cogroup(known.groupBy("chunk")).applyInArrow(score, "rid bigint, score double"), "ppm-scores")


def lm_scores(docs: DataFrame, parts: int = 5, held_out: int = 1) -> DataFrame:
    """Scores of every row of ``docs`` by a model of the rows whose crc32(doc_id as text) mod ``parts`` is not ``held_out``.

    doc_id, held_out, n_tokens (words and an end), n_known (tokens met in training), train_tokens,
    base_score (log10 under add-half smoothed token counts) and score (log10 under PPM). A null text is
    empty. A null id counts as the empty text in the crc32. Repeated rows count and are scored each for
    itself; other columns are not read. Without any training row every symbol is equally likely. Both
    scores of a row meet by a 64-bit hash of its id and text.
    """
    learns = lambda doc_id: remainder(doc_id, parts) != held_out
    is_held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % parts == held_out
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", text).alias("rid"))
    ppm = text_scores(texts.select("rid", (~is_held_out).alias("learns"), "text")).groupBy("rid").agg(F.min("score").alias("score"))
    rows = postings(texts, splitter, learns, WORD_CHUNK_BYTES, carry="rid")
    vocabulary = written(rows.where("about is null").groupBy("term").agg(F.sum("counted").alias("c")), "ppm-words")
    ends = docs.where(~is_held_out).count()
    words, distinct = vocabulary.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, distinct + (ends > 0)
    share = lambda count: (count + 0.5) / (total + 0.5 * (distinct + 1))
    values = vocabulary.select("term", F.log10(share(F.col("c"))).alias("base"), (F.col("c") > 0).cast("double").alias("known"))
    joined = rows.select("chunk", "term", "posting", "about").join(values, "term", "left").drop("term")
    columns = ["base", "known"]
    found = lambda: lambda batch: [batch.column(c).to_numpy() for c in columns]
    return document_sums(joined, found, columns, carry="rid").join(ppm, "rid", "left").select(
        "doc_id",
        is_held_out.alias("held_out"),
        (F.col("n_terms") + 1).alias("n_tokens"),
        (F.col("known").cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(share(ends))).alias("base_score"),
        "score",
    )
