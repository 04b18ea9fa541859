"""Repeated byte strings by distributed prefix doubling over sampled positions.

A byte is removed if some string of ``LENGTH`` bytes that covers it starts anywhere else as well. Ranking
the suffixes of all bytes would sort every byte of the corpus in every round, so the rounds run over
anchors: for each start p of such a string, the anchor is the position of the least hash of ``GRAM`` bytes
among the first ``REACH`` positions from p. Equal strings have their anchor in the same place, the two
anchors that follow it too, and an anchor serves a run of starts.

1. The text from an anchor to the next is its first rank. Spark counts the ranks; anchors whose rank is
   unique drop out, as prefix doubling drops unique suffixes.
2. Doubling: each anchor left pairs its rank with that of the anchor one step on (none left there: it is
   unique), and pairs are ranked and counted anew. Further steps would reach past the ``LENGTH`` bytes.
3. Anchors with the same rank and the same bytes around all their starts are repeated as a whole. Where a
   rank holds different surroundings, the strings of their starts are compared by 64-bit hashes, for each
   distance from the anchor.

Rows know their document by a 64-bit hash of its id and text, whichever way later jobs cut the scan. Equal
rows share the hash and are copies of each other, so what is found for one holds for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.bytebpe import ranges
from plantpulse.llm.shared import groups_of_texts, written

LENGTH = 400
GRAM = 16
#: Anchors are at most REACH apart; LENGTH - 3 * REACH >= GRAM keeps two steps inside every string.
REACH = 128
GROUP_BYTES = 2 << 20
#: Different surroundings of one rank that are compared in one task.
CROWD = 20_000

_RNG = np.random.default_rng(11)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (value ^ (value >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


class Hashes:
    """Hashes of any substrings of some bytes, equal for equal substrings."""

    def __init__(self, data: bytes):
        codes = _BYTES[np.frombuffer(data, np.uint8)]
        self.size = len(codes)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(self.size + 1, _BASE, np.uint64))
            self.back = np.cumprod(np.full(self.size + 1, pow(_BASE, -1, 1 << 64), np.uint64))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def anchors(hashes: Hashes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, first and last start that it serves (none: last < first), and next anchor, of texts that end at ``ends``.

    An anchor has a place here if two more follow it in its text.
    """
    n = hashes.size
    none = (np.zeros(0, np.int64),) * 4
    if n < LENGTH:
        return none
    at = np.arange(n - GRAM + 1)
    key = (hashes.of(at, at + GRAM) >> np.uint64(32) << np.uint64(31)).astype(np.int64) | at  # ties: the first
    pad = -len(key) % REACH
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.int64).max)]).reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(key) - REACH + 1
    least = np.minimum(behind[:count], ahead[REACH - 1 : REACH - 1 + count]) & ((1 << 31) - 1)
    left = np.repeat(ends, np.diff(ends, prepend=0))[:count] - np.arange(count)  # bytes to the text's end
    start = np.flatnonzero(left >= REACH + GRAM - 1)
    if not len(start):  # short texts only
        return none
    least, left = least[start], left[start]
    text = np.searchsorted(ends, start, "right")
    new = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    anchor, owner, first = least[new], text[new], start[new]
    last = np.append(start[new[1:] - 1], start[-1])
    last = np.minimum(last, ends[owner] - LENGTH)
    follows = np.append(owner[1:] == owner[:-1], False)
    inner = np.flatnonzero(follows)
    return anchor[inner], first[inner], last[inner], anchor[inner + 1]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with rid, a hash of the row's content: a place in the scan would change with the scan's splits."""
    return docs.withColumn("rid", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def first_ranks(docs: DataFrame) -> DataFrame:
    """rid, at, step, before, after, rank and around of every anchor of ``docs`` (rid, text).

    Its starts are at - before to at - after (before < after: none); step leads to the next anchor. rank is
    that of the bytes in between; around, of all bytes of its starts' strings.
    """
    kinds = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("step", pa.int16()), ("before", pa.int16()), ("after", pa.int16()), ("rank", pa.int64()), ("around", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_texts(batches, "text", GROUP_BYTES):
            rids = batch.column("rid").to_numpy()
            for texts, own in _small([(x.as_py() or "").encode() for x in batch.column("text")]):
                ends = np.cumsum([len(x) for x in texts])
                hashes = Hashes(b"".join(texts))
                anchor, first, last, then = anchors(hashes, ends)
                owner = np.searchsorted(ends, anchor, "right")
                begin = np.concatenate([[0], ends])[owner]
                served = last >= first
                last = np.where(served, last, first - 1)
                around = hashes.of(first, np.where(served, last + LENGTH, first)) ^ mixed((anchor - first).astype(np.uint64))
                columns = [rids[own][owner], anchor - begin, then - anchor, anchor - first, anchor - last, hashes.of(anchor, then).view(np.int64), around.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, safe=False) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.select("rid", "text").mapInArrow(run, "rid bigint, at bigint, step smallint, before smallint, after smallint, rank bigint, around bigint")


def _small(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts in groups of about GROUP_BYTES; a longer text is a group of its own."""
    held, own, size = [], [], 0
    for place, text in enumerate(texts):
        if held and size + len(text) > GROUP_BYTES:
            yield held, np.array(own)
            held, own, size = [], [], 0
        held, own, size = [*held, text], [*own, place], size + len(text)
    if held:
        yield held, np.array(own)


def repeated(docs: DataFrame) -> DataFrame:
    """rid, first and last: ranges of starts whose strings of LENGTH bytes start elsewhere too; ``docs``: rid, text."""
    ranked = first_ranks(docs)
    common = ranked.groupBy("rank").count().where("count > 1").select("rank")
    left = written(ranked.join(common, "rank"), "suffix-ranks")
    onward = left.select("rid", F.col("at").alias("next_at"), F.col("rank").alias("next_rank"))
    paired = left.where("before >= after").withColumn("next_at", F.col("at") + F.col("step")).join(onward.distinct(), ["rid", "next_at"])
    paired = paired.withColumn("rank", F.xxhash64("rank", "next_rank"))  # a pair's new rank
    paired = written(paired.select("rid", "at", "before", "after", "rank", "around"), "suffix-pairs")
    place = F.struct("rid", "at")
    kinds = paired.groupBy("rank", "around").agg(F.count("*").alias("same"), F.min(place).alias("one"))
    groups = kinds.groupBy("rank").agg(F.count("*").alias("kinds"), F.sum("same").alias("all")).where("all > 1")
    told = written(kinds.join(groups, "rank").select("rank", "around", "same", "one", "kinds"), "suffix-groups")
    known = paired.join(told, ["rank", "around"])
    whole = known.where("same > 1").select("rid", (F.col("at") - F.col("before")).alias("first"), (F.col("at") - F.col("after")).alias("last"))
    unsettled = known.where((F.col("kinds") > 1) & ((F.col("same") == 1) | (F.col("one") == place)))
    asked = unsettled.select("rid", "at", "before", "after", "rank", F.ceil(F.col("kinds") / CROWD).cast("int").alias("parts"))
    return whole.union(compared(docs, asked))


def compared(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """rid, first, last of the starts of ``asked`` anchors whose strings are equal to another's of their rank."""
    lists = asked.groupBy("rid").agg(F.collect_set(F.struct("at", "before", "after", "rank", "parts")).alias("asked"))
    kinds = pa.schema([("rank", pa.int64()), ("part", pa.int32()), ("rid", pa.int64()), ("at", pa.int64()), ("after", pa.int16()), ("back", pa.binary()), ("hashes", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_texts(batches, "text", GROUP_BYTES):
            rows: list[tuple] = []
            for rid, text, some in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("asked"), strict=True):
                at, before, after, rank, parts = (some.values.field(i).to_numpy().astype(np.int64) for i in range(5))
                hashes = Hashes(text.encode())
                sizes = before - after + 1
                back = ranges(after, sizes)
                start = np.repeat(at, sizes) - back
                found = hashes.of(start, start + LENGTH)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                for i in range(len(at)):
                    own, hash_ = back[bounds[i] : bounds[i + 1]].astype(np.uint8), found[bounds[i] : bounds[i + 1]]
                    for part in range(parts[i]):  # equal strings have equal hashes and so the same part
                        here = slice(None) if parts[i] == 1 else hash_ % np.uint64(parts[i]) == part
                        backs = None if parts[i] == 1 else own[here].tobytes()  # else they go on from ``after``
                        rows.append((int(rank[i]), part, rid, int(at[i]), int(after[i]), backs, hash_[here].tobytes()))
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    # with all columns of ``docs``: find_repeats() joins the same rows by rid, so that texts are shuffled once for both
    dealt = docs.join(lists, "rid").mapInArrow(hashed, "rank bigint, part int, rid bigint, at bigint, after smallint, back binary, hashes binary")
    dealt = dealt.repartition("rank", "part").sortWithinPartitions("rank", "part")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) < 32 << 20:
                continue
            rows = pa.Table.from_batches(held)
            group = _groups(rows)
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if last:
                yield from _equal(rows.slice(0, last), group[:last])
            held = rows.slice(last).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield from _equal(rows, _groups(rows))

    return dealt.mapInArrow(matched, "rid bigint, first bigint, last bigint")


def _groups(rows: pa.Table) -> np.ndarray:
    rank, part = rows.column("rank").to_numpy(), rows.column("part").to_numpy()
    return np.cumsum(np.concatenate([[0], (rank[1:] != rank[:-1]) | (part[1:] != part[:-1])]))


def _equal(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = rows.column("hashes").to_pylist()
    hashes = np.frombuffer(b"".join(lists), np.uint64)
    sizes = np.array([len(x) // 8 for x in lists])
    back = ranges(rows.column("after").to_numpy().astype(np.int64), sizes)
    if rows.column("back").null_count < rows.num_rows:
        for i, (end, given) in enumerate(zip(np.cumsum(sizes), rows.column("back").to_pylist(), strict=True)):
            if given is not None:
                back[end - sizes[i] : end] = np.frombuffer(given, np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = group[row] << 8 | back
    order = np.lexsort((hashes, place))
    same = (place[order][1:] == place[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order] = np.append(same, False) | np.insert(same, 0, False)
    starts = (rows.column("at").to_numpy()[row] - back)[twice]
    rid = rows.column("rid").to_numpy()[row][twice]
    by = np.lexsort((starts, rid))
    starts, rid = starts[by], rid[by]
    new = np.concatenate([[True], (np.diff(rid) != 0) | (np.diff(starts) > 1)]) if len(rid) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid)) - 1 if len(rid) else first
    yield pa.RecordBatch.from_arrays([pa.array(rid[first]), pa.array(starts[first]), pa.array(starts[last])], names=["rid", "first", "last"])


def find_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id and text; null: empty) with rid and spans: merged byte ranges [start, stop) to remove, in order.

    Strings are judged on the input, not on what is left. Equal rows are copies of each other like any others.
    """
    rows = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    spans = repeated(rows).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct(F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")))).alias("found"))
    return rows.join(spans, "rid", "left")


def merged(found: pa.Scalar) -> list[tuple[int, int]]:
    """Ranges sorted by their starts, put together where they touch or overlap."""
    if not found.is_valid:
        return []
    start, stop = (found.values.field(i).to_numpy() for i in (0, 1))
    until = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > until[:-1]]))
    return list(zip(start[new].tolist(), until[np.append(new[1:], len(start)) - 1].tolist(), strict=True))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeats (n_removed > 0) of every row; see find_repeats()."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
                data, at, sha = text.as_py().encode(), 0, hashlib.sha256()
                spans = merged(found)
                for start, stop in spans:
                    sha.update(data[at:start])
                    at = stop
                sha.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), sha.hexdigest()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(kinds)[1:], strict=True)] if rows else [pa.nulls(0, f.type) for f in list(kinds)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=kinds)

    found = find_repeats(docs).select("doc_id", "text", "found")
    return found.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumn(
        "repeats", F.col("n_removed") > 0
    )
