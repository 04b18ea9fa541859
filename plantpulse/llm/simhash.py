"""SimHash near copies: fingerprints, shards by agreeing bits, and a BK-tree per shard.

Two fingerprints within ``radius`` bits agree on some ``blocks - radius`` of ``blocks`` cuts of the 64
bits. All fingerprints that agree on one such choice form a shard, so every link lies inside some shard
and no fingerprint meets all others. A shard's distinct fingerprints become a BK-tree: children are
keyed by their Hamming distance to the parent, and a search follows only the edges whose key is within
the radius of the distance measured at the node. Trees are built where their shard is shuffled to, as
nothing bounds the size of all of them together, which a broadcast would need.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plantpulse.llm.components import components
from plantpulse.llm.shared import written

#: Fingerprints of a shard searched in one task; a larger shard is cut, and every two cuts meet.
SHARD = 20_000
#: Fingerprints that should agree by chance at most; above it, more cuts are agreed on.
CROWD = 64


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of a text over its shingles of ``words`` words, repeats included.

    A-Z are lower-cased; words are cut at space and 09-0D. A shingle's hash is XXH64 (seed 42); a bit is
    set if it is set in over half of them. Fewer words: the whole sequence is one shingle; none: 0.
    """
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)), "<u8")
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[low : low + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with a bigint column ``fingerprint`` (the 64 bits, signed) in place of one of that name."""
    kept = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint((x.as_py() or "").encode(), words) for x in batch.column("text")]
            column = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("fingerprint", LongType())]))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """BK-trees of many shards at once: ``values`` sorted by ``shard``, distinct within a shard."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        self.values = values
        first = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        self.root = np.repeat(first, np.diff(np.append(first, len(shard))))
        self.parent = np.full(len(values), -1)
        edge = np.zeros(len(values), np.int64)
        rest = np.flatnonzero(self.root != np.arange(len(values)))
        at = self.root[rest]
        while len(rest):  # one level: of the values with one parent and distance, the first becomes the child
            key = at * 65 + hamming(values[rest], values[at])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.diff(key, prepend=-1) != 0
            child = rest[new]
            self.parent[child], edge[child] = key[new] // 65, key[new] % 65
            at = child[np.cumsum(new) - 1][~new]
            rest = rest[~new]
        inner = np.flatnonzero(self.parent >= 0)
        keys = self.parent[inner] * 65 + edge[inner]
        order = np.argsort(keys)
        self.child, self.keys = inner[order], keys[order]

    def near(self, radius: int, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place, place) of values of one shard within the radius, each searched from both ends."""
        stack = [(np.arange(low, min(low + step, len(self.values))),) * 2 for low in range(0, len(self.values), step)]
        stack = [(q, self.root[q]) for q, _ in stack]
        while stack:
            query, node = stack.pop()
            if len(query) > step:
                stack.append((query[step:], node[step:]))
                query, node = query[:step], node[:step]
            distance = hamming(self.values[query], self.values[node])
            hit = (distance <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
            many = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right") - low
            if total := int(many.sum()):
                at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(total)
                stack.append((np.repeat(query, many), self.child[at]))


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places the smallest label among them, in place."""
    while True:
        low = np.minimum(label[a], label[b])
        moved = (label[a] != low) | (label[b] != low)
        if not moved.any():
            return
        a, b, low = a[moved], b[moved], low[moved]
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label[:] = label[label]


def links(distinct: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between different fingerprints that span exactly the components of "within the radius".

    ``distinct`` has one row per ``fingerprint``. Inside a shard the links found are reduced to a spanning
    star before they leave the task, so thousands of near copies give as many edges, not pairs.
    ``blocks`` (default: by the number of fingerprints) changes the work, never the result.
    """
    if blocks is None:
        count = distinct.count()
        blocks = next((b for b in range(radius + 1, 17) if count >> (64 * (b - radius) // b) <= CROWD), 16)
    cuts = [range(64 * i // blocks, 64 * (i + 1) // blocks) for i in range(blocks)]
    masks = [sum(1 << bit for cut in some for bit in cut) for some in combinations(cuts, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])
    spread = distinct.select("fingerprint", F.explode(choices).alias("s")).select("fingerprint", "s.choice", "s.bits")
    crowded = spread.groupBy("choice", "bits").count().where(F.col("count") > SHARD).withColumn("n", F.ceil(F.col("count") / SHARD)).drop("count")
    place = F.pmod(F.xxhash64("fingerprint", "choice"), F.coalesce("n", F.lit(1)))
    met = F.transform(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1), lambda j: F.least(j, F.col("place")) * 65_536 + F.greatest(j, F.col("place")))
    shards = spread.join(crowded, ["choice", "bits"], "left").withColumn("place", place).select("choice", "bits", F.explode(met).alias("cut"), "fingerprint")
    dealt = shards.repartition("choice", "bits", "cut").sortWithinPartitions("choice", "bits", "cut", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 100_000:
                rows = pa.Table.from_batches(held)
                key = shard_numbers(rows)
                last = int(np.searchsorted(key, key[-1]))  # the last shard may go on
                if last:
                    yield edges(rows.slice(0, last), key[:last])
                held = rows.slice(last).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield edges(rows, shard_numbers(rows))

    def shard_numbers(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for name in ("choice", "bits", "cut"):
            column = rows.column(name).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.cumsum(new)

    def edges(rows: pa.Table, shard: np.ndarray) -> pa.RecordBatch:
        values = rows.column("fingerprint").to_numpy().view(np.uint64)
        label = np.arange(len(values))
        size = np.bincount(shard)[shard] > 1
        inner = np.flatnonzero(size)
        if len(inner):
            forest, part = BKForest(shard[inner], values[inner]), np.arange(len(inner))
            for a, b in forest.near(radius):
                union(part, a, b)
            label[inner] = inner[part]
        moved = np.flatnonzero(label != np.arange(len(values)))
        columns = [pa.array(values[x].view(np.int64)) for x in (moved, label[moved])]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id among all rows linked directly or through others; rows with one
    fingerprint are linked. A null text is empty. A null doc_id is never the smallest; where a component
    has no other, component_id is null. Repeated rows stay repeated; other columns are not read.
    """
    rows = written(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fingerprint"), "fingerprints")
    return rows.join(classes(rows, radius), "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def classes(rows: DataFrame, radius: int) -> DataFrame:
    """fingerprint, root (a fingerprint, one per component) and component_id, one row per fingerprint of ``rows``."""
    distinct = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    named = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(smallest, "root").select("fingerprint", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` without all but one row of each component of near_copies(), with all its columns.

    The row of the smallest doc_id stays, a row without an id only where no other has one; of rows that
    share this id, one of the smallest hash of id and text.
    """
    mark = F.xxhash64("doc_id", "text")
    rows = written(fingerprints(docs.select("doc_id", "text", mark.alias("h")), words).select("doc_id", "h", "fingerprint"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    kept = rows.join(classes(rows, radius), "fingerprint").groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.h").alias("__h"))
    own = docs.withColumn("__own", mark)
    found = own.join(kept, F.expr("doc_id <=> __id and __own = __h"))
    nth = F.row_number().over(Window.partitionBy("__id", "__h").orderBy("text"))
    return found.withColumn("__nth", nth).where("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
