"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax.

Besides its words, a text has mark words: one wherever a word equals that 1, 2, up to 4, 8 or 16 words
before it, so that repetition can be learned whatever the word. A word's vector is the mean of the vectors of its own bucket and of the buckets of its character n-grams
(with < and > around the word); a document's vector is the mean over its words, repeats included. The
vectors and the softmax are learned together by stochastic gradient descent in numpy, in one task, over a
sample of labelled rows of at most ``SAMPLE``. Scoring needs one number per bucket (its vector's product
with the difference of the two classes' weights), so that a word is scored once per task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plantpulse.llm.bytebpe import ranges
from plantpulse.llm.shared import groups_of_texts

#: Bound on the labelled rows that the classifier is fitted on; the smallest hashes of their ids are taken.
SAMPLE = 8_000
BUCKETS = 1 << 17
WIDTH = 12
GRAMS = (3, 4, 5)
EPOCHS = 5
RATE = 0.05
#: Bytes of text scored at once; the n-grams of its words take some fifty times as much.
GROUP_BYTES = 1 << 20


#: Mark words, and the distances at which they stand for equal words.
MARKS = {"\x021": (1,), "\x022": (2,), "\x024": (3, 4), "\x028": (5, 6, 7, 8), "\x0216": tuple(range(9, 17))}


def words_of(text: str) -> list[str]:
    return text.lower().split()


def marks(codes: np.ndarray) -> list[int]:
    """How often each mark word stands in a text of these numbered words."""
    return [sum(int((codes[d:] == codes[:-d]).sum()) for d in distances) for distances in MARKS.values()]


def counted(texts: list[str], known: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its numbered words, mark words included, and how often each stands there; ``known`` numbers words."""
    own = np.array([known[m] for m in MARKS])
    out = []
    for text in texts:
        words = words_of(text)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        met = np.array(marks(codes))
        out.append((np.concatenate([codes, own[met > 0]]), np.concatenate([np.ones(len(codes), np.int64), met[met > 0]])))
    return out


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their n-grams one word after another, and the number of buckets of each word."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from here to the word's end
    spread, owners = [], []
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=1)) + 1, base | np.uint64(1), np.uint64))
        place = np.repeat(sizes, sizes) - left
        whole = np.add.reduceat((codes + np.uint64(7)) * powers[place], ends - sizes) if len(words) else codes
        spread.append(whole * base)
        owners.append(np.arange(len(words)))
        for n in GRAMS:
            start = np.flatnonzero(left >= n)
            value = np.full(len(start), n, np.uint64)
            for k in range(n):
                value = (value ^ (codes[start + k] + np.uint64(k))) * base
                value ^= value >> np.uint64(29)
            spread.append(value * base)
            owners.append(owner[start])
    ids = (np.concatenate(spread) >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(np.concatenate(owners), kind="stable")
    return ids[order], np.bincount(np.concatenate(owners), minlength=len(words))


def features(texts: list[str], buckets: int = BUCKETS, at_once: int = 200) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets that it has and their weights, which sum to 1 (no words: none).

    The words of ``at_once`` texts are taken apart together.
    """
    for low in range(0, len(texts), at_once):
        known: dict[str, int] = defaultdict()
        known.default_factory = known.__len__
        numbered = counted(texts[low : low + at_once], known)
        known.default_factory = None  # else the table, which it refers to, waits for the cycle collector
        ids, sizes = subwords(list(known), buckets)
        ends = np.cumsum(sizes)
        for places, times in numbered:
            if not len(places):
                yield np.zeros(0, np.int32), np.zeros(0, np.float32)
                continue
            words, back = np.unique(places, return_inverse=True)
            counts = np.bincount(back, times)
            own = ids[ranges(ends[words] - sizes[words], sizes[words])]
            weight = np.repeat(counts / counts.sum() / sizes[words], sizes[words])
            met, back = np.unique(own, return_inverse=True)
            yield met.astype(np.int32), np.bincount(back, weight).astype(np.float32)


#: Buckets are kept as their lower 16 bits; a text's buckets ascend, so the places where the upper bits grow are enough.
HALF = 1 << 16


#: Entries of a part: 64 MB, which the allocator keeps apart from what comes and goes between two texts.
PART = 1 << 25


class Sample:
    """The features of the sampled texts, packed: 16 bits a bucket and 16 bits a weight."""

    def __init__(self, texts: list[str], buckets: int):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.places = np.zeros((len(texts), 3), np.int64)  # part, first entry, one behind the last
        steps = np.arange(HALF, max(buckets, HALF + 1), HALF)
        self.cuts = np.zeros((len(texts), len(steps)), np.int64)
        end = PART
        for i, (ids, weights) in enumerate(features(texts, buckets)):
            if end + len(ids) > PART:
                size = max(PART, len(ids))
                self.parts.append((np.empty(size, np.uint16), np.empty(size, np.float16)))
                end = 0
            self.places[i] = len(self.parts) - 1, end, end + len(ids)
            self.cuts[i] = np.searchsorted(ids, steps)
            for part, values in zip(self.parts[-1], (ids.astype(np.uint16), weights), strict=True):
                part[end : end + len(ids)] = values
            end += len(ids)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of text ``i`` and their weights."""
        part, low, high = self.places[i]
        ids = self.parts[part][0][low:high].astype(np.int32)
        for cut in self.cuts[i]:
            ids[cut:] += HALF
        return ids, self.parts[part][1][low:high].astype(np.float32)


def train(texts: list[str], labels: list[int], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """One number per bucket, and the offset at the end; their weighted sum is the log odds of label 1."""
    rng = np.random.default_rng(7)
    vectors = ((rng.random((buckets, width), np.float32) - 0.5) / width).astype(np.float32)
    weights, bias = np.zeros((2, width), np.float32), np.zeros(2, np.float32)
    seen_v, seen_w, seen_b = np.full((buckets, 1), 1e-8, np.float32), np.full((2, width), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    sample, target = Sample(texts, buckets), np.array(labels)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(target)):
            ids, share = sample.row(i)
            hidden = share @ vectors[ids]
            logits = weights @ hidden + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[target[i]] -= 1
            back = error @ weights
            change = np.outer(error, hidden)
            seen_w += change**2
            seen_b += error**2
            weights -= step * change / np.sqrt(seen_w)
            bias -= step * error / np.sqrt(seen_b)
            if len(ids):
                seen_v[ids, 0] += share**2 * (back**2).mean()
                vectors[ids] -= (step * share / np.sqrt(seen_v[ids, 0]))[:, None] * back
    return np.append(vectors @ (weights[1] - weights[0]), bias[1] - bias[0]).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The trained numbers of train(), from rows of ``docs`` (doc_id, text) with a label (doc_id, quality).

    Rows whose crc32(doc_id as text) mod 3 is 1, and rows without an id or a label, are never learned from.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        "doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 3 != 1"
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    one = texts.orderBy(F.xxhash64("doc_id"), "quality", "text").limit(2 * sample).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for batch in batches for x in batch.select(["text", "quality"]).to_pylist()]
        model = train([x["text"] or "" for x in rows], [x["quality"] for x in rows])
        yield pa.RecordBatch.from_pydict({"model": [model.tobytes()]})

    model = one.mapInArrow(run, "model binary").first()
    return np.frombuffer(model["model"]) if model else np.zeros(BUCKETS + 1)


def score(docs: DataFrame, model: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in a double column in place of any of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 doubles
    kept = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in groups_of_texts(batches, "text", GROUP_BYTES):
            known: dict[str, int] = defaultdict()
            known.default_factory = known.__len__
            parts = counted([x.as_py() or "" for x in batch.column("text")], known)
            known.default_factory = None
            sizes = np.array([len(codes) for codes, _ in parts])
            codes, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            texts = np.repeat(np.arange(len(parts)), sizes)
            ids, many = subwords(list(known))
            value = np.add.reduceat(numbers[ids], np.cumsum(many) - many) / many if len(many) else np.zeros(0)
            total, count = (np.bincount(texts, x, len(parts)) for x in (value[codes] * times, times))
            odds = numbers[-1] + total / np.maximum(count, 1)
            result = pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row of ``docs``.

    A null text is empty; an empty one has the score of the offset alone. Without any usable label every
    score is 0.5. held_out: crc32(doc_id as text) mod 3 is 1 (a null id is not). Other columns are not read.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs.select("doc_id", "text"), fit(docs, labels, sample)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
