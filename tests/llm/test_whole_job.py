"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from plantpulse.llm import minhash, ppm, simhash, suffixes
from plantpulse.llm.bytebpe import Encoder
from plantpulse.llm.shared import written

RNG = np.random.default_rng(8)
WORDS = ["".join(RNG.choice(list("abcdefgh"), int(n))) for n in RNG.integers(2, 9, 2_000)]


def prose(n: int) -> list[str]:
    return RNG.choice(WORDS, n).tolist()


def test_many_short_texts_have_no_repeats(spark):
    texts = [" ".join(prose(30))[:100] for _ in range(4)]
    ends = np.cumsum([len(x) for x in texts])
    assert ends[-1] == suffixes.LENGTH
    assert [len(x) for x in suffixes.anchors(suffixes.Hashes("".join(texts).encode()), ends)] == [0, 0, 0, 0]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts * 5)], "doc_id bigint, text string").coalesce(1)
    got = suffixes.without_repeats(docs).collect()
    assert len(got) == 20 and not any(r.n_removed for r in got)


def test_repeats_hold_when_later_jobs_split_the_scan_otherwise(spark, tmp_path):
    passage = " ".join(prose(120))
    texts = [" ".join(prose(60)) + (f" {passage} " if i % 3 == 0 else " ") + " ".join(prose(60)) for i in range(30)]
    path = str(tmp_path / "documents.parquet")
    rows = [(i, x) for i, x in enumerate(texts)] + [(3, texts[3]), (1, texts[1]), (None, texts[2]), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12).write.parquet(path)
    docs = spark.read.parquet(path)
    answer = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        want = answer(suffixes.without_repeats(docs))
        later = suffixes.without_repeats(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert answer(later) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = {1, 2, 3, None}  # rows with a copy
    for doc_id, n_bytes, n_removed, *_ in want:
        assert n_removed == n_bytes if doc_id in whole else (n_removed >= len(passage)) == (doc_id % 3 == 0)


def brute_jaccard(texts):
    sets = []
    for text in texts:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if both >= 0.8 * either:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_copy_stage_equals_brute_force_jaccard(spark, monkeypatch):
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for n in (40, 120, 400):
        for _ in range(6):
            words = prose(n)
            texts.append(" ".join(words))
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):
                copy = list(words)
                for at in RNG.choice(n, max(1, int(n * share)), replace=False):
                    copy[at] = "changed"
                texts.append(" ".join(copy))
    words = prose(150)
    for _ in range(40):  # a group of near copies that is cut, and a chain
        copy = list(words)
        copy[int(RNG.integers(150))] = "other"
        texts.append(" ".join(copy))
        words[int(RNG.integers(150))] = "moved"
        texts.append(" ".join(words))
    monkeypatch.setattr(minhash, "SHARD", 15)
    docs = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(texts)] + [(7, texts[7], 1), (None, texts[8], 1)], "doc_id bigint, text string, size int")
    kept = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    want = sorted(set(brute_jaccard(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(texts) / 2
    assert corpus_pipeline.one_of_near_copies(spark, docs.where("false"), "").count() == 0


def test_common_units_are_encoded_once_by_all_tasks_of_a_worker():
    from plantpulse.llm.bytebpe import shared_encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert shared_encoder(path) is shared_encoder(path)
    encoder, given = Encoder(path, most=300), []
    library = encoder.bpe.ids
    encoder.bpe.ids = lambda units: given.extend(units) or library(units)
    whole = Encoder(path)
    for group in range(12):  # the table of 300 units is thinned many times
        texts = ["common words stay\nin the table", " ".join(WORDS[group * 150 : group * 150 + 150])]
        got, want = encoder.encode(texts), whole.encode(texts)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True)) and len(encoder.known) <= 600
        assert got[0].tolist() == [x for t in texts for x in encoder.bpe.library.encode(t, add_special_tokens=False).ids]
    assert given.count(" words") == given.count("\nin") == 1


def test_grams_of_a_slice_take_little_memory():
    import tracemalloc

    texts = pa.RecordBatch.from_pydict({"text": [" ".join(prose(2_000)) for _ in range(700)]})
    assert texts.nbytes > 7 << 20
    tracemalloc.start()
    try:
        sizes = [sum(ppm.grams(some)[1]) for some, _ in ppm._slices(texts)]
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()
    assert sum(sizes) == sum(len(x) + 1 for x in texts.column("text").to_pylist())


def test_texts_are_shuffled_once_for_comparison_and_removal(spark, tmp_path):
    passage = " ".join(prose(200))
    texts = [" ".join(prose(40)) + " " + passage[i : i + 900] + " " + " ".join(prose(40)) for i in range(20)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = suffixes.without_repeats(spark.read.parquet(path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert all(r.n_removed for r in got.collect())
        final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange [doc_id" in final, plan


def test_operator_3_proposes_near_copies_beside_the_bands(spark):
    texts = []
    for _ in range(5):
        words = prose(1_000)
        texts.append(" ".join(words))
        words[500] = "changed"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("h", F.xxhash64("doc_id", "text"))
    near = {i: r.component_id for i, r in enumerate(sorted(simhash.near_copies(docs).collect()))}
    assert len(set(near.values())) < 10
    rows = written(minhash.sketches(docs.select("doc_id", "h", "text")), "test-sketches")
    ids = {r.set_id: r.doc_id for r in rows.collect()}
    no_bands = rows.withColumn("bands", F.array().cast("array<bigint>"))
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in minhash.links(no_bands, docs).collect()}
    assert found == {(own, i) for i, own in near.items() if own != i}


def test_near_copies_that_no_band_proposes_are_linked(spark, monkeypatch):
    """The prefix filter alone finds every pair: bands and operator 3, which may miss some, propose nothing here."""
    texts = ["", " ", "one two", "one two", "a b c d e", "a b c d f"]
    for n in (5, 9, 14, 30, 60, 200):
        words = prose(n)
        for share in (0, 0.01, 0.02, 0.03, 0.05):
            copy = list(words)
            for at in RNG.choice(n, max(1, int(n * share)), replace=False):
                copy[at] = "changed"
            texts += [" ".join(copy), "a line that all of them have in common " + " ".join(copy), " ".join(copy[: n - n // 9])]
    links = minhash.links
    monkeypatch.setattr(minhash, "links", lambda rows, docs: links(rows, docs).where("false"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(set(brute_jaccard(texts)))
    assert sorted(r.doc_id for r in minhash.one_of_each(docs).collect()) == want and len(want) < len(set(texts)) - 10
