"""The training-data operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plantpulse.llm import bitpack, decontaminate, fmindex, mixing, ppm, quality, simhash, suffixes, token_counts, topk, warc
from plantpulse.llm.components import components
from plantpulse.llm.shared import remainder, written

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size int, spans string"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdeés"), int(n))) for n in RNG.integers(1, 9, 300)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS, n))


PASSAGE = prose(90)
LONG = prose(9_000)
#: Repeated rows, null and empty texts, a null id, a long text, copies, a shared passage, odd characters.
TEXTS = [
    *[prose(int(n)) for n in RNG.integers(1, 300, 40)],
    f"{prose(40)} {PASSAGE} {prose(40)}", f"{prose(20)}\n{PASSAGE}. {prose(10)}", LONG, LONG, LONG + " tail", "", None, " ", "\n\n  x",
    "a b  c\x1cd <|endoftext|>x  y", "A" * 1500, "a" * 900, "ß🔧 \x00\t tab", prose(200).upper(),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, x, "en", f"src{i % 4}" if i % 7 else None, i, "s", 1, "z") for i, x in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, TEXTS[4], None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lines(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words(text, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_token_counts_equal_the_library(docs, none):
    library = Tokenizer.from_file(BPE)
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts_of(docs)]
    assert lines(token_counts.token_counts(docs, BPE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(none, BPE).count() == 0


def test_packed_ids_equal_the_library_in_order(docs, none):
    library = Tokenizer.from_file(BPE)
    order = sorted(texts_of(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    want, start = [], 0
    for i, t in order:  # rows that share an id are equal here
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert lines(bitpack.packed_round_trip(docs, BPE), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert bitpack.packed_round_trip(none, BPE).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_is_reversible_and_randomly_readable(bits, tmp_path):
    from pyarrow import fs

    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, bits), bits, len(ids)) == ids).all()
    store = fs.LocalFileSystem()
    writer = bitpack.PackedWriter(store.open_output_stream(str(tmp_path / "x")), bits)
    sizes = np.array([0, 1, 5000, 0, 5000])
    for k in range(5):
        low = int(sizes[:k].sum())
        writer.add([k if k else None], ids[low : low + sizes[k]], sizes[k : k + 1])
    writer.close()
    packed = bitpack.PackedFile(store.open_input_file(str(tmp_path / "x")))
    assert packed.has_id.tolist() == [0, 1, 1, 1, 1]
    for a, b in ((0, 1), (4095, 4097), (17, 9000), (10_000, 10_001), (5, 5)):
        assert (packed.ids(a, b) == ids[a:b]).all()


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_copies_equal_brute_force(docs, none):
    rows = texts_of(docs)
    values = [brute_fingerprint(t) for _, t in rows]
    roots = brute_classes(values, 3)
    first = {r: min((i for (i, _), x in zip(rows, roots, strict=True) if x == r and i is not None), default=None) for r in set(roots)}
    want = [(i, format(v, "016x"), first[r]) for (i, _), v, r in zip(rows, values, roots, strict=True)]
    assert lines(simhash.near_copies(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert simhash.near_copies(none).count() == 0 and simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_links_span_all_near_fingerprints(spark, blocks, monkeypatch):
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(20):
            values.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    values = sorted(values)
    monkeypatch.setattr(simhash, "SHARD", 30)  # crowded shards are cut
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint bigint")
    found = {r.node: r.root for r in components(simhash.links(frame, 3, blocks)).collect()}
    got = [found.get(v - (1 << 64) if v >> 63 else v, v - (1 << 64) if v >> 63 else v) for v in values]
    want = brute_classes(values, 3)
    assert Counter(Counter(got).values()) == Counter(Counter(want).values())
    assert len({*zip(got, want, strict=True)}) == len(set(want))


def test_components_of_a_long_path_and_of_no_edges(spark):
    path = spark.createDataFrame([(i + 1, i) for i in range(70)] + [(500, 400), (7, 7)], "a bigint, b bigint")
    assert {r.node: r.root for r in components(path).collect()} == {i: 0 for i in range(71)} | {400: 400, 500: 400}
    assert components(path.where("a > 1000")).count() == 0


def brute_leaks(text, items, size=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, names = words(text, pattern), set(), set()
    for name, item in items:
        v = words(item or "", pattern)
        for at in range(max(1, len(v) - size + 1) if v else 0):
            window = v[at : at + size]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [10_000, 40])
def test_decontamination_equals_brute_force(spark, docs, none, block_words):
    taken = TEXTS[2].split()[:14] if len(TEXTS[2].split()) > 14 else TEXTS[2].split()
    items = [(1, " ".join(PASSAGE.split()[3:30])), (2, PASSAGE.upper()), (10, " ".join(taken)), (None, "tail"), (4, None), (5, "--"), (6, prose(30)), (2, PASSAGE.upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for i, t in texts_of(docs):
        n, hit, names = brute_leaks(t, items)
        want.append((i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
    found = decontaminate.find_leaks(docs, bench, block_words=block_words)
    got = [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if block_words == 10_000:
        assert lines(decontaminate.leak_counts(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
        clean = decontaminate.without_leaks(docs, bench)
        assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
        cut = decontaminate.without_spans(found).select("text").collect()
        assert all(not brute_leaks(r.text or "", items[:3])[1] for r in cut)
    assert decontaminate.leak_counts(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.leak_counts(docs, bench.where("false")).collect()} == {0}


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(25):
        runs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(rng.integers(1, 12))]
        sequence = np.concatenate([np.append(r, 0) for r in [*runs, *runs[:2]]])
        index = fmindex.FMIndex(sequence, 4, sample=3)
        wanted = [rng.integers(1, 4, rng.integers(1, 6)) for _ in range(20)]
        patterns = np.zeros((20, 5), np.int32)
        for i, p in enumerate(wanted):
            patterns[i, 5 - len(p) :] = p
        row, low, high = index.search(patterns, np.array([len(p) for p in wanted]))
        got = {int(r): sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(row, low, high, strict=True)}
        found = {i: [j for j in range(len(sequence) - len(p) + 1) if (sequence[j : j + len(p)] == p).all()] for i, p in enumerate(wanted)}
        assert got == {i: x for i, x in found.items() if x}


def test_mix_comes_to_its_targets(docs, none):
    got = mixing.mixed_words(docs).collect()
    total = sum(r["size"] for r in got)
    rows = docs.select("doc_id", "text", "source").collect()
    own = defaultdict(int)
    for r in rows:
        own[r.source] += len(words(r.text or ""))
    assert total == sum(own.values()) and len(got) == len(rows)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * own[s]}
        target |= {s: 3.0 * own[s] for s in over} if over else share
        left -= sum(3 * own[s] for s in over)
        free = free - over if over else set()
    by_id = {r.doc_id: r.source for r in rows if r.doc_id is not None}
    taken = defaultdict(int)
    for r in got:
        source = by_id.get(r.doc_id)
        assert math.isclose(r.target, target[source], rel_tol=1e-9) and r.source_size == own[source]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for s in order:  # the best that whole copies can do
        reach = {0}
        for size in (len(words(r.text or "")) for r in rows if r.source == s):
            reach = {x + k * size for x in reach for k in range(4)} if size < 5000 and len(reach) < 50_000 else reach | {x + size for x in reach}
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 2 + min(abs(x - target[s]) for x in reach)
    assert lines(mixing.mixed_words(docs), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    repeated = mixing.mixed(docs)
    assert repeated.columns == docs.columns
    assert sum(len(words(r.text or "")) for r in repeated.collect()) == sum(taken.values())
    assert mixing.mixed_words(none).count() == 0 and mixing.mixed(none).count() == 0


def test_tilted_rates_solve_the_dual(spark):
    counts = spark.createDataFrame([(0, s, 1 + s % 3) for s in range(1, 60)] + [(1, 5, 4)], "s int, size bigint, n bigint")
    size = {0: sum(s * (1 + s % 3) for s in range(1, 60)), 1: 20}
    for part in (0.05, 0.9, 2.5):
        targets = spark.createDataFrame([(0, size[0], part * size[0]), (1, size[1], 60.0)], "s int, source_size bigint, target double")
        solved = {r.s: r for r in mixing.balance(counts, targets).collect()}
        assert solved[1].lam is None
        got = sum(s * (1 + s % 3) * min(3, math.exp(solved[0].lam * s / solved[0]["mean"])) for s in range(1, 60))
        assert math.isclose(got, part * size[0], rel_tol=1e-8)


def test_repeated_strings_equal_brute_force(docs, none):
    rows = [(i, t.encode()) for i, t in texts_of(docs)]
    seen = Counter(t[a : a + 400] for _, t in rows for a in range(len(t) - 399))
    want = []
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - 399):
            if seen[t[a : a + 400]] > 1:
                gone[a : a + 400] = b"\x01" * 400
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert lines(suffixes.without_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert any(w[2] for w in want) and suffixes.without_repeats(none).count() == 0


def ppm_logs(rows, order=ppm.ORDER):
    """log10 probability of each text under method D with exclusion, contexts cut by the text's start alone."""
    trie = defaultdict(Counter)
    spelt = [[-1] * order + list((t or "").encode().lower()) + [256] for _, t in rows]
    for (i, _), b in zip(rows, spelt, strict=True):
        if remainder(i, 5) != 1:
            for q in range(order, len(b)):
                for j in range(order + 1):
                    trie[tuple(b[q - j : q])][b[q]] += 1

    def log(context, symbol):
        gone, p = set(), 1.0
        while True:
            left = {k: v for k, v in trie.get(context, {}).items() if k not in gone}
            total = sum(left.values())
            if total:
                if symbol in left:
                    return math.log10(p * (left[symbol] - 0.5) / total)
                p *= len(left) / 2 / total
                gone |= set(left)
            if not context:
                return math.log10(p / (255 - len(gone)))
            context = context[1:]

    known = {}
    for b in spelt:
        for q in range(order, len(b)):
            c = tuple(b[q - order : q]), b[q]
            known[c] = known.get(c) or log(*c)
    return [sum(known[tuple(b[q - order : q]), b[q]] for q in range(order, len(b))) for b in spelt]


def brute_ppm(rows):
    learns = [remainder(i, 5) != 1 for i, _ in rows]
    spelt = [words(t) for _, t in rows]
    count = Counter(w for s, o in zip(spelt, learns, strict=True) if o for w in s)
    ends = sum(learns)
    total, kinds = sum(count.values()) + ends, len(count) + (ends > 0)
    share = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    out = []
    for (i, _), s, o, score in zip(rows, spelt, learns, ppm_logs(rows), strict=True):
        out.append((i, not o, len(s) + 1, sum(count[w] > 0 for w in s) + (ends > 0), total, sum(share(count[w]) for w in s) + share(ends), score))
    return out


PPM_COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize(("block", "chunk", "piece"), [(1_000_000, 64 << 20, 4 << 20), (500, 20_000, 3_000)])
def test_ppm_equals_brute_force(docs, none, block, chunk, piece, monkeypatch):
    for name, value in (("BLOCK", block), ("CHUNK_BYTES", chunk), ("SLICE", piece)):
        monkeypatch.setattr(ppm, name, value)
    got, want = lines(ppm.lm_scores(docs), *PPM_COLUMNS), sorted(brute_ppm(texts_of(docs)), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert ppm.lm_scores(none).count() == 0


def test_ppm_reads_over_word_borders_and_knows_training_text(spark):
    """Shuffled words score lower than the text; a held-out copy of a training text scores higher than an unread one."""
    learnt = [i for i in range(200) if remainder(i, 5) != 1][:40]
    unread = [i for i in range(200) if remainder(i, 5) == 1][:3]
    texts = [prose(60) for _ in learnt]
    again = texts[0].split()
    shuffled = [again[i] for i in np.random.default_rng(1).permutation(len(again))]
    rows = [*zip(learnt, texts, strict=True), (unread[0], texts[0]), (unread[1], " ".join(shuffled)), (unread[2], prose(60))]
    got = {r.doc_id: r for r in ppm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    same, mixed = got[unread[0]], got[unread[1]]
    assert same.base_score == pytest.approx(mixed.base_score) and same.score > mixed.score + 10
    assert same.score == pytest.approx(got[learnt[0]].score) and same.score / len(texts[0]) > got[unread[2]].score / len(rows[-1][1])


def test_lookup_finds_all_keys_and_refuses_others():
    rng = np.random.default_rng(2)
    keys, values = np.unique(rng.integers(0, 1 << 48, 5_000)), rng.normal(size=5_000)
    table = ppm.Lookup(keys, values[: len(keys)])
    asked = rng.integers(0, len(keys), 20_000)
    assert (table.of(keys[asked]) == values[asked]).all()
    with pytest.raises(KeyError):
        table.of(np.array([1 << 50]))


def test_ppm_without_training_rows_is_uniform(spark):
    unread = [i for i in range(50) if remainder(i, 5) == 1]
    rows = [(i, "ab") for i in unread[:2]] + [(unread[2], None)]
    got = {r.doc_id: r.score for r in ppm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in unread[:3]] == pytest.approx([-3 * math.log10(255)] * 2 + [-math.log10(255)])


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(400)]
    rows += [(400, rows[50][1]), (401, rows[50][1]), (3, None), (500, []), (550, [float("nan")] * 12), (600, [None, *rows[1][1][1:]]), rows[7], (None, rows[9][1]), (650, [0.5, 0.25])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int")
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in usable]
    want = []
    for q, v in whole:
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v)))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    names = ("query_id", "rank", "vec_id", "score")
    assert lines(topk.top_k(frame), *names) == sorted(want, key=repr)
    assert lines(topk.top_k(frame, block=3), *names) == sorted(want, key=repr)
    assert topk.top_k(frame.where("false")).count() == 0 and topk.top_k(frame.where("vec_id = 1")).count() == 0


def test_top_k_leaves_most_inner_products_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, (40, 16))
    vectors = np.concatenate([c + rng.normal(0, 3, (100, 16)) for c in centres]).round().astype(np.int64)
    norm = float(np.sqrt((vectors**2).sum(1).max()))
    exact = vectors.astype(float)
    far = topk.distances(exact, np.sqrt(np.maximum(norm**2 - (exact**2).sum(1), 0)), exact[::100][:24])
    queries = (np.arange(20), vectors[:20], topk.distances(exact[:20], np.zeros(20), exact[::100][:24]), np.sqrt((exact[:20] ** 2).sum(1)))
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(20)]
    done = topk.best_in(queries, np.arange(len(vectors)), vectors, far, norm, 5, held)
    assert done < 0.5 * 20 * len(vectors)


def test_warc_round_trip_and_pushed_predicates(spark, tmp_path):
    page = "<html>\r\n\r\nWARC/1.1\r\n" + "x" * 1200 + "é"
    rows = [(1, "http://a/ b\r\nX: y", page, "n"), (2, None, page, "n"), (9, "http://c", page, "n"), (3, "u", "short", "n"), (4, "u", "short", "n"), (5, "u", None, "n"), (6, "u", "", "n"), (None, "u", page, "n"), (9, "http://c", page, "n"), (7, "u", "z" * 999, "n"), (8, "u", "z" * 999, "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    data = [(i, (h or "").encode()) for i, _, h, _ in rows]
    want = [(i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", 9) if len(b) >= 1000 and i != 9 else ("response", None))) for i, b in data]
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert lines(warc.archive_round_trip(pages), *names) == sorted(want, key=repr)
    assert warc.archive_round_trip(pages.where("false")).count() == 0
    folder = str(tmp_path / "warc")
    warc.write_archives(pages, folder, "none")
    read = warc.read_archives(spark, folder).where("target_uri like 'http://%' and record_type = 'revisit'")
    assert [(r.target_uri, r.payload) for r in read.collect()] == [("http://a/%20bX:%20y", b"")]
    assert warc.read_archives(spark, folder).where("target_uri is null").select("page_id").collect()[0].page_id == "2"
    assert warc.read_archives(spark, folder).where("record_type in ('response') and page_id != '3'").count() == 7


def test_warc_reader_skips_refused_blocks():
    import io

    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http;\r\n msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    stream = io.BytesIO(record * 2)
    head = warc.next_header(stream)
    assert head["content-type"] == "application/http; msgtype=response" and warc.payload_of(head, stream.read(len(block))) == b"body"
    assert warc.next_header(stream) is not None
    stream.seek(len(block), 1)
    assert warc.next_header(stream) is None
    with pytest.raises(ValueError):
        warc.next_header(io.BytesIO(b"junk\r\n"))


def test_quality_learns_and_scores_all_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    good = [(i, prose(int(rng.integers(30, 90))), 1) for i in range(300)]
    bad = [(i + 300, " ".join([w + "%%%" for w in rng.choice(WORDS, 40)] if i % 2 else [WORDS[i]] * 40), 0) for i in range(300)]
    rows = [*good, *bad]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None), (901, "")], "doc_id bigint, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (99999, 0)], "doc_id bigint, quality int")
    got = quality.quality_scores(docs, labels)
    truth = {i: q for i, _, q in rows}
    out = got.collect()
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and remainder(r.doc_id, 3) == 1) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert lines(got, "doc_id", "score") == lines(quality.quality_scores(docs, labels), "doc_id", "score")
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def brute_jaccard(texts):
    """The first place of each group of texts linked by a five-word Jaccard similarity of 0.8."""
    sets = []
    for text in texts:
        w = words(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= 0.8 * either and (either or sets[i] == sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return set(root)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from plantpulse.llm.shared import new_folder

    session = lambda master, folder: SimpleNamespace(
        sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda *_: folder)
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        new_folder(session("spark://host:7077", None), "x")
    assert new_folder(session("spark://host:7077", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert new_folder(session("local[8]", None), "x").startswith("/")


def test_packed_files_are_read_by_several_tasks(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    folder = str(tmp_path / "packed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # as many small files as partitions
        files = bitpack.write_packed(docs, BPE, f"file://{folder}")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    n = files.count()
    read = bitpack.read_documents(files, f"file://{folder}")
    assert n > 2 and read.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    assert read.count() == 400


def test_pipeline_stages_equal_their_operators(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = docs.schema
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, sf)
        if name != "token_ids":
            assert got.schema == schema
        after = written(got, "test-stage")
        ids, left = {r.doc_id for r in docs.collect()}, [r.doc_id for r in after.collect()]
        if name == "quality":
            scores = quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert sorted(left) == sorted(r.doc_id for r in scores.where("predicted = 1").collect())
        elif name == "near_copies":
            rows = sorted((r.doc_id, r.text) for r in docs.collect())
            assert sorted(left) == sorted({rows[k][0] for k in brute_jaccard([t for _, t in rows])})
        elif name == "decontaminate":
            leaks = decontaminate.leak_counts(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert sorted(left) == sorted(r.doc_id for r in leaks.where("not contaminated").collect())
        elif name == "mix":
            taken = {r.doc_id: r.copies for r in mixing.mixed_words(docs).collect()}
            assert Counter(left) == {i: n for i, n in taken.items() if n}
        else:
            assert len(left) == docs.count() and set(left) == ids
            first = after.orderBy("start").collect()
            assert [r.start for r in first] == np.cumsum([0, *[r.n_tokens for r in first]])[:-1].tolist()
        docs = after


def test_sql_twins(spark):
    from compare import difference, duck

    from plantpulse.llm.queries import QUERIES, TWINS

    con = duck("/root/testdata/sf0.001")
    for name, sql in TWINS.items():
        assert difference(QUERIES[name](spark, "/root/testdata/sf0.001"), con, sql) is None


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert {"op5_top_k", "op11_ranked_search"} <= set(entry.oracle_sql())
