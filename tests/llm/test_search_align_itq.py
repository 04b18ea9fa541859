"""Ranked search, cross-tokenizer alignment and near vectors against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plantpulse.llm import alignment, itq, lexical

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, rank int, links string"
RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdeés"), int(n))) for n in RNG.integers(1, 9, 300)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS, n))


LONG = prose(9_000)
TEXTS = [
    *[prose(int(n)) for n in RNG.integers(1, 300, 60)],
    LONG, LONG, LONG + " tail", "", None, " ", "\n\n  x", "a b  c\x1cd <|endoftext|>x  y <s> </s>", "A" * 1500, "ß🔧 \x00\t tab",
    "cut\rhere\r\n next;\r", "literal ▁ bar▁", "tail  ", "x　y\xa0z  w", "\tfirst", prose(200).upper(), prose(30).replace(" ", "\n\n"),
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


# --- ranked search --------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(rows, items, k=10):
    counted = [(i, Counter(t)) for i, x in rows if (t := terms(x))]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counted:
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(0, prose(12)), (1, WORDS[3]), (2, "no such words zzz"), (3, None), (4, ""), (5, f"{WORDS[7]} " * 5000), (6, prose(2500)), (None, WORDS[9]), (7, LONG)]


@pytest.mark.parametrize(("block", "tile"), [(500_000, 2048), (900, 7)])
def test_ranked_search_equals_brute_force(spark, docs, none, block, tile, monkeypatch):
    # small tiles and a low bound: every item needs several products; one item's repeats pass the bound
    monkeypatch.setattr(lexical, "TERMS", tile)
    monkeypatch.setattr(lexical, "ITEMS", 3 if tile == 7 else 256)
    monkeypatch.setattr(lexical, "DOCS", 13 if tile == 7 else 1024)
    monkeypatch.setattr(lexical, "LARGEST", 5_000 if tile == 7 else lexical.LARGEST)
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id bigint, text string").selectExpr("*", "1 AS rank", "'x' AS doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lines(lexical.ranked(docs, items, block_terms=block), "item_id", "rank", "doc_id", "score")
    assert got == brute_search(rows, ITEMS)
    assert lexical.ranked(none, items).count() == 0 and lexical.ranked(docs, items.where("false")).count() == 0
    assert lexical.ranked(none, items).dtypes == lexical.ranked(docs, items).dtypes


def test_tiles_add_up_to_all_weights_within_the_bound(monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 5)
    monkeypatch.setattr(lexical, "LARGEST", 100)
    block = lexical.block_of([(i, x) for i, x in ITEMS if x])
    values = block.times * 37
    total = np.zeros((len(block.ids), len(block.vocabulary)), np.int64)
    for own, dense in lexical.tiles(block, values, 0):
        assert dense.max() <= 100 and dense.shape[1] <= 5
        total[:, own] += dense[: len(total)].astype(np.int64)
    want = np.zeros_like(total)
    want[block.item, block.code] = values
    assert (total == want).all()


def test_best_of_keeps_ties_by_id_and_missing_ids_last():
    scores, ids = np.array([5, 7, 7, 0, 7, 5]), np.array([9, 4, 2, 1, 0, 3])
    got = lexical.best_of(scores, ids, np.array([0, 0, 0, 0, 1, 0], bool), 4)
    assert [x.tolist() for x in got] == [[7, 7, 7, 5], [2, 4, 0, 3], [False, False, True, False]]


# --- alignment ------------------------------------------------------------------------------


def brute_alignment(rows):
    a_lib = Tokenizer.from_file(A_PATH)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    table = alignment.byte_characters()
    bytes_of = {i: bytes(table[c] for c in t) for t, i in a_lib.get_vocab(with_added_tokens=False).items()}

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    parts, count = [], Counter()
    for doc_id, text in rows:
        a = a_lib.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        want = f" {text}".encode()
        if not text or b"".join(bytes_of[i] for i in a) != want or b"".join(map(b_bytes, b)) != want:
            parts.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(f(i)) for i in some]).tolist() for f, some in ((bytes_of.get, a), (b_bytes, b))]
        where = [dict(zip(e, range(len(e)), strict=True)) for e in ends]
        common = [e for e in ends[0] if e in where[1]]
        links = [(a[where[0][e]], b[where[1][e]]) for e in common]
        count.update(links)
        groups, i, j = [], 0, 0
        for e in common:
            x, y = where[0][e] + 1, where[1][e] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        parts.append((doc_id, a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(
        ((i, len(a), len(b), len(g), len(l), sum(count[x] == most[x[1]] for x in l), sum(count[x] for x in l),
          hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, l in parts), key=repr
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("piece", "group", "most"), [(1 << 15, 1 << 20, 300_000), (7, 3_000, 50)])
def test_alignment_equals_brute_force(docs, none, piece, group, most, monkeypatch):
    monkeypatch.setattr(alignment, "GROUP_BYTES", group)
    monkeypatch.setattr(alignment, "MOST_UNITS", most)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lines(alignment.alignment_scores(docs, A_PATH, B_PATH, piece), *COLUMNS)
    want = brute_alignment(rows)
    assert got == want and sum(x[1] == 0 for x in want) == 3  # null, empty, and the one with U+2581
    assert alignment.alignment_scores(none, A_PATH, B_PATH).count() == 0


def test_alignment_of_given_texts_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert lines(alignment.alignment_scores(docs, A_PATH, B_PATH), *COLUMNS) == brute_alignment(rows)


@pytest.mark.parametrize("piece", [1, 2, 3, 10, 64, 10_000])
def test_merge_path_pieces_are_even_and_find_all_common_ends(piece):
    rng = np.random.default_rng(piece)
    for size in (0, 1, 5, 400):
        a, b = (np.unique(rng.integers(1, 600, size)) for _ in range(2))
        i, j = alignment.merge_path(a, b, piece)
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (i[-1], j[-1]) == (len(a), len(b))
        assert (np.diff(i) + np.diff(j) <= piece + 1).all()
        at, bt = alignment.links_of(a, b, piece)
        assert a[at].tolist() == b[bt].tolist() == np.intersect1d(a, b).tolist()


# --- near vectors ---------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.95):
    good = [x is not None and len(x) > 0 and all(y is not None and math.isfinite(y) for y in x) and any(x) for _, x in rows]
    v = np.array([np.array(x, float) / np.abs(x).max() if g else np.zeros(len(rows[0][1])) for (_, x), g in zip(rows, good, strict=True)])
    size = np.linalg.norm(v, axis=1)
    v = v / np.where(size == 0, 1, size)[:, None]
    near = v @ v.T >= cosine
    near[np.arange(len(v)), np.arange(len(v))] = False
    label = np.arange(len(v))
    while True:
        low = np.array([min(label[i], label[near[i]].min(initial=len(v))) for i in range(len(v))])
        if (low == label).all():
            break
        label = low
    least = {r: min((i for (i, _), x in zip(rows, label, strict=True) if x == r and i is not None), default=None) for r in set(label.tolist())}
    return sorted(((i, int(near[k].sum()), least[label[k]], i is not None and i == least[label[k]]) for k, (i, _) in enumerate(rows)), key=repr)


def around(centre, angle, n, rng):
    noise = rng.normal(size=(n, len(centre)))
    noise -= (noise @ centre)[:, None] * centre
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return centre * np.cos(angle) + noise * np.sin(angle)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    parts = [base]
    parts += [around(base[0], 0.02, 400, rng), around(base[1], 0.12, 300, rng), around(base[2], 0.2, 120, rng), np.repeat(base[3:4], 200, 0)]
    parts += [around(base[i], a, 3, rng) for i, a in zip(range(10, 70), np.linspace(0.01, 0.25, 60), strict=True)]
    chain = [base[5]]  # neighbours linked, ends not
    for _ in range(8):
        chain.append(around(chain[-1], 0.2, 1, rng)[0])
    parts.append(np.array(chain[1:]))
    v = np.concatenate(parts) * rng.uniform(0.01, 50, sum(map(len, parts)))[:, None]
    v = v[rng.permutation(len(v))].astype(np.float32)
    return v


def test_near_vectors_equal_brute_force_where_found(spark, planted):
    rows = [(3 * i, x.tolist()) for i, x in enumerate(planted)]
    odd = [(1, None), (2, [0.0] * 64), (4, [None] + [1.0] * 63), (5, [float("nan")] + [1.0] * 63), (7, [float("inf")] * 64), rows[4], rows[4], (8, rows[4][1]), (None, rows[9][1]), (10, [])]
    df = spark.createDataFrame([(i, x, 0, "k") for i, x in rows + odd], "vec_id bigint, embedding array<float>, label int, kept string")
    got = itq.near_vectors(df).collect()
    want = brute_vectors([(i, x) for i, x in rows + odd])
    assert len(got) == len(want) and {r.vec_id for r in got} == {x[0] for x in want}
    mine, truth = Counter(), Counter()
    for r in got:
        mine[r.vec_id] += r.n_links
    for i, n, *_ in want:
        truth[i] += n
    assert all(mine[i] <= truth[i] for i in truth)  # no link below the cosine
    assert sum(mine.values()) >= 0.98 * sum(truth.values())
    roots = {i: c for i, _, c, _ in want}
    assert sum(roots[r.vec_id] == r.component_id for r in got) >= 0.98 * len(got)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id in (1, 2, 4, 5, 7, 10))


def test_near_vectors_of_tables_without_rows_or_few_axes(spark):
    kinds = "vec_id bigint, embedding array<double>"
    assert itq.near_vectors(spark.createDataFrame([], kinds)).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1e198]), (2, [-1.0, 0.0]), (3, [1.0]), (4, [2.0]), (5, [-1.0]), (6, [0.0, 1e-300])]
    got = lines(itq.near_vectors(spark.createDataFrame(rows, kinds)), "vec_id", "n_links", "component_id", "kept")
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True)]


def test_cuts_of_full_tables_lose_no_pair(spark, planted, monkeypatch):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(planted[:900])], "vec_id bigint, embedding array<float>")
    columns = ("vec_id", "n_links", "component_id")
    want = lines(itq.near_vectors(df), *columns)
    monkeypatch.setattr(itq, "CUT", 3)
    assert lines(itq.near_vectors(df), *columns) == want
    monkeypatch.setattr(itq, "CROWD", 10**9)  # no balls: same links, pair by pair
    assert lines(itq.near_vectors(df), *columns) == want


def test_codes_are_balanced_and_fitted(planted):
    x = planted.astype(float) / np.linalg.norm(planted, axis=1)[:, None]
    model = itq.fit(x, 480)
    keys, words = itq.codes(x, model)
    assert keys.shape == (len(x), itq.TABLES) and words.shape == (len(x), 2)
    turn = model[1][:, :64]
    assert np.allclose(turn.T @ turn, np.eye(64))
    signs = (x - model[0]) @ model[1] >= 0
    assert 0.3 < signs.mean(axis=0).mean() < 0.7
    lost = lambda t: float((((x - model[0]) @ t - np.where((x - model[0]) @ t >= 0, 1, -1)) ** 2).sum())
    assert lost(turn) < lost(np.linalg.qr(np.random.default_rng(1).normal(size=(64, 64)))[0])
