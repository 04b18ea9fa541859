"""Tokens of two tokenizers over the same bytes, aligned by merging their end offsets in merge-path pieces.

The ends of A's tokens and of B's tokens are two ascending lists. A diagonal of their merge is found by
binary search, so the merge is cut into pieces of equal work that need nothing of each other, however long
a document is. A piece gives the overlaps of its ends: the places where both lists end together. A group
is what lies between two such places, wherever its first token stood, which stitches groups that cross pieces.

Texts are cut to units (see bytebpe) that neither tokenizer merges across; each distinct unit is given to
both libraries once per task, until the table of units is emptied.

The linked ids of a pair end together, so the bytes of one end with those of the other. That bounds
the possible pairs by the vocabularies alone (``possible_pairs``), and their counts can be broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.bytebpe import SPACE, ByteBPE, ranges
from plantpulse.llm.shared import groups_of_texts, written

#: Ends of a piece; bytes of text taken at once; units kept in a task's table, and their characters; units given to the libraries at once.
PIECE = 1 << 15
GROUP_BYTES = 1 << 19
MOST_UNITS = 250_000
MOST_CHARACTERS = 5_000_000
AT_ONCE = 8_000


def byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def bytes_of_a(bpe: ByteBPE) -> list[bytes]:
    table, out = byte_characters(), [b""] * bpe.size
    for token, number in bpe.library.get_vocab(with_added_tokens=False).items():
        out[number] = bytes(table[c] for c in token)
    return out


def bytes_of_b(library: object) -> list[bytes]:
    out = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if library.is_control(i) or library.is_unknown(i) else piece.replace("▁", " ").encode())
    return out


class Pair:
    """Both libraries, and the ids of whole texts by each."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = ByteBPE(a_path)
        self.a.library.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = SentencePieceProcessor(model_file=b_path)
        self.bytes_a, self.bytes_b = bytes_of_a(self.a), bytes_of_b(self.b)
        self.widths = [np.array([len(x) for x in some], np.int64) for some in (self.bytes_a, self.bytes_b)]
        pieces = [self.b.id_to_piece(i).replace("▁", " ") for i in range(len(self.bytes_b))]
        # white space that some piece joins to what stands before it: such texts are not cut
        joined = {m[1] for p in pieces for m in re.finditer(f"[^{SPACE}]([{SPACE}])", p)}
        if " " in joined:
            raise ValueError(f"{b_path} has pieces across words")
        self.uncut = re.compile(f"[{re.escape(''.join(joined))}]").search if joined else lambda _: None
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.same = np.zeros(0, bool)

    def b_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the units (each begins with white space) one after another, their numbers, and whether bytes are kept."""
        sizes, same, order, parts = np.zeros(len(units), np.int64), np.ones(len(units), bool), [], [np.zeros(0, np.int64)]
        plain, alone = [], []
        for i, u in enumerate(units):
            (plain if u[0] == " " and not u[-1].isspace() else alone).append(i)
        for low in range(0, len(plain), 500):
            lot = plain[low : low + 500]
            some = [units[i] for i in lot]
            text = "".join(some)
            # the library puts a space in front, which is the first unit's own
            got = self.b.encode(text[1:])
            if b"".join(map(self.bytes_b.__getitem__, got)) != text.encode():
                alone += lot
                continue
            parts.append(np.array(got, np.int64))
            ends = np.cumsum(list(map(len, some if text.isascii() else [u.encode() for u in some])))
            sizes[lot] = np.diff(np.searchsorted(np.cumsum(self.widths[1][parts[-1]]), ends) + 1, prepend=0)
            order += lot
        lead = len(self.b.encode("x"))
        for i in alone:
            got = self.b.encode("x" + units[i])[lead:]
            parts.append(np.array(got, np.int64))
            sizes[i] = len(got)
            same[i] = b"".join(map(self.bytes_b.__getitem__, got)) == units[i].encode()
        order = np.array(order + alone, np.int64)
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(parts)[ranges(starts, sizes)].astype(np.uint32), sizes, same

    def numbers(self, units: list[str]) -> np.ndarray:
        """The place of each unit in the table."""
        if len(self.known) > MOST_UNITS or self.held > MOST_CHARACTERS:
            self._empty()
        met: dict[str, int] = defaultdict()
        met.default_factory = met.__len__
        codes = np.fromiter(map(met.__getitem__, units), np.int64, len(units))
        met.default_factory = None  # else the table, which it refers to, waits for the cycle collector
        if new := [x for x in met if x not in self.known]:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.held += sum(map(len, new))
            for low in range(0, len(new), AT_ONCE):  # the libraries' own results are many times the ids
                some = new[low : low + AT_ONCE]
                b_ids, b_sizes, same = self.b_ids(some)
                for side, (ids, sizes) in enumerate((self.a.ids(some), (b_ids, b_sizes))):
                    self.ids[side] = np.concatenate([self.ids[side], ids])
                    self.sizes[side] = np.concatenate([self.sizes[side], sizes])
                self.same = np.concatenate([self.same, same])
        return np.fromiter(map(self.known.__getitem__, met), np.int64, len(met))[codes]

    def encode(self, texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For A and B the ids of space + text one after another and their number per text; which texts have tokens."""
        units: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                text = f" {text}"
                units += [text] if self.uncut(text) else self.a.units(text)
            ends.append(len(units))
        codes = self.numbers(units)
        lost = np.diff(np.concatenate([[0], np.cumsum(~self.same[codes])])[ends])
        good = (lost == 0) & (np.diff(ends) > 0)
        codes = codes[np.repeat(good, np.diff(ends))]
        ends = np.cumsum([0, *np.where(good, np.diff(ends), 0)])
        out = []
        for ids, sizes in zip(self.ids, self.sizes, strict=True):
            many = sizes[codes]
            out.append((ids[ranges((np.cumsum(sizes) - sizes)[codes], many)], np.diff(np.concatenate([[0], np.cumsum(many)])[ends])))
        return out, good


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where every diagonal, ``piece`` ends after the last, cuts the ascending ends ``a`` and ``b``.

    Binary searches of all diagonals run side by side. Of equal ends, A's comes first, and no cut parts them.
    """
    diagonal = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        before = np.zeros(len(diagonal), bool)
        before[open_] = a[middle[open_]] <= b[diagonal[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    i, j = low, diagonal - low
    parted = np.flatnonzero((i > 0) & (j < len(b)))
    j[parted] += a[i[parted] - 1] == b[j[parted]]
    return i, j


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and ``b`` of the ends of one piece that both have."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.zeros(0, np.int64)
    return hit, at[hit]


def links_of(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and ``b`` of all common ends, piece by piece."""
    i, j = merge_path(a, b, piece)
    found = [overlaps(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]]) for p in range(len(i) - 1)]
    joined = lambda side, base: np.concatenate([np.zeros(0, np.int64), *[x[side] + base[p] for p, x in enumerate(found)]])
    return joined(0, i), joined(1, j)


class IdTexts:
    """Ids as text: decimal digits and what follows them."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.both = n_a, n_a + n_b
        # ids of A, then of B, inside a group; then both again as a group's last: A's before a bar, B's before a semicolon
        words = [b"%d," % i for n in (n_a, n_b) for i in range(n)] + [b"%d|" % i for i in range(n_a)] + [b"%d;" % i for i in range(n_b)]
        self.lengths = np.array([len(x) for x in words])
        self.letters = np.array(words).view(np.uint8).reshape(len(words), -1)

    def groups(self, a_ids: np.ndarray, b_ids: np.ndarray, at: np.ndarray, bt: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All tokens, groups in order, A's ids before B's, as one text, and where each token's part ends.

        ``at`` and ``bt``: the last A and B token of each group.
        """
        last_a, last_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        last_a[at], last_b[bt] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out = np.zeros(len(a_ids) + len(b_ids), np.int64)
        out[np.arange(len(a_ids)) + np.concatenate([[0], bt + 1])[group_a]] = a_ids + last_a * self.both
        out[np.arange(len(b_ids)) + np.append(at, 0)[group_b] + 1] = b_ids + self.n_a + last_b * self.both
        lengths = self.lengths[out]
        shown = np.arange(self.letters.shape[1]) < lengths[:, None]
        return self.letters[out][shown].tobytes(), np.cumsum(lengths)


def possible_pairs(bytes_a: list[bytes], bytes_b: list[bytes]) -> np.ndarray:
    """All pairs, as A id * size of B + B id, of which one token's bytes end with the other's; ascending.

    At most one pair per token, per suffix of it and per id with these bytes: a bound from the vocabularies.
    """
    where: list[dict[bytes, list[int]]] = []
    for some in (bytes_a, bytes_b):
        table: dict[bytes, list[int]] = {}
        for i, x in enumerate(some):
            if x:
                table.setdefault(x, []).append(i)
        where.append(table)
    pairs = {a * len(bytes_b) + b for a, x in enumerate(bytes_a) for cut in range(len(x)) for b in where[1].get(x[cut:], ())}
    pairs |= {a * len(bytes_b) + b for b, x in enumerate(bytes_b) for cut in range(len(x)) for a in where[0].get(x[cut:], ())}
    return np.array(sorted(pairs), np.int64)


def align(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links (places in possible_pairs) of every row of ``docs``.

    Texts that are null, empty or not given back by both tokenizers have no tokens: zeros and ''. Other
    columns than doc_id and text are not read; repeated rows and null ids give a row each.
    """
    pair = Pair(a_path, b_path)
    pairs = docs.sparkSession.sparkContext.broadcast(possible_pairs(pair.bytes_a, pair.bytes_b))
    n_a, n_b = len(pair.bytes_a), len(pair.bytes_b)
    kinds = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, known, texts = Pair(a_path, b_path), pairs.value, IdTexts(n_a, n_b)
        for batch in groups_of_texts(batches, "text", GROUP_BYTES):
            ((a_ids, a_sizes), (b_ids, b_sizes)), _ = both.encode(batch.column("text").to_pylist())
            a_ids, b_ids = a_ids.astype(np.int64), b_ids.astype(np.int64)
            # texts with tokens have equal bytes on both sides, so all of a batch can be merged as one
            at, bt = links_of(np.cumsum(both.widths[0][a_ids]), np.cumsum(both.widths[1][b_ids]), piece)
            shown, parts = texts.groups(a_ids, b_ids, at, bt)
            a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
            ends = np.searchsorted(at, a_ends)  # a text's last token is a group's last
            starts = np.concatenate([[0], ends])
            begin = np.concatenate([[0], parts])[np.concatenate([[0], a_ends + b_ends])].tolist()
            view = memoryview(shown)  # without a text's last semicolon
            digests = [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(begin, begin[1:], strict=False)]
            codes = np.searchsorted(known, a_ids[at] * n_b + b_ids[bt]).astype(np.int32)
            many = pa.array(np.diff(starts))
            links = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(codes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a_sizes), pa.array(b_sizes), many, many, pa.array(digests), links], schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<int>"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code and n: how many links of all documents hold each pair; added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(batch.column("links").flatten().to_numpy(), minlength=len(total))
            part[: len(total)] += total
            total = part
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["code", "n"])

    return aligned.select("links").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def alignment_scores(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE) -> DataFrame:
    """align() without ``links``, with n_best and count_sum of every row of ``docs``.

    n_best: links whose pair is, corpus-wide, among the most frequent of its B id. count_sum: the sum over the
    links of their pairs' counts. The aligned rows are written once; counts (bounded by the vocabularies) are broadcast.
    """
    aligned = written(align(docs, a_path, b_path, piece), "aligned")
    pair = Pair(a_path, b_path)
    known = possible_pairs(pair.bytes_a, pair.bytes_b)
    found = pair_counts(aligned).toArrow()
    count = np.zeros(len(known), np.int64)
    count[found.column("code").to_numpy()] = found.column("n").to_numpy()
    most = np.zeros(len(pair.bytes_b), np.int64)
    np.maximum.at(most, known % len(pair.bytes_b), count)
    shared = docs.sparkSession.sparkContext.broadcast((count, count == most[known % len(pair.bytes_b)]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for batch in batches:
            links = batch.column("links")
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
            codes = links.flatten().to_numpy()
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x[codes], dtype=np.int64)])[ends])) for x in (best, n)]
            kept = [batch.column(c) for c in names[:5]]
            yield pa.RecordBatch.from_arrays([*kept, *sums, batch.column("groups_sha256")], names=names)

    return aligned.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in names))
