"""Units and ids of a byte-level BPE file of the tokenizers library.

A unit is a run of white space and the run of other characters behind it. The split pattern of these
files always cuts before white space that follows something else, so no merge crosses the ends of a
unit and a unit has the same ids wherever it stands. The library does every split and merge inside
units; this module only sees to it that each distinct unit is given to it once.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Callable
from itertools import count, islice

import numpy as np

#: Fixed value: the characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"


class ByteBPE:
    """A tokenizer file: texts to units, units to ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        splitter = parts["pre_tokenizer"] or {}
        plain = splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]
        special = [x["content"] for x in parts["added_tokens"]]
        if parts["normalizer"] or not plain or re.search(f"[{SPACE}]", "".join(special)):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.widths = np.zeros(self.size, np.int64)
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            self.widths[number] = len(token)  # one character stands for one byte
        for x in parts["added_tokens"]:
            self.widths[x["id"]] = len(x["content"].encode())
        ascii_units = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+").findall
        any_units = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        odd = re.compile("[\x85\xa0  -     　]").search
        self.units: Callable[[str], list[str]] = lambda text: any_units(text) if odd(text) else ascii_units(text)

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units one after another, and the number of ids of each."""
        first = np.array([x[0] in " \n" and not x[-1].isspace() for x in units], bool)
        sizes = np.zeros(len(units), np.int64)
        order = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])
        parts = []
        joined = [units[i] for i in np.flatnonzero(first)]
        lots = [joined[low : low + 500] for low in range(0, len(joined), 500)]
        done = 0
        # a text made of units has their ids in turn
        for lot, got in zip(lots, self.library.encode_batch_fast(["".join(x) for x in lots], add_special_tokens=False), strict=True):
            numbers = np.array(got.ids, np.int64)
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in lot), np.int64, len(lot)))
            sizes[order[done : done + len(lot)]] = np.diff(np.searchsorted(np.cumsum(self.widths[numbers]), ends) + 1, prepend=0)
            parts.append(numbers)
            done += len(lot)
        for i in np.flatnonzero(~first):
            numbers = np.array(self.library.encode(units[i], add_special_tokens=False).ids, np.int64)
            sizes[i] = len(numbers)
            parts.append(numbers)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[ranges(starts, sizes)].astype(np.uint32), sizes


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... of all ranges one after another."""
    until = np.cumsum(sizes)
    return np.repeat(starts - (until - sizes), sizes) + np.arange(until[-1] if len(until) else 0)


class Encoder:
    """Ids of whole texts; units met before come from a table that is thinned at ``most`` entries.

    Thinning keeps the units that were met in several groups of texts, so that common ones are not encoded again.
    """

    def __init__(self, path: str, most: int = 500_000):
        self.bpe, self.most = ByteBPE(path), most
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.sizes, self.store = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.int32)

    def _thin(self) -> None:
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
        units = list(self.known)
        self.known = defaultdict(count(len(keep)).__next__, zip([units[i] for i in keep.tolist()], range(len(keep)), strict=True))
        self.store = self.store[ranges((np.cumsum(self.sizes) - self.sizes)[keep], self.sizes[keep])]
        self.sizes, self.met = self.sizes[keep], self.met[keep] // 2

    def numbers(self, units: list[str]) -> np.ndarray:
        """The place of each unit in ``sizes``."""
        if len(self.known) > self.most:
            self._thin()
        before = len(self.known)
        codes = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))  # numbers new units as it meets them
        if new := list(islice(reversed(self.known), len(self.known) - before)):
            ids, sizes = self.bpe.ids(new[::-1])
            self.sizes, self.store = np.concatenate([self.sizes, sizes]), np.concatenate([self.store, ids])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        here = np.zeros(len(self.met), bool)
        here[codes] = True
        self.met += here
        return codes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        units: list[str] = []
        ends = [0]
        for text in texts:
            units += self.bpe.units(text)
            ends.append(len(units))
        codes = self.numbers(units)
        sizes = self.sizes[codes]
        starts = (np.cumsum(self.sizes) - self.sizes)[codes]
        return self.store[ranges(starts, sizes)], np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends])


def shared_encoder(path: str) -> Encoder:
    """The encoder of this process: the tasks that a worker runs one after another find each other's units."""
    import tokenizers  # this package is sent by value, anew for each job, so it cannot hold what outlasts a task

    held = tokenizers.__dict__.setdefault("_shared_encoder", {})
    if path not in held:
        held.clear()
        held[path] = Encoder(path)
    return held[path]
