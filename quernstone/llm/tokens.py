"""Pre-tokenizing and tables of pieces for the public tokenizers, equal to the tokenizers library's results.

Many texts at once are cut by numpy: a character's class comes from a table, a piece begins where the classes say so, and a
piece is known by a 64-bit hash of its characters. Texts of plain characters (ASCII and U+00A0 to U+017F) are treated so;
what holds other characters, on which Unicode tables may differ, or a special token, goes to the library itself."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

from .common import mix

_PLAIN = [chr(c) for c in [*range(0x80), *range(0xA0, 0x180)]]
_SPACES = "\t\n\v\f\r \xa0"
NOT_PLAIN = re.compile("[^\x00-\x7f\xa0-ſ]")
#: Python lowers U+0130 to two characters, as the library does, but the first text to hold it should not matter.
NOT_LOWERED_ALIKE = re.compile("[^\x00-\x7f\xa0-įı-ſ]")
OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
#: What both tokenizers cut off as words of their own behind an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_CLASS = np.zeros(0x180, "u1")
for _c in _PLAIN:
    _CLASS[ord(_c)] = SPACE if _c in _SPACES else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(_c)[0], OTHER)
_A, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_MIXED = mix((np.arange(0x180, dtype="u8") + np.uint64(1)) * _A)


def load(path: str):
    """The library's tokenizer, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def specials(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


class Pieces:
    """The pieces of some plain texts: first characters and ends in `joined`, hashes, and each piece's text."""

    _powers = np.cumprod(np.full(64, _STEP))

    def __init__(self, texts: list[str], spaced: bool):
        """spaced: as the byte-level tokenizer cuts, with white space and each piece's leading space; else as the word
        tokenizer does, which drops white space and cuts numbers into digits."""
        self.joined = "\0".join(texts)
        codes = np.frombuffer(self.joined.encode("utf-32-le"), "<u4")
        kind = _CLASS[codes]
        lengths = np.fromiter(map(len, texts), "i8", len(texts))
        breaks = np.cumsum(lengths + 1)[:-1] - 1
        kind[breaks] = BREAK
        before = np.concatenate([[BREAK], kind[:-1]]).astype("u1")
        first = kind != before
        first[:1] = True
        quotes = np.flatnonzero(codes == 39)
        if len(quotes):
            self._contract(codes, kind, before, first, quotes, spaced)
        if spaced:
            after = np.concatenate([kind[1:], [BREAK]])
            first |= (kind == SPACE) & (after < SPACE)  # the last white space before a word; a space joins that word
            first[1:] &= ~((codes[:-1] == 32) & (kind[1:] < SPACE))
        else:
            first |= kind == NUMBER
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(codes))
        on = kind[starts] != BREAK if spaced else kind[starts] < SPACE
        if not spaced:
            codes = np.where(kind < SPACE, codes, 0)
        at = np.arange(len(codes))
        at -= np.repeat(starts, ends - starts)
        if len(at) and (longest := int(at.max())) >= len(self._powers):
            Pieces._powers = np.cumprod(np.full(2 * longest, _STEP))
        hashes = np.add.reduceat(_MIXED[codes] * self._powers[at], starts) if len(starts) else np.zeros(0, "u8")
        self.starts, self.ends = starts[on], ends[on]
        self.hashes = mix(hashes[on] ^ (self.ends - self.starts).astype("u8")) | np.uint64(1)
        self.of = np.searchsorted(self.starts, np.concatenate([[0], breaks + 1, [len(codes)]]))  # pieces before each text

    def _contract(self, codes, kind, before, first, quotes, spaced: bool) -> None:
        """Contractions begin where an apostrophe begins a piece, and end before whatever letters follow."""
        for p in quotes.tolist():
            if before[p] == OTHER and not first[p] or spaced and p and before[p] == SPACE and codes[p - 1] == 32:
                continue
            tail = self.joined[p + 1 : p + 3]
            n = next((len(c) for c in CONTRACTIONS if tail.startswith(c)), 0)
            if n and kind[p + 1] == LETTER:
                first[p], first[p + 1] = True, False
                if p + 1 + n < len(codes):
                    first[p + 1 + n] = True

    def text(self, k: int) -> str:
        return self.joined[self.starts[k] : self.ends[k]]


class Table:
    """Piece's hash to ids, in flat arrays. When it holds `most` pieces, those not met since the last sweep go; if more
    than half stay, all go but those asked for just now."""

    def __init__(self, most: int):
        self.most, self.bits = most, int(2 * most).bit_length() + 1
        self._clear()

    def _clear(self) -> None:
        self.slots, self.place = np.zeros(1 << self.bits, "u8"), np.zeros(1 << self.bits, "i4")
        self.keys, self.n = np.zeros(0, "u8"), 0
        self.first, self.count, self.met = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, bool)
        self.ids = np.zeros(0, "u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 for those not held."""
        out = np.full(len(keys), -1, "i8")
        left, slot = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype("i8")
        while len(left):
            there = self.slots[slot]
            hit = there == keys[left]
            out[left[hit]] = self.place[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, now: np.ndarray) -> None:
        """Distinct keys that aren't held, the number of ids of each, and all their ids; now: numbers that must stay."""
        if self.n and self.n + len(keys) > self.most:
            self.met[now] = True
            keep = np.flatnonzero(self.met)
            keep = keep if 2 * len(keep) <= self.most else np.unique(now)
            at = np.repeat(self.first[keep] - np.cumsum(self.count[keep]) + self.count[keep], self.count[keep])
            old = self.keys[keep], self.count[keep], self.ids[at + np.arange(len(at))]
            self._clear()
            self.add(*old, now[:0])
            self.met[:] = False
        while (self.n + len(keys)) * 2 > 1 << self.bits:  # one call may bring more than `most`
            self.bits += 1
            self._place(np.arange(self.n), fresh=True)
        number = np.arange(self.n, self.n + len(keys))
        self.keys = np.concatenate([self.keys, keys])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.met = np.concatenate([self.met, np.ones(len(keys), bool)])
        self.ids = np.concatenate([self.ids, ids])
        self.n = len(self.keys)
        self._place(number)

    def _place(self, number: np.ndarray, fresh: bool = False) -> None:
        if fresh:
            self.slots, self.place = np.zeros(1 << self.bits, "u8"), np.zeros(1 << self.bits, "i4")
        slot = (self.keys[number] >> np.uint64(64 - self.bits)).astype("i8")
        while len(number):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = self.keys[number[free]]
            self.place[slot[free]] = number[free]
            on = self.place[slot] != number
            on |= self.slots[slot] != self.keys[number]
            number, slot = number[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the numbered pieces in turn, how many ids stand before each piece, with the total at the end)."""
        self.met[numbers] = True
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[numbers] - ends + counts, counts)
        at += np.arange(len(at))
        return self.ids[at], np.concatenate([[0], ends])


class TextEncoder:
    """Whole texts to ids: pieces met lately come from a table, others from `learn` (pieces' texts to lists of ids)."""

    def __init__(self, path: str, spaced: bool, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000):
        self.tokenizer, self.spaced, self.learn, self.table = load(path), spaced, learn, Table(most)
        self.special = re.compile("|".join(map(re.escape, specials(path))) or r"(?!)")

    def plain(self, text: str) -> bool:
        if self.special.search(text):
            return False
        if text.isascii():
            return True
        return not NOT_PLAIN.search(text) if self.spaced else not NOT_LOWERED_ALIKE.search(text) and unicodedata.is_normalized("NFC", text)

    def encode(self, texts: list[str], together: int = 1 << 20) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; about `together` characters are cut at a time."""
        out: list[np.ndarray] = [np.zeros(0, "u4")] * len(texts)
        some, size = [], 0
        for k, text in enumerate(texts):
            if self.plain(text):
                some.append(k)
                size += len(text)
            else:
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "u4")
            if some and (size > together or k == len(texts) - 1):
                self._encode(texts, some, out)
                some, size = [], 0
        if some:
            self._encode(texts, some, out)
        return out

    def _encode(self, texts: list[str], some: list[int], out: list[np.ndarray]) -> None:
        pieces = Pieces([texts[k] if self.spaced else texts[k].lower() for k in some], self.spaced)
        numbers = self.table.find(pieces.hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            keys, at = np.unique(pieces.hashes[new], return_index=True)
            counts, ids = self.learn([pieces.text(k) for k in new[at].tolist()])
            self.table.add(keys, counts, ids, numbers[numbers >= 0])
            numbers = self.table.find(pieces.hashes)
        ids, before = self.table.spell(numbers)
        for k, a, b in zip(some, before[pieces.of[:-1]].tolist(), before[pieces.of[1:]].tolist(), strict=True):
            out[k] = ids[a:b]


class WordMerger:
    """The word tokenizer's library on words that are apart already: its normalizer and splitter, whose work is done, give
    way to a split at spaces, and its own table, which new words cannot be in, is off."""

    def __init__(self, path: str):
        from tokenizers import normalizers, pre_tokenizers

        self.whole, self.merger = load(path), load(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.merger.model._resize_cache(0)
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    def __call__(self, words: list[str], together: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids). Words go many to a line; an id that ends a word tells them apart again."""
        lines = [" ".join(words[k : k + together]) for k in range(0, len(words), together)]
        ids = np.concatenate([np.array(e.ids, "u4") for e in self.merger.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words):
            return np.diff(ends, prepend=0), ids
        each = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([len(x) for x in each]), np.array([i for x in each for i in x], "u4")


_ENCODERS: dict[str, TextEncoder] = {}


def word_encoder(path: str) -> TextEncoder:
    """One encoder per Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path, False, WordMerger(path))
    return _ENCODERS[path]
