"""Substring dedup over sliding sentence spans.

A sentence ends with a word that ends in a stop (or a closing mark behind one), at a line's end, and behind each full-width
stop. A span is a run of several consecutive sentences, `min_sentences` or more, with `min_words` words or more. Passages are
often set into running text, so that the words before them belong to their first sentence: a span may therefore begin at any
capitalised word, and what stands of the sentence from there on is its first sentence. Spans are hashed and met over all
documents; of the places where one stands, the first (smallest doc_id, then position) keeps it, and whatever any other place
covers is removed.

Only spans that can't be made shorter at their end, or at their begin, are hashed. That loses nothing: a longer span that
repeats brings the shorter ones in it along, and these cover it. (From its begin runs a span that can't be shorter at its
end, to its end one that can't be at its begin; a sentence that neither covers ends a span too short for `min_words` both
from the begin to it and from it to the end, and then the first of these two goes beyond it.)

Text without stops would be one sentence: sentences of more than `long` words are taken as several, too, cut behind each word
whose hash is the least of AROUND words on either side. Such spans come in addition to those of whole sentences.

Hashing is done on the characters' codes of many texts at once: white space between words counts as one space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, whole_text

_SPACE, _STOP, _WIDE, _LINE, _CLOSING, _UPPER = 1, 2, 4, 8, 16, 32
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], "u8")
_INVERSE = np.array([pow(int(p), -1, 1 << 64) for p in _PRIMES], "u8")
_BEGIN = np.uint64(1) << np.uint64(40)
LONG, AROUND = 20, 4
SPANS = "uid long, t long, h1 long, h2 int, place long, late boolean"
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """What each code point is."""
    if not _KIND:
        kind = np.zeros(0x110000, "u1")
        for c in map(chr, range(0x110000)):
            kind[ord(c)] = _SPACE * c.isspace() | _UPPER * (c.isupper() or c.istitle())
        for marks, bit in ((".!?…", _STOP), ("。！？", _WIDE), ("\n\r\v\f\x85  ", _LINE), ("\"')]}»”’", _CLOSING)):
            kind[[ord(c) for c in marks]] |= bit
        _KIND.append(kind)
    return _KIND[0]


class Layout:
    """Words, sentences and spans of some texts. Words are numbered over all texts; so are sentences."""

    def __init__(self, texts: list[str], long: int = LONG):
        self.n_chars = np.fromiter(map(len, texts), "i8", len(texts))
        self.base = np.cumsum(self.n_chars + 1) - self.n_chars - 1  # where each text begins
        codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds()[codes]
        dark = kind & _SPACE == 0
        begin = dark.copy()
        begin[1:] &= ~dark[:-1] | (kind[:-1] & _WIDE > 0) & (kind[1:] & (_WIDE | _STOP | _CLOSING) == 0)
        self.starts = np.flatnonzero(begin)  # of words, in characters
        n = len(self.starts)
        if not n:
            self.text = self.ends = self.cuts = self.begins = self.opens = self.starts
            return
        last = np.flatnonzero(dark & np.append(~dark[1:] | begin[1:], True))
        closed = kind[last] & _CLOSING > 0
        closed[closed] = kind[np.maximum(last[closed] - 1, self.starts[closed])] & (_STOP | _WIDE) > 0
        lines = np.concatenate([[0], np.cumsum(kind & _LINE > 0)])
        end = closed | (kind[last] & (_STOP | _WIDE) > 0) | (lines[np.append(self.starts[1:], len(codes))] > lines[last])
        self.text = np.searchsorted(self.base, self.starts, "right") - 1  # of each word
        self.ends = np.flatnonzero(end)  # last word of each sentence
        second = np.minimum(self.starts + 1, len(codes) - 1)
        capital = (kind[self.starts] & _UPPER > 0) & (kind[second] & _UPPER == 0)
        opens = np.concatenate([[True], end[:-1]])
        self.opens, self.begins = np.flatnonzero(opens), np.flatnonzero(capital | opens)  # words: first of a sentence, of a span
        self.rank = np.concatenate([[0], np.cumsum(dark)])
        x = codes[dark].astype("u8")
        x[begin[dark]] += _BEGIN  # where words begin
        x = mix(x)
        self.last = last
        of_long = np.repeat(lengths := np.diff(self.ends, prepend=-1), lengths) > long
        self.cuts = self.ends
        if of_long.any():  # words whose own hash is the least around
            firsts = self.rank[self.starts]
            keys = mix(np.add.reduceat(x * ((np.arange(len(x)) - np.repeat(firsts, np.diff(firsts, append=len(x)))).astype("u8") * _PRIMES[0] + np.uint64(1)), firsts))
            least = np.lib.stride_tricks.sliding_window_view(np.pad(keys, AROUND, constant_values=np.iinfo("u8").max), 2 * AROUND + 1).min(axis=1)
            self.cuts = np.flatnonzero(end | of_long & (keys == least))
        powers, undo = _powers(len(x))
        self.undo = undo
        self.sums = np.zeros((2, len(x) + 1), "u8")
        for k in range(2):
            np.cumsum(x * powers[k, : len(x)], out=self.sums[k, 1:])

    def spans(self, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, last word) of the spans to be hashed, without repeats."""
        found = self._spans(self.begins, self.ends, min_sentences, min_words)
        if len(self.cuts) > len(self.ends):
            begins = np.union1d(self.begins, (self.cuts + 1)[:-1])
            found = np.union1d(found, self._spans(begins, self.cuts, min_sentences, min_words))
        return found >> 32, found & 0xFFFFFFFF

    def _spans(self, begins: np.ndarray, ends: np.ndarray, min_sentences: int, min_words: int) -> np.ndarray:
        if not len(ends):
            return np.zeros(0, "i8")
        sentence = np.searchsorted(ends, begins)  # of each begin
        # from each begin: the least end
        to = np.maximum(np.searchsorted(ends, begins + min_words - 1), sentence + min_sentences - 1)
        good = to < len(ends)
        good[good] = self.text[ends[to[good]]] == self.text[begins[good]]
        forward = begins[good] << 32 | ends[to[good]]
        # to each end: the last begin
        k = np.arange(len(ends))
        early = np.minimum(ends - min_words + 1, ends[np.maximum(k - min_sentences + 1, 0)])
        back = np.searchsorted(begins, early, "right") - 1
        fits = (k >= min_sentences - 1) & (early >= 0) & (back >= 0)
        fits[fits] = self.text[begins[back[fits]]] == self.text[ends[fits]]
        return np.unique(np.concatenate([forward, begins[back[fits]] << 32 | ends[fits]]))

    def hashes(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Twice 64 bits of the characters of these runs of words; where sentences end doesn't count."""
        if not len(first):
            return [np.zeros(0, "u8")] * 2
        a, b = self.rank[self.starts[first]], self.rank[self.last[last]] + 1
        return [mix((self.sums[k, b] - self.sums[k, a]) * self.undo[k, a]) for k in range(2)]

    def places(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where a span stands in its text: first character * 2^32 + where the next word begins or the text ends."""
        text = self.text[last]
        after = np.append(self.starts, np.iinfo("i8").max)[last + 1] if len(last) else last
        return self.starts[first] - self.base[text] << 32 | np.minimum(after - self.base[text], self.n_chars[text])


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the primes and of their inverses, at least n of each."""
    if not _POWERS or _POWERS[0].shape[1] < n:
        _POWERS[:] = [np.cumprod(np.broadcast_to(x[:, None], (2, n + n // 4)), axis=1) for x in (_PRIMES, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def sentences(text: str) -> list[str]:
    """A text's sentences, each with the white space behind it."""
    found = Layout([text])
    begins = found.starts[found.opens].tolist()
    return [text[a:b] for a, b in zip(begins, [*begins[1:], len(text)])]


def find_spans(docs: DataFrame, min_sentences: int, min_words: int, long: int = LONG, together: int = 1 << 19) -> DataFrame:
    """(uid, t, h1, h2, place, late) of every span of docs (uid, t, text); see Layout.place.

    Late spans are known to stand at an earlier place as well. Theirs are hashes of the place, so that a common span's
    rows do not meet in one task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, rows, size = [], [], 0
            for k in range(batch.num_rows):
                some.append(batch.column(2)[k].as_py())
                rows.append(k)
                size += len(some[-1])
                if size > together or k == batch.num_rows - 1:
                    found = Layout(some, long)
                    first, last = found.spans(min_sentences, min_words)
                    if len(first):
                        of = found.text[last] + rows[0]
                        h1, h2 = found.hashes(first, last)
                        uid, t = (batch.column(c).to_numpy(zero_copy_only=False)[of] for c in range(2))
                        yield _rows(uid, t, h1.view("i8"), h2.astype("u4").view("i4"), found.places(first, last))
                    some, rows, size = [], [], 0

    return docs.select("uid", "t", "text").mapInArrow(find, SPANS)


def _rows(uid: np.ndarray, t: np.ndarray, h1: np.ndarray, h2: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    late = np.zeros(len(uid), bool)
    order = np.argsort(h1, kind="stable")
    same = h1[order[1:]] == h1[order[:-1]]
    on = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if len(on):
        on = on[np.lexsort((place[on], t[on], uid[on], h2[on], h1[on]))]
        new = np.concatenate([[True], (h1[on[1:]] != h1[on[:-1]]) | (h2[on[1:]] != h2[on[:-1]])])
        first = on[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late[on] = (uid[on] != uid[first]) | (t[on] != t[first]) | (place[on] != place[first])
        h1, h2 = np.where(late, mix(mix(mix(uid.view("u8")) ^ t.view("u8")) ^ place.view("u8")).view("i8"), h1), np.where(late, 0, h2).astype("i4")
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, t, h1, h2, place, late)], ["uid", "t", "h1", "h2", "place", "late"])


def cut(text: str, places: list[int]) -> tuple[str, int]:
    """The text without the stretches of these places, and how many characters go."""
    kept, at = [], 0
    for p in sorted(places):
        low, high = p >> 32, p & 0xFFFFFFFF
        if low > at:
            kept.append(text[at:low])
        at = max(at, high)
    out = "".join([*kept, text[at:]])
    return out, len(text) - len(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 30, long: int = LONG, count: str | None = "n_removed") -> DataFrame:
    """All columns of docs, text_col without repeated spans, and n_removed (or another name, or none), the characters that
    went.

    Texts without a repeated span come back as they are, and don't leave the JVM again. A null text counts as an empty one
    (and stays null). Rows with equal id and text are one document and get the same text; ids may be null (these come
    first). Copies of a whole document keep the first one's text only. An empty table gives none; a column of the count's
    name in docs is replaced, any other name may occur."""
    names = [c for c in docs.columns if c != count]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    text = whole_text(f"row.`{text_col}`")
    keyed = packed.withColumns({"uid": F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(-(1 << 63))), "t": F.xxhash64(text)})
    found = find_spans(keyed.select("uid", "t", text.alias("text")), min_sentences, min_words, long)
    order = Window.partitionBy("h1", "h2").orderBy("uid", "t", "place")  # rows of one document tie at its first place
    later = found.withColumn("rank", F.rank().over(order)).where("late or rank > 1")
    later = later.groupBy("uid", "t").agg(F.collect_set("place").alias("places"))  # a few a sentence of one text

    @F.pandas_udf("text string, n long")
    def without(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        done = [(None, 0) if p is None else cut(t, p.tolist()) for t, p in zip(texts, places, strict=True)]
        return pd.DataFrame(done, columns=["text", "n"])

    # only texts that lose something go to Python
    joined = keyed.join(later, ["uid", "t"], "left").select("row", "places")
    done = joined.withColumn("done", without(F.when(F.col("places").isNotNull(), text), "places"))
    new = F.when(F.col("places").isNotNull(), F.col("done.text")).otherwise(F.col(f"row.`{text_col}`").cast("string"))
    counted = [] if count is None else [F.coalesce("done.n", F.lit(0)).cast("long").alias(count)]
    return done.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names), *counted)
