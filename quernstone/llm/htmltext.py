"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks of text in page order. Each block's tag path (tags, and the words of class, id and role
names on it) and its words (hashed) are projected to a small vector; a bidirectional LSTM, written in numpy, reads the
whole sequence of blocks and labels every block as main text or not. Blocks so labelled make the text.

The weights beside this module (htmltext.npz) were made by `python -m quernstone.llm.htmltrain` on pages of its own making."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<gone>script|style|iframe|textarea|title)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=gone)\s*>|\Z)"
    r"|(?P<drawn><svg(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:(?<=/>)|(?:(?!<svg[\s/>]).)*?</svg\s*>))|(?P<empty><math(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?<=/>))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z!?][^>]*(?:>|\Z)|</>",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br picture source label math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded semantics annotation svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag also ends these, up to the nearest of the second kind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PATH_CELLS, WORD_CELLS, NUMBERS = 512, 256, 8


def blocks(page: str) -> list[tuple[tuple, str, int]]:
    """(tag path, text, characters of it in links) of each leaf block; a path is a tuple of (tag, attributes' words)."""
    found: list[tuple[tuple, str, int]] = []
    stack: list[tuple[str, tuple]] = []
    own: list[str] = []
    linked = last = in_link = 0

    def flush() -> None:
        nonlocal own, linked
        if own:
            text = " ".join(html.unescape("".join(own)).split())
            if text:
                found.append((tuple(x for x in stack if x[0] not in INLINE), text, linked))
            own = []
        linked = 0

    def pop(to: int) -> None:
        nonlocal in_link
        for name, _ in stack[to:]:
            in_link -= name == "a"
        del stack[to:]

    for m in TOKEN.finditer(page):
        if m.start() > last:
            own.append(page[last : m.start()])
            if in_link:
                linked += m.start() - last
        last = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                own.append(html.escape(m[0][9:].removesuffix("]]>")))
            elif m["gone"]:
                flush() if m["gone"].lower() not in ("script", "style") else own.append(" ")
            elif m["drawn"] or m["empty"]:
                own.append(" ")
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            own.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:  # ends an open paragraph, with what it holds
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCKS or stack[k][0] in ("td", "li", "body"):
                    break
        elif tag in CLOSES:
            ended, bar = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    pop(k)
                    break
                if stack[k][0] in bar:
                    break
        more = m["more"]
        words = ()
        if len(more) > 4 and tag not in ("a", "img"):
            words = tuple(w.lower() for a in ATTRIBUTE.finditer(more) for w in NAME_PART.findall(a[2] or a[3] or a[4] or ""))
        stack.append((tag, words))
        in_link += tag == "a"
    if last < len(page):
        own.append(page[last:])
    flush()
    return found


def _cell(name: str, cells: int) -> int:
    return zlib.crc32(name.encode()) % cells


def path_cells(path: tuple) -> list[int]:
    """Cells of a path's features: each tag on it, the last one and the one before, the attributes' words, depth."""
    out = {f"t {t}" for t, _ in path} | {f"w {w}" for _, words in path for w in words}
    if path:
        out |= {f"last {path[-1][0]}", *(f"lw {w}" for w in path[-1][1])}
    if len(path) > 1:
        out.add(f"next {path[-2][0]}")
    out.add(f"depth {min(len(path), 12) // 2}")
    return [_cell(x, PATH_CELLS) for x in sorted(out)]


def numbers(text: str, words: int, linked: int, position: float) -> list[float]:
    n = len(text)
    return [np.log1p(n) / 8, np.log1p(words) / 6, min(1.0, linked / n), float(text[-1] in ".!?:;\"”…。"), min(1.0, 10 * (text.count(",") + text.count(".")) / n), float("©" in text or "®" in text), position, float(text.isupper())]


class Labeller:
    """The network's forward pass, with projections of tag paths kept in a table."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    @classmethod
    def load(cls) -> Labeller:
        with np.load(Path(__file__).with_name("htmltext.npz")) as f:
            return cls({k: f[k].astype("f4") for k in f.files})

    def path(self, path: tuple) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = self.w["path"][path_cells(path)].sum(axis=0)
        return self.paths[path]

    def bag(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > 300_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = _cell(w.lower().strip(".,;:!?()\"'"), WORD_CELLS)
        return np.bincount(np.fromiter(map(known.__getitem__, words), "i8", len(words)), minlength=WORD_CELLS) / len(words)

    def inputs(self, page: list[tuple[tuple, str, int]]) -> np.ndarray:
        """The first layer's output for each block of a page."""
        n, bags, some = len(page), np.zeros((len(page), WORD_CELLS), "f4"), []
        for k, (_, text, linked) in enumerate(page):
            words = text.split(" ")
            bags[k] = self.bag(words)
            some.append(numbers(text, len(words), linked, k / n))
        paths = np.array([self.path(p) for p, _, _ in page], "f4")
        return np.tanh(paths + bags @ self.w["word"] + np.array(some, "f4") @ self.w["number"] + self.w["in_bias"])

    def logits(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Margins of each block of pages given by their inputs; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * max(1, len(pages[order[hi]])) <= 20_000:
                hi += 1
            some = [pages[k] for k in order[lo:hi]]
            for k, row in zip(order[lo:hi], self._batch(some), strict=True):
                out[k] = row
            lo = hi
        return out

    def _batch(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        if not lengths.max():
            return [np.zeros(0) for _ in pages]
        x = np.zeros((lengths.max(), len(pages), self.w["in_bias"].shape[0]), "f4")
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        both = np.concatenate([lstm(x, lengths, self.w, "f"), lstm(x, lengths, self.w, "b")], axis=2)
        margins = both @ self.w["out"] + self.w["out_bias"]
        return [margins[:n, k] for k, n in enumerate(lengths)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(x: np.ndarray, lengths: np.ndarray, w: dict[str, np.ndarray], way: str) -> np.ndarray:
    """Hidden states in one direction of x (time, batch, features); states stay zero outside each sequence."""
    steps, batch, _ = x.shape
    size = w[f"{way}_h"].shape[0]
    h, c = np.zeros((batch, size), x.dtype), np.zeros((batch, size), x.dtype)
    out = np.zeros((steps, batch, size), x.dtype)
    pre = x @ w[f"{way}_x"] + w[f"{way}_bias"]
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = pre[t] + h @ w[f"{way}_h"]
        gates = sigmoid(z[:, : 3 * size])
        on = (t < lengths)[:, None]
        c = np.where(on, gates[:, size : 2 * size] * c + gates[:, :size] * np.tanh(z[:, 3 * size :]), 0)
        h = np.where(on, gates[:, 2 * size :] * np.tanh(c), 0)
        out[t] = h
    return out


_READY: list[Labeller] = []


def labeller() -> Labeller:
    if not _READY:
        _READY.append(Labeller.load())
    return _READY[0]


def main_texts(pages: list[str]) -> list[str]:
    """The main text of each page: its blocks with a positive margin, joined by empty lines."""
    own = labeller()
    cut = [blocks(p) for p in pages]
    margins = own.logits([own.inputs(b) if b else np.zeros((0, own.w["in_bias"].shape[0]), "f4") for b in cut])
    return ["\n\n".join(text for (_, text, _), x in zip(b, m, strict=True) if x > 0) for b, m in zip(cut, margins, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", step: int = 256) -> DataFrame:
    """Per row: page_id, url, text, n_chars (its code points).

    A null or empty page has an empty text; null ids and urls pass through; rows may repeat; other columns are ignored;
    an empty table gives none. White space inside a block becomes one space, and blocks are joined by two line ends."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), whole_text(html_col).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                texts = main_texts(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
