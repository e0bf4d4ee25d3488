"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words sums, over character triples that stand in both in order (gaps allowed, up to SPAN characters
in all, with word ends as characters), DECAY to the power of both spans; so `stuxpid` still shares most triples with
`stupid`. The Nyström map of a word is its kernel to the landmarks times the inverse root of their kernel matrix. A
sentence is as toxic as its worst word and a text as its worst sentence.

The machine is a multi-instance one, trained on the sentences of labelled texts with a squared hinge loss: no word of a clean
sentence may have a positive margin, and some word of some sentence of a toxic text must. Which one is latent: the machine's
own choice, made anew in each round, stands for it in the next; the first round begins with the words that stand in toxic
texts far more often than chance has it.

A linear function of the Nyström map is a weight for every triple of the landmarks, so scoring looks triples up in a
table. The score is the margin's logistic calibration on labelled texts that the machine wasn't fitted to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import whole_text

SPAN, DECAY, PIECE = 6, 0.6, 24
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
TABLE = 1 << 21
_SIGNS = re.compile(r"[\W_]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SENTENCE = re.compile(r"[.!?\n]+")


def forms(chunk: str) -> list[str]:
    """The words that a run of characters without white space may stand for: without its signs, and each part between."""
    if chunk.isalpha():
        whole, parts = chunk, []
    else:
        chunk = chunk.translate(_LEET)
        whole = _SIGNS.sub("", chunk)
        parts = [p for p in _SIGNS.split(chunk) if len(p) > 2] if len(whole) != len(chunk) else []
    out = []
    for w in {whole, *parts}:
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += [w[k : k + PIECE] for k in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return [w for w in out if w]


def chunks(text: str) -> list[str]:
    """Lower-cased runs without white space, and runs of single characters put together."""
    found = text.lower().split()
    alone = [k for k, c in enumerate(found) if len(c) == 1]
    if len(alone) > 3:
        start = 0
        for k in range(1, len(alone) + 1):
            if k == len(alone) or alone[k] != alone[k - 1] + 1:
                if k - start > 3:
                    found.append("".join(found[alone[start] : alone[k - 1] + 1]))
                start = k
    return found


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple's hash, weight) of all triples; weights are divided by the root of their squares' sum."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "u4").astype("u8")
    lengths = np.fromiter((len(w) + 2 for w in words), "i8", len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    last = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(codes))
    number, hashes, weights = [], [], []
    for a, b in GAPS:
        on = np.flatnonzero(at + b < last)
        x = (codes[on] * _K1 ^ codes[on + a]) * _K2
        x = (x ^ (x >> np.uint64(29)) ^ codes[on + b]) * _K1
        number.append(word[on])
        hashes.append((x ^ (x >> np.uint64(32))) & np.uint64(TABLE - 1))
        weights.append(np.full(len(on), DECAY ** (b + 1)))
    number, hashes, weights = np.concatenate(number), np.concatenate(hashes).astype("i8"), np.concatenate(weights)
    norm = np.sqrt(np.bincount(number, weights**2, len(words)))
    return number, hashes, weights / norm[number]


class Machine:
    """The fitted machine: a weight for each triple, a bias, and the calibration of margins."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float):
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift
        self.known: dict[str, float] = {}

    def __reduce__(self):
        on = np.flatnonzero(self.table)
        return _restored, (on, self.table[on], self.bias, self.slope, self.shift)

    def words(self, words: list[str], step: int = 5000) -> np.ndarray:
        """The margin of each word; `step` words at a time, as the triples take far more room than the words."""
        out = np.zeros(len(words))
        for lo in range(0, len(words), step):
            number, hashes, weights = triples(some := words[lo : lo + step])
            out[lo : lo + step] = np.bincount(number, self.table[hashes] * weights, len(some))
        return out + self.bias

    def margins(self, texts: list[str], most: int = 200_000) -> np.ndarray:
        """The worst word's margin of each text; -2 without words."""
        split = [set(chunks(t)) for t in texts]
        new = list({c for x in split for c in x if c not in self.known})
        if len(self.known) + len(new) > most:
            self.known.clear()
            new = list({c for x in split for c in x})
        for lo in range(0, len(new), 5000):
            some = new[lo : lo + 5000]
            made = [forms(c) for c in some]
            flat = [w for x in made for w in x]
            margins = iter(self.words(flat).tolist() if flat else ())
            for c, x in zip(some, made, strict=True):
                self.known[c] = max((next(margins) for _ in x), default=-2.0)
        return np.array([max(map(self.known.__getitem__, x), default=-2.0) for x in split])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def _restored(on: np.ndarray, values: np.ndarray, bias: float, slope: float, shift: float) -> Machine:
    table = np.zeros(TABLE)
    table[on] = values
    return Machine(table, bias, slope, shift)


def _kernel(words: list[str], landmarks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Words by landmarks; place: the column of each triple in landmarks, -1 for others."""
    out = []
    for lo in range(0, len(words), 200):
        number, hashes, weights = triples(words[lo : lo + 200])
        column = place[hashes]
        on = column >= 0
        n = min(200, len(words) - lo)
        dense = np.bincount(number[on] * landmarks.shape[1] + column[on], weights[on], n * landmarks.shape[1]).reshape(n, -1).astype("f4")
        out.append(dense @ landmarks.T)
    return np.concatenate(out) if out else np.zeros((0, len(landmarks)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Newton steps on the primal; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-8
    on = np.ones(len(x), bool)
    for _ in range(30):
        a = x[on] * weight[on, None]
        w = np.linalg.solve(keep + a.T @ x[on], a.T @ y[on])
        now = y * (x @ w) < 1
        if (now == on).all():
            break
        on = now
    return w


def nystroem(marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(triples of the landmarks, each triple's column, landmarks by columns, inverse root of the kernel matrix)."""
    number, hashes, weights = triples(marks)
    seen = np.unique(hashes)
    place = np.full(TABLE, -1)
    place[seen] = np.arange(len(seen))
    z = np.bincount(number * len(seen) + place[hashes], weights, len(marks) * len(seen)).reshape(len(marks), -1).astype("f4")
    values, vectors = np.linalg.eigh((z @ z.T).astype("f8"))
    root = vectors @ np.diag(np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)) @ vectors.T
    return seen, place, z, root


def fit(texts: list[str], toxic: list[int], landmarks: int = 512, rounds: int = 3, calibrate: int = 4) -> Machine | None:
    """Fit on labelled texts; every calibrate-th of them only calibrates. None without texts of both labels.

    Of copies, one counts. Clean words that come nearest to the border join the negative ones and the landmarks in each
    round, so that they can be told apart."""
    own = [k for k in range(len(texts)) if k % calibrate != calibrate - 1]
    copies: dict[int, list[int]] = {}
    for k, root in _families({k: texts[k] for k in own}).items():
        copies.setdefault(root, []).append(k)
    one, found, seen, sentences = {}, (Counter(), Counter()), [0, 0], []  # sentences: of one toxic text of each group
    for group in copies.values():
        for label in (0, 1):
            words: set[str] = set()
            for k in (k for k in group if toxic[k] == label):
                cut = [tuple({one.setdefault(f, f) for c in chunks(s) for f in forms(c)}) for s in SENTENCE.split(texts[k])]
                if label and not words and any(cut):
                    sentences.append([s for s in cut if s])
                words.update(*cut)
            found[label].update(words)
            seen[label] += bool(words)
    in_good, in_bad = found
    if not all(seen):
        return None
    share = seen[1] / sum(seen)
    # evidence: the log likelihood ratio of the word's own share of toxic texts against that of all texts
    odds = {w: _ratio(n, n + in_good[w], share) for w, n in in_bad.items()}
    telling = {w for w, x in odds.items() if x > 10 and in_good[w] * share < 0.1 * in_bad[w] * (1 - share)} or set(sorted(odds, key=lambda w: (-odds[w], w))[:8])
    ranking = lambda words, key: sorted(words, key=lambda w: (-key(w), w))
    rng = np.random.default_rng(7)
    clean = ranking(in_good, in_good.__getitem__)
    rare = [clean[k] for k in sorted(rng.permutation(len(clean))[:3000])]
    marks = list(dict.fromkeys([*ranking(telling, odds.__getitem__)[: landmarks // 2], *clean[: landmarks // 8], *rare[: landmarks // 8]]))
    negative = list(dict.fromkeys([*clean[:1500], *rare]))
    witnesses = {w: in_bad[w] for w in sorted(telling)}
    machine = None
    for _ in range(rounds):
        if machine is not None:
            chosen = Counter(w for x in sentences for w in _worst(x, machine))
            witnesses = dict(sorted(chosen.items())) or witnesses
            some = sorted(set(in_good) - witnesses.keys())
            margin = dict(zip(some, machine.words(some).tolist(), strict=True))
            near = ranking(some, margin.__getitem__)[:500]
            negative = list(dict.fromkeys([*negative, *near]))
            marks = list(dict.fromkeys([*marks, *near[: landmarks // 8]]))
        seen, place, z, root = nystroem(marks)
        negative = [w for w in negative if w not in witnesses]
        x = _kernel([*witnesses, *negative], z, place) @ root
        y = np.array([1.0] * len(witnesses) + [-1.0] * len(negative))
        weight = np.array([float(min(n, 20)) for n in witnesses.values()] + [float(min(in_good[w], 20)) for w in negative])
        # the two labels weigh the same
        weight[: len(witnesses)] /= weight[: len(witnesses)].sum()
        weight[len(witnesses) :] /= weight[len(witnesses) :].sum()
        w = _squared_hinge(x, y, weight)
        table = np.zeros(TABLE)
        table[seen] = z.T @ (root @ w[:-1])
        machine = Machine(table, float(w[-1]), 1.0, 0.0)
    rest = [k for k in range(len(texts)) if k % calibrate == calibrate - 1] or own
    machine.slope, machine.shift = _logistic(machine.margins([texts[k] for k in rest]), np.array([toxic[k] for k in rest], float))
    machine.known = {}
    return machine


def _worst(sentences: list[tuple[str, ...]], machine: Machine) -> list[str]:
    """The word with the largest margin in a toxic text's sentences, if that is positive."""
    words = sorted(set().union(*sentences))
    margins = machine.words(words)
    k = int(margins.argmax())
    return [words[k]] if margins[k] > 0 else []


def _ratio(part: int, total: int, share: float) -> float:
    own = part / total
    if own <= share:
        return 0.0
    return total * (own * np.log(own / share) + ((1 - own) * np.log((1 - own) / (1 - share)) if own < 1 else 0.0))


def _families(texts: dict[int, str], hashes: int = 12, rows: int = 2) -> dict[int, int]:
    """The copies' group of each text, from min-hashes of its runs of four words: copies count once, so that their
    words aren't taken for evidence."""
    up = {k: k for k in texts}

    def root(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    first: dict[tuple, int] = {}
    times = np.arange(1, 2 * hashes, 2, dtype="u8")[None] * _K1
    for k, text in texts.items():
        w = text.split()
        runs = {" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))}
        h = np.fromiter((zlib.crc32(r.encode()) for r in runs), "u8", len(runs))[:, None] * times
        low = ((h ^ (h >> np.uint64(31))) * _K2).min(axis=0).tolist()
        for b in range(0, hashes, rows):
            other = first.setdefault((b, *low[b : b + rows]), k)
            a, c = root(k), root(other)
            up[max(a, c)] = min(a, c)
    return {k: root(k) for k in texts}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with the smoothed targets that keep separable labels finite."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        r, v = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * x * x).sum() + 1e-6, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, [(r * x).sum(), r.sum()])
        step *= min(1.0, 2 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def held_out(id_col: str = "doc_id"):
    """Whether crc32(id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = 3000, most: int = 1 << 16) -> Machine | None:
    """Fit on at most per_label rows of each label that aren't held out, chosen by a hash of their ids; of these, texts of
    more than `most` bytes are left out, which bounds what comes to the driver."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    some = None
    for value in (0, 1):
        part = rows.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(per_label)
        some = part if some is None else some.unionByName(part)
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(some), "doc_id")  # at most 2 * per_label rows
    found = found.where(F.octet_length("text") <= most)
    sample = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic").collect()
    sample = sorted(sample, key=lambda r: (r.doc_id * 2654435761 % (1 << 32), r.doc_id))
    return fit([r.text for r in sample], [r.toxic for r in sample])


def score(docs: DataFrame, machine: Machine | None, text_col: str = "text", out: str = "score", step: int = 128) -> DataFrame:
    """docs with a score from 0 to 1 of each whole text. A null text counts as an empty one; an unfitted machine gives 0
    to all; a column of the score's name is replaced; all other columns, null or not, pass through."""
    rows = docs.drop(out).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    names = rows.columns
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_scores(own, part.column(names.index(text_col))), pa.float64())], [*names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, DoubleType())]))


def _scores(machine: Machine | None, texts: pa.Array) -> np.ndarray:
    return np.zeros(len(texts)) if machine is None else machine.scores([t or "" for t in texts.to_pylist()])


def below(docs: DataFrame, machine: Machine | None, threshold: float, text_col: str = "text", step: int = 128) -> DataFrame:
    """The rows of docs whose text scores less than the threshold, with all their columns, null or not, as they are. A null
    text counts as an empty one; an unfitted machine keeps all."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                yield part.filter(pa.array(_scores(own, part.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Null texts and ids, repeated rows and empty tables: as in score and held_out; a label whose document or value is null
    teaches nothing; without labels of both kinds every score is 0. Other columns are ignored."""
    scored = score(docs.select("doc_id", "text"), fit_on(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
