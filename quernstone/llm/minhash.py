"""Near-duplicates by BagMinHash over multisets of word shingles.

A shingle of weight w owns the levels 0 to w - 1. Levels are covered by intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; each
interval of each shingle has a Poisson process of its own (seeded by the shingle's hash), with the interval's length as
rate. A point brings its time, a register and, within its interval, a level; points on levels from w on are thinned
out. A register keeps the earliest point. Equal registers of two documents have the probability sum(min) / sum(max) of
their weights. Points come in order of time, so a document's processes are followed only until all registers are full.

Signatures are banded; in a bucket every text is compared with the smallest one first, then texts of different groups
with each other, and every link is verified on the whole multisets. Equal texts are one class throughout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, stored, text_key, whole_text

_A, _B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
REGISTERS, BANDS = 125, 25


class Words:
    """64-bit hashes of a text's words (lower-cased runs of what \\w matches), from its characters' codes alone: a word's
    hash is a polynomial in its characters' mixed codes, so no table of words is kept."""

    _kind: list[np.ndarray] = []

    def __init__(self):
        if not self._kind:
            self._kind.append(np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000))
        self.in_word, self.powers = self._kind[0], np.cumprod(np.full(64, _STEP))

    def hashes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        on = self.in_word[codes]
        edges = np.flatnonzero(np.diff(on, prepend=False, append=False))
        starts, lengths = edges[::2], np.diff(edges)[::2]
        if not len(starts):
            return np.zeros(0, "u8")
        if (longest := int(lengths.max())) > len(self.powers):
            self.powers = np.cumprod(np.full(2 * longest, _STEP))
        x = codes[on].astype("u8") * _A
        x ^= x >> np.uint64(29)
        ends = np.cumsum(lengths)
        firsts = ends - lengths
        x *= self.powers[np.arange(len(x)) - np.repeat(firsts, lengths)]
        return mix(np.add.reduceat(x, firsts) ^ lengths.astype("u8"))


def shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes ascending, their counts) of runs of `size` words; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return words, np.zeros(0, "i8")
    size = min(size, n)
    sums = np.zeros(n - size + 1, "u8")
    for k in range(size):
        sums = (sums ^ words[k : n - size + 1 + k]) * _STEP
        sums ^= sums >> np.uint64(32)
    return np.unique(mix(sums), return_counts=True)


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each bag (hashes, weights); empty bags get zeros."""
    out = np.zeros((len(bags), registers), "u8")
    todo = [k for k, (h, _) in enumerate(bags) if len(h)]
    reach = 4.0
    while todo:
        full = _follow([bags[k] for k in todo], registers, reach)
        left = []
        for k, row in zip(todo, full, strict=True):
            if row is None:
                left.append(k)
            else:
                out[k] = row
        todo, reach = left, 2 * reach + np.log(registers)
    return out


def _follow(bags: list[tuple[np.ndarray, np.ndarray]], m: int, reach: float) -> list[np.ndarray | None]:
    """Registers from all points up to the time m / weight * (ln m + reach); None for bags with a register still empty."""
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    hashes, weights = np.concatenate([h for h, _ in bags]), np.concatenate([w for _, w in bags]).astype("i8")
    until = m * (np.log(m) + reach) / np.bincount(doc, weights=weights, minlength=len(bags))
    seeds, docs, rates, parts = [mix(hashes)], [doc], [np.ones(len(doc))], [np.ones(len(doc), "i8")]
    low, on = 1, np.flatnonzero(weights > 1)
    while len(on):
        seeds.append(mix(hashes[on] + np.uint64(low * int(_A) % (1 << 64))))
        docs.append(doc[on])
        rates.append(np.full(len(on), float(low)))
        parts.append(np.minimum(weights[on] - low, low))
        low *= 2
        on = on[weights[on] > low]
    seed, doc, rate, part = map(np.concatenate, (seeds, docs, rates, parts))
    end, time, step = until[doc], np.zeros(len(seed)), 0
    cells, times, marks = [], [], []
    while len(seed):
        step = (step + int(_STEP)) % (1 << 64)
        z = mix(seed + np.uint64(step))
        time = time - np.log(((z >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / rate
        on = time <= end
        if not on.all():
            seed, doc, rate, part, end, time, z = (x[on] for x in (seed, doc, rate, part, end, time, z))
        place = mix(z ^ _B)
        hit = (place >> np.uint64(32)).astype("i8") % np.maximum(rate.astype("i8"), 1) < part
        cells.append((doc * m + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype("i8"))[hit])
        times.append(time[hit])
        marks.append(z[hit])
    cell, time, mark = map(np.concatenate, (cells, times, marks))
    first = np.full(len(bags) * m, np.inf)
    np.minimum.at(first, cell, time)
    rows = np.zeros(len(first), "u8")
    best = time == first[cell]
    rows[cell[best]] = mark[best]
    full = np.isfinite(first).reshape(len(bags), m).all(axis=1)
    return [row if ok else None for row, ok in zip(rows.reshape(len(bags), m), full, strict=True)]


def bands(signatures: np.ndarray, n: int = BANDS) -> np.ndarray:
    """A key for each band of each signature."""
    rows = signatures.shape[1] // n
    keys = np.tile(np.arange(1, n + 1, dtype="u8") * _A, (len(signatures), 1))
    for k in range(rows):
        keys = mix(keys ^ signatures[:, k : n * rows : rows]) + _STEP
    return keys


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    """Whether sum(min) / sum(max) of two bags reaches the threshold."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both >= threshold * (int(a[1].sum()) + int(b[1].sum()) - both) - 1e-9 and both > 0


def _signed(docs: DataFrame, size: int, step: int = 256, together: int = 1 << 20) -> DataFrame:
    """(uid, key, bands) of each text of docs (uid, key, text); texts without words have no bands. At most `step` texts
    and about `together` characters are signed at a time."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            bags, held, low = [], 0, 0
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                bags.append(shingles(words.hashes(text), size))
                held += len(text)
                if held >= together or len(bags) == step or k == batch.num_rows - 1:
                    keys = bands(bag_minhash(bags)).view("i8")
                    on = np.array([len(h) > 0 for h, _ in bags])
                    ends = np.concatenate([[0], np.cumsum(on * keys.shape[1])])
                    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[on].ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(bags)), batch.column(1).slice(low, len(bags)), found], ["uid", "key", "bands"])
                    bags, held, low = [], 0, k + 1

    return docs.select("uid", "key", "text").mapInArrow(sign, "uid long, key binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough; texts: (uid, text)."""
    with_v = pairs.join(texts.select(F.col("uid").alias("v"), F.col("text").alias("b")), "v")
    both = with_v.join(texts.select(F.col("uid").alias("u"), F.col("text").alias("a")), "u").select("u", "v", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, bag = Words(), None, None
        for batch in batches:
            kept = []
            for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if u != last:
                    last, bag = u, shingles(words.hashes(a), size)
                if similar(bag, shingles(words.hashes(b), size), threshold):
                    kept.append((u, v))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*kept, strict=True)], ["u", "v"])

    return both.mapInArrow(verify, "u long, v long")


def _across(members: DataFrame, texts: DataFrame, size: int, threshold: float, block: int, chars: int = 1 << 22) -> DataFrame:
    """Links (u, v) between different groups of members (v, group, family); of those that join the same groups, some.

    A family's texts outside its largest group are held against all of its texts, through lists of the texts that hold
    a shingle; large families are dealt out in tiles of one block of the former and one of the latter, which hold about
    `block` texts and `chars` characters each."""
    sized = members.join(texts.select(F.col("uid").alias("v"), "chars"), "v")
    groups = sized.groupBy("family", "group").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    blocks = F.ceil(F.greatest(F.sum("n") / block, F.sum("chars") / chars)).cast("int")
    largest = groups.groupBy("family").agg(F.max(F.struct("n", F.col("group").alias("main"))).alias("x"), blocks.alias("blocks"))
    placed = members.join(largest.select("family", "x.main", "blocks"), "family").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    placed = placed.join(texts.select(F.col("uid").alias("v"), "text"), "v")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    base = placed.withColumn("asks", F.lit(False)).withColumn("ask_block", F.explode(every)).withColumn("block", F.col("own"))
    asking = placed.where("group <> main").withColumn("asks", F.lit(True)).withColumn("ask_block", F.col("own")).withColumn("block", F.explode(every))
    columns = ["family", "ask_block", "block", "asks", "v", "group", "text"]

    def link(table: pa.Table) -> pa.Table:
        words, rows = Words(), table.select(["asks", "v", "group", "text"]).to_pylist()
        held = [(r["v"], r["group"], shingles(words.hashes(r["text"]), size)) for r in rows if not r["asks"]]
        us, vs, joined = [], [], {}
        if held:
            hashes = np.concatenate([h for _, _, (h, _) in held])
            counts = np.concatenate([c for _, _, (_, c) in held])
            owner = np.repeat(np.arange(len(held)), [len(h) for _, _, (h, _) in held])
            order = np.argsort(hashes, kind="stable")
            hashes, counts, owner = hashes[order], counts[order], owner[order]
            totals = np.array([int(c.sum()) for _, _, (_, c) in held])
            ids, group = np.array([v for v, _, _ in held]), np.array([g for _, g, _ in held])
            for r in rows:
                if not r["asks"]:
                    continue
                h, c = shingles(words.hashes(r["text"]), size)
                low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[at], np.minimum(counts[at], np.repeat(c, n)), len(held))
                near = (shared >= threshold * (totals + int(c.sum()) - shared) - 1e-9) & (shared > 0) & (group != r["group"])
                for k in np.flatnonzero(near).tolist():
                    key = (r["group"], int(group[k]))
                    if key not in joined:
                        joined[key] = True
                        us.append(min(r["v"], int(ids[k])))
                        vs.append(max(r["v"], int(ids[k])))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return base.select(columns).unionByName(asking.select(columns)).groupBy("family", "ask_block", "block").applyInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, block: int = 512, with_key: bool = False) -> DataFrame:
    """Per row: doc_id, text_class (smallest id of an equal text), class_id (smallest id of the texts that links of
    weighted Jaccard >= threshold connect), kept (whether doc_id is class_id).

    Words are runs of letters and digits, lower-cased; a text of fewer than `size` words is one shingle; texts without
    words link with equal texts only. A null text counts as an empty one, a null id as the smallest. Of rows that
    repeat an id, all have its classes; where such rows hold different texts, each has the class of its own text, which `key`
    (text_key, on request) tells. Other columns are ignored; an empty table gives none."""
    lowest = F.lit(-(1 << 63))
    text = whole_text(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("uid"), text_key(text).alias("key"), text.alias("text"))
    signed = stored(_signed(rows, size), "signed")
    # a class's rows meet in a minimum; its bands follow the smallest id, and equal texts have equal bands
    classes = signed.groupBy("key").agg(F.min("uid").alias("uid"), F.any_value("bands").alias("bands"))
    # ids may repeat, so each distinct text gets a number of its own, which is settled by storing it
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = classes.select(F.explode("bands").alias("band"), "node")
    leaders = entries.groupBy("band").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1").select("band", "u")
    buckets = stored(entries.join(leaders, "band").select("band", "u", F.col("node").alias("v")), "buckets")
    pairs = stored(buckets.where("u < v").select("u", "v").distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes.select("node", "uid", "key"), "node")
    texts = stored(rows.join(needed, ["uid", "key"]).dropDuplicates(["node"]).select(F.col("node").alias("uid"), "text", F.length("text").alias("chars")), "texts")
    links = stored(_verified(pairs, texts, size, threshold), "links")
    known = components(links)
    # what a bucket's smallest text doesn't join may still be linked: compare texts of different groups with each other
    grouped = buckets.join(known.withColumnRenamed("node", "v"), "v", "left").select("band", "u", "v", F.coalesce("component", "v").alias("group"))
    mixed = grouped.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("band")
    mixed = stored(grouped.join(mixed, "band"), "mixed")
    if not mixed.isEmpty():
        families = components(mixed.select("u", "v"))
        members = mixed.select("v", "group").distinct().join(families.select(F.col("node").alias("v"), F.col("component").alias("family")), "v")
        known = components(links.unionByName(_across(members, texts, size, threshold, block)))
    smallest = known.join(classes.select("node", "uid"), "node").groupBy("component").agg(F.min("uid").alias("smallest"))
    known = known.join(smallest, "component").select("node", "smallest")
    of = classes.join(known, "node", "left").select("key", F.col("uid").alias("text_class"), F.coalesce("smallest", "uid").alias("class_id"))
    out = signed.select("uid", "key").join(of, "key")
    null = lambda c: F.when(F.col(c) > lowest, F.col(c)).alias(c)
    return out.select(F.when(F.col("uid") > lowest, F.col("uid")).alias("doc_id"), null("text_class"), null("class_id"), (F.col("uid") == F.col("class_id")).alias("kept"), *(["key"] if with_key else []))
