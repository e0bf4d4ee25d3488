"""Embedding near-dedup: an exact metric range join of vectors with equal labels.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). A bounded sample of vectors serves as
pivots; each vector's home is the cell of its nearest pivot. A pair with homes in two cells lies on either side of the plane
between their pivots, so its distances to that plane are r together at most, and its distances to one pivot differ by at
most r; what breaks either rule is not compared. Each vector is stored once, in blocks ordered by label and cell. A task
reads a few blocks and, one after the other, others of the same labels behind them: it holds a bounded number of vectors,
and no vector is sent to more than one place, however many pivots or borders there are. Cosines are taken in single
precision first, and all that this cannot rule out again in double. Tasks hand on counts and a spanning forest of the
links, never the pairs."""

from __future__ import annotations

import os
import random
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, forest, new_folder, open_fs, stored

#: Above it, choosing a cell costs a vector more than its comparisons.
MOST_PIVOTS = 1024
#: Numbers in a block's vectors, at most (but one vector at least).
NUMBERS = 1 << 18
#: Blocks that a task reads one after the other, and links it holds before it makes them a forest again.
BEHIND, HELD = 128, 1 << 18
FOUND = "uid long, links long, root long"
BLOCKS = "file string, at long, rows int, first long, last long"
_COLUMNS = (("uid", "<i8"), ("n", "<i8"), ("l1", "<i8"), ("l2", "<i8"), ("near", "<f8"), ("cell", "<i4"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype("f8")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _deal(pivots: np.ndarray):
    """A function for mapInArrow that adds each vector's home cell and its cosine with that pivot."""
    step = max(1, (1 << 20) // max(pivots.shape))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                near = _unit(_vectors(some.column(4))) @ pivots.T
                home = near.argmax(axis=1)
                extra = [pa.array(home.astype("i4")), pa.array(near[np.arange(len(home)), home])]
                yield pa.RecordBatch.from_arrays([*some.columns, *extra], [*some.schema.names, "cell", "near"])

    return deal


def _write(folder: str, most: int):
    """A function for mapInArrow that writes a partition's rows as blocks of `most` at most and tells where they are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"  # of this attempt alone; only files of finished ones are told
        filesystem, path = open_fs(name)
        out, at, waiting, found = None, 0, [], []

        def put(table: pa.Table) -> int:
            columns = [table[c].to_numpy().astype(t) for c, t in _COLUMNS]
            vectors = np.concatenate([_vectors(x) for x in table["embedding"].chunks])
            found.append((name, at, table.num_rows, int(columns[2][0]), int(columns[2][-1])))
            data = b"".join(x.tobytes() for x in (*columns, vectors))
            out.write(data)
            return at + len(data)

        for batch in batches:
            if batch.num_rows and out is None:
                filesystem.create_dir(os.path.dirname(path), recursive=True)
                out = filesystem.open_output_stream(path)
            for lo in range(0, batch.num_rows, most):
                waiting.append(batch.slice(lo, most))
                if sum(x.num_rows for x in waiting) >= most:
                    table = pa.Table.from_batches(waiting)
                    at = put(table.slice(0, most))
                    waiting = table.slice(most).to_batches()
        if waiting and sum(x.num_rows for x in waiting):
            at = put(pa.Table.from_batches(waiting))
        if out is not None:
            out.close()
        if found:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], ["file", "at", "rows", "first", "last"])

    return write


class _Block:
    """A stored block. groups: (first, end) of each cell of a label; labels: (first, end) of each label."""

    def __init__(self, block: tuple, dim: int, kind: str):
        file, at, rows = block[:3]
        filesystem, path = open_fs(file)
        size = rows * (sum(np.dtype(t).itemsize for _, t in _COLUMNS) + dim * np.dtype(kind).itemsize)
        with filesystem.open_input_file(path) as f:
            f.seek(at)
            data = f.read(size)
        if len(data) != size:
            raise ValueError(f"{file} ends within a block")
        column, at = {}, 0
        for name, t in _COLUMNS:
            column[name] = np.frombuffer(data, t, rows, at)
            at += column[name].nbytes
        self.uid, self.n, self.near, self.cell = (column[c] for c in ("uid", "n", "near", "cell"))
        self.raw = np.frombuffer(data, kind, rows * dim, at).reshape(rows, dim)
        self.unit = _unit(self.raw)
        self.rough = self.unit.astype("f4")
        self.far = np.sqrt(np.maximum(2 - 2 * self.near, 0))
        self.count = np.zeros(rows, "i8")
        new = (column["l1"][1:] != column["l1"][:-1]) | (column["l2"][1:] != column["l2"][:-1])
        ends = [*(np.flatnonzero(new) + 1).tolist(), rows]
        self.labels = {(int(column["l1"][e - 1]), int(column["l2"][e - 1])): (s, e) for s, e in zip([0, *ends], ends)}
        ends = [*(np.flatnonzero(new | (self.cell[1:] != self.cell[:-1])) + 1).tolist(), rows]
        self.groups = [(s, e, (int(column["l1"][s]), int(column["l2"][s]))) for s, e in zip([0, *ends], ends)]


def _pairs(x: _Block, y: _Block, pivots: np.ndarray, gap: np.ndarray, radius: float, few: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and rows of y that must be compared. If x is y, pairs may come in both orders."""
    for s, e, label in x.groups:
        lo, hi = y.labels.get(label, (0, 0))
        lo = max(lo, s) if x is y else lo
        if lo >= hi:
            continue
        h = x.cell[s]
        to = y.unit[lo:hi] @ pivots[h]
        beyond, room = y.near[lo:hi] - to, radius * gap[h][y.cell[lo:hi]] + 1e-9
        far, own = np.sqrt(np.maximum(2 - 2 * to, 0)), x.far[s:e]
        at = np.flatnonzero((beyond <= room) & (far >= own.min() - radius - 1e-7) & (far <= own.max() + radius + 1e-7))
        if not len(at):
            continue
        if (e - s) * len(at) <= few:
            yield np.arange(s, e), at + lo
            continue
        cells = y.cell[lo:hi][at]
        for part in np.split(at, np.flatnonzero(cells[1:] != cells[:-1]) + 1):
            g = y.cell[lo + part[0]]
            if g == h:
                yield np.arange(s, e), part + lo
                continue
            aside, most = x.near[s:e] - x.unit[s:e] @ pivots[g], room[part[0]]
            p = np.flatnonzero(aside <= most - beyond[part].min())
            if len(p) and len(part := part[beyond[part] <= most - aside.min()]):
                yield p + s, part + lo


def _links(x: _Block, y: _Block, p: np.ndarray, q: np.ndarray, threshold: float, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x, rows of y, and which of them are linked."""
    low = np.float32(threshold - (x.raw.shape[1] + 16) * 2.0**-23)  # what single precision can be off by
    for a in range(0, len(p), rows):
        for b in range(0, len(q), rows):
            i, j = p[a : a + rows], q[b : b + rows]
            rough = x.rough[i] @ y.rough[j].T
            if rough.max() < low:
                continue
            close = rough >= low
            i, j = i[close.any(axis=1)], j[close.any(axis=0)]
            cosine = x.unit[i] @ y.unit[j].T
            hit = cosine >= threshold
            for k, m in np.argwhere(np.abs(cosine - threshold) < 1e-12):
                hit[k, m] = _cosine(x.raw[i[k]], y.raw[j[m]]) >= threshold
            if x is y:
                hit &= j[None] > i[:, None]
            if hit.any():
                yield i, j, hit


def _compare(blocks: list[tuple], tasks: list[tuple], pivots: np.ndarray, kind: str, threshold: float, radius: float):
    """A function for mapInArrow: counts and forest of the links of tasks, which come by their numbers.

    A task (x0, x1, y0, y1) compares blocks x0 to x1 with those of y0 to y1 that don't stand before them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
        for batch in batches:
            for task in batch.column(0).to_pylist():
                x0, x1, y0, y1 = tasks[task]
                us, vs, xs = [], [], [_Block(b, pivots.shape[1], kind) for b in blocks[x0:x1]]
                for k in range(max(x0, y0), y1):
                    y = xs[k - x0] if k < x1 else _Block(blocks[k], pivots.shape[1], kind)
                    for x in xs[: k - x0 + 1]:
                        for p, q in _pairs(x, y, pivots, gap, radius):
                            for i, j, hit in _links(x, y, p, q, threshold):
                                x.count[i] += hit @ y.n[j]
                                y.count[j] += x.n[i] @ hit
                                for own, root in zip((x.uid[i], y.uid[j]), _roots(hit, x.uid[i], y.uid[j]), strict=True):
                                    us += own[own != root].tolist()
                                    vs += root[own != root].tolist()
                        if len(us) > HELD:
                            us, vs = (list(c) for c in zip(*forest(us, vs), strict=True))
                    if k >= x1:
                        yield from _found(y.uid, y.count)
                for x in xs:
                    yield from _found(x.uid, x.count)
                if us:
                    us, vs = zip(*forest(us, vs), strict=True)
                    yield _rows(us, np.zeros(len(us), "i8"), vs)

    return compare


def _found(uid: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    on = count > 0
    if on.any():
        yield _rows(uid[on], count[on], uid[on])


def _rows(uid, links, root) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (uid, links, root)], ["uid", "links", "root"])


def _roots(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column reaches through the block's links."""
    none, top, side = np.iinfo("i8").max, rows.copy(), columns.copy()
    while True:
        top_now = np.minimum(top, np.where(hit, side[None], none).min(axis=1))
        side_now = np.minimum(side, np.where(hit, top_now[:, None], none).min(axis=0))
        if (top_now == top).all() and (side_now == side).all():
            return top, side
        top, side = top_now, side_now


def _cosine(a, b) -> float:
    a, b = np.asarray(a, "f8"), np.asarray(b, "f8")
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, pivots: int = 32, each: int = 1600, block: int = 4096) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id that links reach), kept (vec_id = component_id).

    A link is a cosine of at least threshold between vectors of equal, non-null label and equal dimension. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null vec_id
    (their component is null and they are kept). Repeated rows are vectors of their own. Other columns are ignored; an
    empty table gives none. There is a pivot for `each` vectors, but `pivots` at least (as far as the sample has them) and
    MOST_PIVOTS at most; `block` vectors are stored together, fewer of those with more than NUMBERS / `block` components."""
    spark, given = vectors.sparkSession, vectors.schema["embedding"].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)  # kept as it is, half the bytes
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable).withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "label")})
    radius, found = float(np.sqrt(max(0.0, 2 - 2 * threshold))), None
    for dim, count in rows.where("usable").groupBy(F.size("embedding")).count().collect():  # widths of embeddings, one as a rule
        part = rows.where("usable").where(F.size("embedding") == dim)
        wanted = min(max(pivots, count // each), MOST_PIVOTS)
        some = part.select("embedding", F.xxhash64("embedding").alias("h")).where(F.pmod("h", F.lit(max(1, count // (8 * wanted)))) == 0)
        chosen = [r[0] for r in some.distinct().orderBy("h").limit(wanted).collect()] or [part.select("embedding").first()[0]]
        chosen = _unit(np.array(chosen, "f8"))
        kind, most = ("<f4" if single else "<f8"), max(1, min(block, NUMBERS // dim))
        classes = part.groupBy("h1", "h2").agg(F.min("vec_id").alias("uid"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
        classes = classes.select("uid", "n", F.xxhash64("label").alias("l1"), F.xxhash64(F.lit(1), "label").alias("l2"), "embedding")
        dealt = classes.mapInArrow(_deal(chosen), f"uid long, n long, l1 long, l2 long, embedding array<{'float' if single else 'double'}>, cell int, near double")
        order = ["l1", "l2", "cell", "near", "uid"]
        dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
        blocks = stored(dealt.mapInArrow(_write(new_folder(spark, "vectors"), most), BLOCKS), "blocks").collect()
        blocks = sorted((tuple(b) for b in blocks), key=lambda b: (b[3], b[4], b[0], b[1]))
        tasks = _tasks([b[3] for b in blocks], [b[4] for b in blocks])
        numbers = spark.range(0, len(tasks), 1, min(len(tasks), 4096))
        links = numbers.mapInArrow(_compare(blocks, tasks, chosen, kind, threshold, radius), FOUND)
        links = stored(links, "found")
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    known = components(found.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    of = rows.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("uid"), F.count("*").alias("n"))
    of = of.join(counts, "uid", "left").join(known.withColumnRenamed("node", "uid"), "uid", "left")
    of = of.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "uid").alias("component_id"), F.lit(True).alias("usable"))
    out = rows.drop("embedding", "label").join(of, ["h1", "h2", "usable"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _tasks(first: list[int], last: list[int]) -> list[tuple]:
    """(x0, x1, y0, y1) of the tasks over blocks sorted by their first and last labels; each two blocks that may share a
    label are compared in one of them."""
    group, tasks = min(16, max(1, len(first) // 128)), []
    for x0 in range(0, len(first), group):
        x1 = min(x0 + group, len(first))
        end = bisect_right(first, max(last[x0:x1]))
        tasks += [(x0, x1, y0, min(y0 + BEHIND, end)) for y0 in range(x0, end, BEHIND)]
    random.Random(0).shuffle(tasks)  # those of large labels to all machines
    return tasks
