"""Operators 2, 3, 6 and 8 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpus_pipeline import near_dedup
from quernstone.llm.common import text_key, whole_text
from quernstone.llm.decontaminate import Items, all_samples, best_match, decontaminated, edits_allowed, leaks
from quernstone.llm.minhash import Words, bag_minhash, near_duplicates, shingles, similar
from quernstone.llm import neardup_vectors
from quernstone.llm.neardup_vectors import near_vectors
from quernstone.llm.substring import find_spans, remove_repeats, sentences

DOCS = "doc_id long, text string, uid long, v long, band string, kept string, item_id long"


def docs_of(spark, texts):
    rows = [(*(t if isinstance(t, tuple) else (k, t)), 1, 2, "b", None, 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 40)) for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        x = rng.random()
        if x < 0.4:
            words[k] = "new" + str(rng.randint(0, 999))
        elif x < 0.7:
            words.insert(k, "more" + str(rng.randint(0, 999)))
        elif len(words) > 1:
            del words[k]
    return words


def groups(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# near-duplicates


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts):
    bags = [bag(t) for t in texts]
    links = []
    for b in range(len(texts)):
        for a in range(b):
            shared = sum((bags[a] & bags[b]).values())
            if (texts[a] or "") == (texts[b] or "") or shared and 5 * shared >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                links.append((a, b))
    return groups(len(texts), links)


def test_near_duplicates(spark):
    rng = random.Random(1)
    texts = []
    for size in (1, 1, 2, 3, 8, 40, 60):  # the last families are large and hold texts on either side of the threshold
        base = prose(rng, rng.randint(60, 200))
        texts += [" ".join(edited(rng, base, rng.randint(0, 5 if size > 9 else 3))) for _ in range(size)]
    texts += [texts[0], texts[-1], texts[-1].upper(), None, "", "", "...", "one", "One", "one two", "a b c d", "A  B c D", "a a a a a a a a a", "a a a a a a a a a a", "a a a a a a", "x " * 5000, "x " * 4990]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[k] for k in order]
    for block in (2048, 7):
        rows = {r.doc_id: r for r in near_duplicates(docs_of(spark, texts), block=block).collect()}
        want = brute_classes(texts)
        assert [rows[k].class_id for k in range(len(texts))] == want
        assert all(rows[k].kept == (want[k] == k) for k in range(len(texts)))
        assert all(rows[k].text_class == next(j for j, t in enumerate(texts) if (t or "") == (texts[k] or "")) for k in range(len(texts)))


def test_near_duplicates_of_odd_rows(spark):
    assert near_duplicates(docs_of(spark, []).limit(0)).collect() == []
    rows = near_duplicates(docs_of(spark, [(None, "a b"), (5, "a b"), (5, "a b"), (6, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.class_id is None) for r in rows) == [(False, 5, True), (False, 5, True), (False, 6, False), (True, 0, True)]


def test_near_duplicates_of_texts_that_share_an_id(spark):
    rng = random.Random(8)
    near, other, third = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    texts = {name: " ".join(w) for name, w in (("T", near), ("B", other), ("C", third))}
    t, b, c = (texts[k] + " end" for k in "TBC")
    for mine in ([t, texts["B"]], [texts["B"], t]):
        docs = docs_of(spark, [(3, texts["T"]), (5, mine[0]), (5, mine[1]), (9, b), (None, texts["C"]), (None, "alone here"), (7, c)]).select("doc_id", "text")
        left = {(r.doc_id, r.text) for r in near_dedup(spark, docs, "").collect()}
        assert left == {(3, texts["T"]), (5, texts["B"]), (None, texts["C"]), (None, "alone here")}
        found = near_duplicates(docs, with_key=True).drop("doc_id").distinct()
        got = {(r.doc_id, r.text): (r.class_id, r.kept) for r in docs.withColumn("key", text_key(whole_text())).join(found, "key").collect()}
        assert {k for k, (_, kept) in got.items() if kept} == left
        assert {k: c for k, (c, kept) in got.items() if not kept} == {(5, t): 3, (9, b): 5, (7, c): None}



def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 60).astype("u8")
    for a, b in ((rng.integers(1, 40, 60), rng.integers(1, 40, 60)), (np.ones(60, int), np.ones(60, int) * 9), (rng.integers(1, 3, 60), rng.integers(1, 3, 60))):
        x, y = bag_minhash([(h[:50], a[:50]), (h[10:], b[10:])], 4000)
        full = np.zeros(60), np.zeros(60)
        full[0][:50], full[1][10:] = a[:50], b[10:]
        want = np.minimum(*full).sum() / np.maximum(*full).sum()
        assert abs((x == y).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4000) + 1e-3
    alone, together = bag_minhash([(h, a)])[0], bag_minhash([(h[:3], a[:3]), (h, a), (h[:0], a[:0])])
    assert (alone == together[1]).all() and not together[2].any()


def test_similar_at_the_border():
    words = Words()
    make = lambda n, extra: shingles(words.hashes(" ".join(f"w{k}" for k in range(n)) + extra), 1)
    assert similar(make(80, ""), make(80, "".join(f" e{k}" for k in range(20))), 0.8)
    assert not similar(make(80, ""), make(80, "".join(f" e{k}" for k in range(21))), 0.8)


# substring dedup


def words_of(text):
    """(first character, end, whether it ends a sentence, whether a span may begin there) of each word, by a plain scan."""
    out, k = [], 0
    while k < len(text):
        if text[k].isspace():
            k += 1
            continue
        e = k
        while e < len(text) and not text[e].isspace() and not (e > k and text[e - 1] in "。！？" and text[e] not in "。！？.!?…\"')]}»”’"):
            e += 1
        w, gap = text[k:e], text[e : e + len(text[e:]) - len(text[e:].lstrip())]
        stop = w[-1] in ".!?…。！？" or len(w) > 1 and w[-1] in "\"')]}»”’" and w[-2] in ".!?…。！？"
        ends = stop or "\n" in gap or e == len(text) or not text[e:].strip()
        out.append((k, e, ends, not out or out[-1][2] or w[0].isupper() and not w[1:2].isupper()))
        k = e
    return out


def brute_repeats(texts, least, words):
    """Every run of so many sentences and words or more, from every word where one may begin."""
    seen, gone, runs = {}, [set() for _ in texts], []
    for d, t in enumerate(texts):
        w = words_of(t or "")
        for i in range(len(w)):
            if w[i][3]:
                count = 0
                for j in range(i, len(w)):
                    count += w[j][2]
                    if w[j][2] and count >= least and j - i + 1 >= words:
                        runs.append((d, i, j, tuple(t[a:b] for a, b, *_ in w[i : j + 1])))
    for d, i, j, key in runs:
        if key in seen:
            gone[d] |= set(range(i, j + 1))
        seen.setdefault(key, (d, i, j))
    out = []
    for t, g in zip(texts, gone, strict=True):
        w = words_of(t or "")
        ends = [x[0] for x in w[1:]] + [len(t or "")]
        out.append(t if not g else t[: w[0][0]] + "".join(t[w[k][0] : ends[k]] for k in range(len(w)) if k not in g))
    return out


def text_of(rng, n):
    return " ".join(" ".join(prose(rng, rng.randint(1, 14))).capitalize() + rng.choice([".", "!", ".\n", "?"]) for _ in range(n))


def test_remove_repeats(spark):
    rng = random.Random(3)
    passage = [text_of(rng, rng.randint(7, 12)) for _ in range(4)]
    texts = []
    for k in range(60):
        parts = [text_of(rng, rng.randint(0, 8)) for _ in range(3)]
        if k % 2:
            parts.insert(rng.randint(0, 3), rng.choice(passage))
        if k % 9 == 0:
            parts += [passage[0], passage[0].lower()]
        texts.append(" ".join(parts))
    texts += ["in running " + passage[1], passage[1].replace(". ", ".\n  "), "日本語。 " + "あ。" * 9 + "い！う", "“Ab cd.” (Ef gh!) " * 4 + "IJ kl", "\n" + passage[2] + "\n"]
    texts += [texts[0], texts[1], None, "", " ", "Of. The. Of. The. Of.", "Of. The. Of. The.", "a. " * 300]
    for least, words in ((1, 14), (2, 20), (3, 8)):
        rows = {r.doc_id: r for r in remove_repeats(docs_of(spark, texts), min_sentences=least, min_words=words, long=1 << 40).collect()}
        want = brute_repeats(texts, least, words)
        for k, t in enumerate(texts):
            assert rows[k].text == want[k], k
            assert rows[k].n_removed == len(t or "") - len(want[k] or "") and rows[k].band == "b" and rows[k].kept is None
    first = next(k for k in range(60) if texts[k].count(passage[1]))
    holders = [k for k in range(65) if passage[1] in texts[k] and k != first]
    got = {r.doc_id: r.text for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert passage[1] in got[first]
    assert holders and not any(s in got[k] for k in holders for s in sentences(passage[1])) and got[60] == "in running "
    # texts without a repeat are as they were
    assert all(got[k] == texts[k] for k in range(0, 60, 2) if k % 9)


def test_remove_repeats_of_odd_rows(spark):
    assert remove_repeats(docs_of(spark, []).limit(0)).collect() == []
    t = text_of(random.Random(4), 12)
    docs = docs_of(spark, [(None, t), (3, t), (3, t), (4, t), (3, None)])
    rows = remove_repeats(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == [(-1, t), (3, ""), (3, ""), (3, ""), (4, "")] and sum(r.text is None for r in rows) == 1
    clashing = docs.selectExpr("doc_id", "text", "1 as n_removed", "2 as row", "3 as places", "4 as t", "5 as h1", "'x' as done", "6 as `a b`")
    rows = remove_repeats(clashing).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "n_removed", "row", "places", "t", "h1", "done", "a b"}
    assert sorted(r.n_removed for r in rows) == [0, 0, len(t), len(t), len(t)] and {(r.row, r.places, r.t, r.h1, r.done, r["a b"]) for r in rows} == {(2, 3, 4, 5, "x", 6)}
    long = " ".join(text_of(random.Random(5), 20_000).split(" "))
    got = {r.doc_id: r.text for r in remove_repeats(docs_of(spark, [long, "x. " + long, " " * 300_000])).collect()}
    assert got[0] == long and got[1] == "x. " and got[2] == " " * 300_000
    assert "".join(sentences(t)) == t


def repeated_runs(texts, least):
    """(text, first word, end) of the runs whose windows of `least` words all stand in an earlier text."""
    seen, runs = set(), []
    for d, t in enumerate(texts):
        w = t.lower().split()
        windows = [tuple(w[k : k + least]) for k in range(len(w) - least + 1)]
        start = None
        for k, x in enumerate([*windows, None]):
            if x in seen and start is None:
                start = k
            elif x not in seen and start is not None:
                runs.append((d, start, k + least - 1))
                start = None
        seen.update(windows)
    return runs


def test_repeated_runs_go_whatever_stands_around(spark):
    rng = random.Random(6)
    kinds = []
    for k in range(60):  # without stops; in sentences of 25 words; with capitals; one that begins with a long sentence
        words = [f"q{k}{w}" for w in prose(rng, rng.randint(50, 90))]
        for at in ((), range(24, len(words), 25), range(7, len(words), 9), (24,))[k % 4]:
            words[at] += "."
        kinds.append([w.capitalize() if k % 4 == 2 and rng.random() < 0.3 else w for w in words])
    texts = []
    for words in kinds * 3:
        before, after = prose(rng, rng.choice([0, 1, 10, 25, 40])), prose(rng, rng.choice([0, 1, 10, 40]))
        texts.append(" ".join(before + words + after))
    runs = repeated_runs(texts, 50)
    assert len(runs) == 120
    got = {r.doc_id: r.text for r in remove_repeats(docs_of(spark, texts)).collect()}
    left = []
    for d, a, b in runs:
        w, stay = texts[d].split(), got[d].split()
        head = next((k for k in range(b - a) if stay[a + k : a + k + 1] != [w[a + k]]), b - a)
        assert stay == w[: a + head] + w[len(w) - (len(stay) - a - head) :]  # one gap, and nothing else goes
        left.append(b - a - (len(w) - len(stay)))
    # what stays: the words before the first and after the last place where a sentence, or a piece of a long one, ends
    assert max(left) < 25 and sum(left) / len(left) < 10, (max(left), sum(left) / len(left))
    assert all(got[k] == texts[k] for k in range(60))


def test_common_spans_do_not_meet(spark):
    rng = random.Random(7)
    line = text_of(rng, 8)
    texts = [line + " " + text_of(rng, 3) for _ in range(300)]
    docs = docs_of(spark, texts).selectExpr("doc_id as uid", "doc_id as t", "text")
    assert max(r["count"] for r in find_spans(docs, 2, 20).groupBy("h1", "h2").count().collect()) <= docs.rdd.getNumPartitions()
    got = {r.doc_id: r.text for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and not any(line[:-20] in got[k] for k in range(1, 300))


# benchmark decontamination


def edit_distance_in(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks(spark):
    rng = random.Random(5)
    items = [prose(rng, rng.randint(6, 58)) for _ in range(40)] + [["solo", "pair"], []]
    texts, planted = [], 0
    for _ in range(300):
        words = prose(rng, rng.randint(0, 150))
        if rng.random() < 0.6:
            item = rng.choice(items[:40])
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, item, rng.randint(0, edits_allowed(len(item)) + 2))
        texts.append(rng.choice([" ", "  ", ", "]).join(words).replace("a", rng.choice("aA")))
    texts += [None, "", "the Solo, pair.", " ".join(items[0]), " ".join(items[0][1:])]
    bench = spark.createDataFrame([(100 + k, " ".join(w)) for k, w in enumerate(items)] + [(None, "zz zz"), (7, None)], "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        want |= {(d, 100 + k) for k, item in enumerate(items) if item and edit_distance_in(item, w) <= edits_allowed(len(item))}
    for block in (20_000, 15):
        got = {(r.doc_id, r.item_id) for r in leaks(docs_of(spark, texts), bench, block=block).collect()}
        assert got <= want and len(got) >= 0.99 * len(want)
        planted = {d for d, _ in got}
        clean = decontaminated(docs_of(spark, texts), bench, block=block)
        assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - planted and clean.columns == docs_of(spark, texts).columns
    assert (302, 140) in got and (303, 100) in got
    assert leaks(docs_of(spark, texts), bench.limit(0)).collect() == [] and decontaminated(docs_of(spark, texts), bench.limit(0)).count() == len(texts)
    assert leaks(docs_of(spark, []).limit(0), bench).collect() == []


def test_cgk_keeps_small_distances_small():
    rng, words = random.Random(6), Words()
    item = words.hashes(" ".join(prose(rng, 40)))
    hit = near = 0
    for _ in range(200):
        other = np.array(edited(rng, item.tolist(), 4)[:40], dtype=object)
        other = np.array([x if isinstance(x, int) else words.hashes(x)[0] for x in other] + [0] * (40 - len(other)), "u8")
        far = words.hashes(" ".join(prose(rng, 40)))
        met = lambda x: (all_samples(x[None], np.array([40])) == all_samples(item[None], np.array([40]))).any()
        hit, near = hit + met(other), near + met(far)
    assert hit >= 199 and near < 20
    assert best_match(item[:5], item) == (0, 5) and Items([(1, None)]).find([item]) == [[]]


# vectors


def brute_vectors(rows, c=0.98):
    use = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            use[k] = np.array(v, "f8")
    links = [(a, b) for b in use for a in use if a < b and rows[a][2] == rows[b][2] and len(use[a]) == len(use[b]) and use[a] @ use[b] / np.sqrt((use[a] @ use[a]) * (use[b] @ use[b])) >= c]
    return Counter(x for p in links for x in p), groups(len(rows), links)


@pytest.mark.parametrize(("pivots", "block"), [(32, 4096), (8, 5), (1, 50)])
def test_near_vectors(spark, pivots, block):
    rng = np.random.default_rng(7)
    rows = []
    for label in (0, 1, None):
        for size in (1, 2, 40, 90):
            base = rng.standard_normal(16)
            rows += [((base + 0.25 * rng.standard_normal(16) / 2) * rng.uniform(0.1, 9), label) for _ in range(size)]
        rows += [(rng.standard_normal(16), label) for _ in range(60)]
    rows += [rows[3], rows[3], (np.zeros(16), 0), ([], 0), (None, 0), ([1.0, None], 0), ([1.0, float("nan")], 1), ([float("inf"), 1.0], 1), ([1.0, 0.1], 0), ([2.0, 0.2], 0), ([1e-30, 0.0], 0)]
    order = rng.permutation(len(rows)).tolist()
    rows = [(n, None if rows[k][0] is None else [x if x is None else float(np.float32(x)) for x in rows[k][0]], rows[k][1]) for n, k in enumerate(order)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, uid int, cell string").repartition(4)
    got = {r.vec_id: r for r in near_vectors(df, pivots=pivots, block=block).collect()}
    count, root = brute_vectors(rows)
    assert [got[k].n_links for k in range(len(rows))] == [count[k] for k in range(len(rows))]
    assert [got[k].component_id for k in range(len(rows))] == root and all(got[k].kept == (root[k] == k) for k in got)


def test_near_vectors_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in rows) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_are_stored_once_however_many_pivots(spark, monkeypatch, kind):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((30, 48))
    rows = [(base[k % 30] + rng.uniform(0, 0.3) * rng.standard_normal(48), k % 2) for k in range(300)] + [(rng.standard_normal(48), 0) for _ in range(200)]
    for k in range(40):  # on either side of the threshold, nearer to it than single precision can tell
        a, b = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
        c = 0.98 + (k - 19.5) * 1e-9 if kind == "double" else 0.98
        rows += [(a, 1), (c * a + np.sqrt(1 - c * c) * b, 1)]
    cast = np.float32 if kind == "float" else float
    rows = [(n, [float(cast(x)) for x in v], label) for n, (v, label) in enumerate(rows)]
    sizes, stored = [], neardup_vectors.stored

    def noted(df, name):
        out = stored(df, name)
        if name != "found":
            sizes.append(out.selectExpr("sum(rows)").first()[0] if "rows" in out.columns else out.count())
        return out

    monkeypatch.setattr(neardup_vectors, "stored", noted)
    monkeypatch.setattr(neardup_vectors, "BEHIND", 3, raising=False)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(4)
    got = {r.vec_id: r for r in near_vectors(df, pivots=300, block=16).collect()}
    count, root = brute_vectors(rows)
    assert [got[k].n_links for k in range(len(rows))] == [count[k] for k in range(len(rows))]
    assert [got[k].component_id for k in range(len(rows))] == root
    assert set(sizes) == {len(rows)}


@pytest.mark.parametrize("most", [5, 70, 400])
def test_near_vector_tasks_compare_blocks_once(most):
    rng = random.Random(12)
    labels = sorted(rng.randint(0, most) for _ in range(401))
    first, last = labels[:-1], labels[1:]  # the last label of a block goes on in the next
    pairs = Counter((x, y) for x0, x1, y0, y1 in neardup_vectors._tasks(first, last) for x in range(x0, x1) for y in range(max(x, y0), y1))
    assert set(pairs.values()) == {1} and {(x, y) for x in range(400) for y in range(x, 400) if first[y] <= last[x]} <= set(pairs)
