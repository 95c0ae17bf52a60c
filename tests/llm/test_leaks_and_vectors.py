"""Decontamination, vector codes and centroids against brute force, with nulls, ties, repeats, clashing names, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillstore.llm import clustering, codebooks, decontam
from quillstore.llm.util import ship

CLASHES = "row_key string, items string, runs string, n_words string, q string, n string, cluster string, code string, _key string, _n string"


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scan(docs, items, window):
    """[(doc_id, n_words, n_hit, sorted items)] by comparing every window."""
    wins = {}
    for name, text in items:
        w = lowered(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add("null" if name is None else str(name))
    out = []
    for d, text in docs:
        w, hit, names = lowered(text), set(), set()
        for i in range(len(w)):
            for k in {len(x) for x in wins}:
                if i + k <= len(w) and (x := tuple(w[i : i + k])) in wins:
                    hit |= set(range(i, i + k))
                    names |= wins[x]
        out.append((d, len(w), len(hit), tuple(sorted(names))))
    return out


def sentence(r, n, vocabulary=300):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def leak_cases():
    r = random.Random(5)
    items = [(i, sentence(r, 25)) for i in range(12)]
    items += [(12, "Only three words"), (13, "é ÜBER-straße x9 漢字 a b c d e f g"), (14, ""), (15, None), (16, " ... "), (3, sentence(r, 14)), (17, items[0][1]), (18, items[1][1][:60]), (None, sentence(r, 11))]
    docs = [(i, sentence(r, 80)) for i in range(20)]
    docs += [(20 + i, f"{sentence(r, 9)} {items[i % 12][1].upper()}, {sentence(r, 5)}") for i in range(12)]
    nine = " ".join(items[2][1].split()[:9])
    docs += [(40, nine), (41, f"{nine} other"), (42, "so ONLY three\twords here, and only three words"), (43, "x é Über-straße x9 漢字 a b c d e f g"), (44, ""), (45, None), (46, "..."), (47, items[20][1])]
    docs += [(48, " ".join([items[4][1]] * 3)), (49, "y " * 5 + items[5][1][:-3]), (50, sentence(r, 3000) + " " + items[6][1])]
    return docs + [docs[21], docs[21], (21, docs[22][1]), (None, items[7][1]), (None, None)], items


@pytest.mark.parametrize("block,segment", [(500_000, 8192), (60, 12)])
def test_decontamination(spark, leak_cases, block, segment):
    """One block, and many blocks of cut items, give what comparing every window gives."""
    ship(spark)
    docs, items = leak_cases
    d = spark.createDataFrame([(*x, *["clash"] * 10) for x in docs], f"doc_id long, text string, {CLASHES}").repartition(3)
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, n string").repartition(2)
    got = decontam.scan(d, b, block=block, segment=segment).collect()
    rows = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got)
    assert rows == Counter(brute_scan(docs, items, 10))
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)
    kept = decontam.decontaminate(d, b, block=block, segment=segment)
    assert kept.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x, y in zip(docs, brute_scan(docs, items, 10)) if not y[2])


def test_longest_matches(spark, leak_cases):
    """Each item's longest common run of words with any document, of a window or more."""
    ship(spark)
    docs, items = leak_cases
    got = decontam.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    texts = [(d, lowered(t)) for d, t in docs]
    want = {}
    for name, text in items:
        w, best = lowered(text), 0
        for _, t in texts:
            table = [0] * (len(t) + 1)
            for x in w:
                table = [0] + [table[j] + 1 if x == t[j] else 0 for j in range(len(t))]
                best = max(best, *table)
        if w and best >= min(10, len(w)):
            key = "null" if name is None else str(name)
            want[key] = max(want.get(key, 0), best)
    found = {r["item"]: r for r in got.collect()}
    assert {k: r["words"] for k, r in found.items()} == want
    for name, r in found.items():  # and it is where it says
        spots = [lowered(t)[r.doc_at : r.doc_at + r["words"]] for d, t in docs if d == r.doc_id]
        assert any(lowered(t)[r.item_at : r.item_at + r["words"]] in spots for i, t in items if ("null" if i is None else str(i)) == name)


def test_decontamination_of_nothing(spark):
    ship(spark)
    d, b = "doc_id long, text string", "item_id long, text string"
    none = spark.createDataFrame([], d)
    assert decontam.scan(none, spark.createDataFrame([(1, "a b")], b)).count() == 0
    got = decontam.scan(spark.createDataFrame([(1, "A b-c"), (2, None)], d), spark.createDataFrame([(1, None), (2, "!")], b)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(3, 0, 0, False), (0, 0, 0, False)]
    assert decontam.longest_matches(none, spark.createDataFrame([], b)).count() == 0


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 7)
    for text in ["", "a", "abcdefghijklmnop qr", "ab cd ef gh, ij! éé ŸŸ x" * 5, "       a       b", "aaaaaaa bbbbbbb", " " * 30]:
        assert [w.decode() for part in decontam.words(text.encode()) for w in part] == lowered(text)


# ---- vectors


def vector_rows(n=260, dims=64, seed=3):
    """(vec_id, embedding, label): gaussian vectors, copies, ties, a hot vector, and rows that are to be left out."""
    g = np.random.default_rng(seed)
    out = [(i, (g.normal(size=dims) * 0.2).tolist(), int(g.integers(0, 4))) for i in range(n)]
    out += [(1000 + i, out[i % 7][1], None if i % 2 else 9) for i in range(60)]
    out += [(2000 + i, [0.5] * dims, 2) for i in range(80)]
    odd = lambda x: [*out[0][1][:-1], x]
    out += [(3000, None, 1), (3001, odd(None), 1), (3002, odd(float("nan")), 1), (3003, odd(float("inf")), 1), (3004, odd(-float("inf")), 1), (3005, [], 1), (3006, [0.1] * (dims // 2), 1)]
    return out + [out[4], out[4], (None, out[8][1], 3), (0, out[9][1], None)]


def kept_rows(rows, scale, dims):
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def closest(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(entries))


def floored_means(vectors, of, entries):
    sums = {}
    for v, k in zip(vectors, of):
        s = sums.setdefault(k, [0, [0] * len(v)])
        s[0] += 1
        s[1] = [a + b for a, b in zip(s[1], v)]
    return [[x // sums[k][0] for x in sums[k][1]] if k in sums else e for k, e in enumerate(entries)]


def frame(spark, rows):
    return spark.createDataFrame([(*x, *["clash"] * 10) for x in rows], f"vec_id long, embedding array<float>, label int, {CLASHES}").repartition(3)


def last(i):
    return (i is None, i or 0)


def brute_codes(rows, parts, entries, rounds, scale, dims):
    kept, width = kept_rows(rows, scale, dims), dims // parts
    head = sorted(kept, key=lambda r: (*last(r[0]), r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in head] for p in range(parts)]
    for t in range(rounds + 1):
        codes = [[closest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)] for _, v, _ in kept]
        if t < rounds:
            books = [floored_means([v[p * width : (p + 1) * width] for _, v, _ in kept], [c[p][1] for c in codes], books[p]) for p in range(parts)]
    errors = [sum(d for d, _ in c) for c in codes]
    by = Counter()
    for (_, _, y), x in zip(kept, errors):
        by[y] += x
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in c), x, by[y], digest) for (i, _, y), c, x in zip(kept, codes, errors))


@pytest.mark.parametrize("parts,entries,scale", [(16, 64, 256), (4, 7, 3), (8, 400, 5)])
def test_vector_codes(spark, parts, entries, scale):
    ship(spark)
    rows = vector_rows()
    found = codebooks.compress(frame(spark, rows), parts=parts, entries=entries, scale=scale)
    got = codebooks.with_label_error(found.codes).select("vec_id", codebooks.hex_code("code").alias("code"), "error", "label_error").collect()
    width = 2 if entries <= 256 else 3  # hex of an index has two digits only up to 256 entries
    want = brute_codes(rows, parts, entries, 2, scale, 64)
    if width == 2:
        assert Counter((r.vec_id, r.code, r.error, r.label_error, found.digest()) for r in got) == want
    else:
        assert Counter((r.vec_id, r.error, r.label_error, found.digest()) for r in got) == Counter((i, x, y, z) for i, _, x, y, z in want.elements())


def test_codes_decode(spark):
    """What a code stands for is as far from the vector as its error says."""
    ship(spark)
    rows = [x for x in vector_rows() if x[0] is not None and x[0] < 900][:-3]
    found = codebooks.compress(frame(spark, rows))
    errors = {r.vec_id: r.error for r in found.codes.collect()}
    ints = {i: v for i, v, _ in kept_rows(rows, 256, 64)}
    for r in found.decoded().collect():
        assert sum((a - b) ** 2 for a, b in zip(ints[r.vec_id], r.vector)) == errors[r.vec_id]


@pytest.mark.parametrize("spread,dims", [(3, 2), (3, 4), (200, 4), (1 << 50, 3)])
def test_tree_search_is_exact(spread, dims):
    """Nearest entries by the tree, with many ties and equal entries, and beyond 64 bits."""
    g = np.random.default_rng(spread % 97)
    for n in (1, 2, 6, 7, 8, 33, 64, 300):
        entries, points = g.integers(-spread, spread, (n, dims)), g.integers(-spread, spread, (150, dims))
        points[:20] = entries[g.integers(0, n, 20)]
        who, d = codebooks.search(codebooks.tree(entries), entries, points)
        want = [closest(p, entries.tolist()) for p in points.tolist()]
        assert [(int(a), int(b)) for a, b in zip(d, who)] == want


def test_tree_search_passes_over():
    """Branch and bound measures a part of the entries only."""
    g = np.random.default_rng(1)
    entries, points = g.integers(-500, 500, (512, 3)), g.integers(-500, 500, (400, 3))
    root, seen = codebooks.tree(entries), [0]
    where = codebooks.search.__globals__
    plain = where["exact"]

    class Counted(np.ndarray):
        """Counts the rows of entries that are read."""

        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, np.ndarray):
                seen[0] += len(key)
            return np.asarray(out)

    where["exact"] = lambda q, e: (q, e.view(Counted))
    try:
        for p in points:  # one by one, so that what is read is what one point asks for
            codebooks.search(root, entries, p[None])
    finally:
        where["exact"] = plain
    assert seen[0] < 0.4 * 512 * 400


def brute_clusters(rows, k, rounds):
    kept = kept_rows(rows, 64, 64)
    head = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [r[1] for r in head]
    for t in range(rounds + 1):
        of = [closest(v, centroids) for _, v, _ in kept]
        if t < rounds:
            centroids = floored_means([v for _, v, _ in kept], [c for _, c in of], centroids)
    inertia = Counter()
    for d, c in of:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _, _), (d, c) in zip(kept, of))


@pytest.mark.parametrize("k", [16, 3, 600])
def test_centroids(spark, k):
    ship(spark)
    rows = vector_rows()
    got = clustering.cluster(frame(spark, rows), k=k).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, clustering.digest(r.centroid)) for r in got) == brute_clusters(rows, k, 3)


def test_hot_vectors(spark, monkeypatch):
    """Vectors and labels with many rows are looked up by broadcast, with equal results."""
    from quillstore.llm import vectors

    ship(spark)
    rows = vector_rows()
    monkeypatch.setattr(vectors, "max", lambda *a: 20, raising=False)
    got = clustering.cluster(frame(spark, rows)).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, clustering.digest(r.centroid)) for r in got) == brute_clusters(rows, 16, 3)
    found = codebooks.compress(frame(spark, rows), parts=4, entries=7, scale=3)
    got = codebooks.with_label_error(found.codes).select("vec_id", codebooks.hex_code("code").alias("code"), "error", "label_error").collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, found.digest()) for r in got) == brute_codes(rows, 4, 7, 2, 3, 64)


def test_no_vectors(spark):
    ship(spark)
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 64, 1)]):
        f = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        got = clustering.cluster(f)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and got.count() == 0
        found = codebooks.compress(f)
        assert found.books is None and codebooks.with_label_error(found.codes).count() == 0 and found.decoded().count() == 0


def test_huge_components(spark):
    """Components that no 64-bit square holds: integers of Python, distances at most the largest long, and no crash."""
    ship(spark)
    rows = [(i, [float(np.float32(x)) for x in ([1e10 * i] + [1.0] * 63)], 0) for i in range(20)] + [(99, [3e38] * 64, 0), (98, [-3e38] * 64, 0)]
    got = {r.vec_id: r for r in clustering.cluster(frame(spark, rows)).collect()}
    assert len(got) == 22 and all(r.distance >= 0 for r in got.values())
    errors = {r.vec_id: r.error for r in codebooks.compress(frame(spark, rows)).codes.collect()}
    assert len(errors) == 22 and min(errors.values()) >= 0


def test_sums_of_tasks_are_exact():
    from quillstore.llm.vectors import limbs

    values = [0, 1, -1, 2**32, -(2**32) - 7, 2**62, -(2**70) + 3]
    low, high = limbs(np.array(values, object))
    assert [h * (1 << 32) + x for x, h in zip(low.to_pylist(), high.to_pylist())] == values
