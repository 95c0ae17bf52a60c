"""The pipeline's near-duplicate stage against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline

from quillstore.llm import similar


def _grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(rows):
    """The smallest id of each component of pairs at 0.8 or more."""
    sets, root = [_grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                root[find(i)] = find(j)
    least = {}
    for i, (n, _) in enumerate(rows):
        least[find(i)] = min(n, least.get(find(i), n))
    return sorted(least.values())


def _rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one", "One", "one two three four", "one two three  four"]
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(60, 500))
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.03):
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in words))
    return list(enumerate(texts))


def test_stage_finds_what_brute_force_finds(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == _kept(rows)


def test_bands_in_chunks(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar.near_duplicates(docs, chunk=2).collect()
    assert len(found) == len(rows) and sorted({r.component_id for r in found}) == _kept(rows)


def test_simhash_proposes(spark):
    """Without any band, SimHash's components alone bring pairs to the exact check; those it turns down stay apart."""
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(900)]
    near, far = "a206 a8 a764 a544 a788 a389 a526 a897 a498 a78 a413 a630", "a206 a8 a764 a544 a788 a389 a526 a897 a498 a78 a413 z"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, near), (4, far), (5, "other words")], "doc_id long, text string")
    signs = similar._signatures(docs, "doc_id", "text", 5).withColumn("keys", F.array().cast("array<long>")).cache()
    name = {r.grams_hash: r.doc_id for r in signs.collect()}
    groups = similar.simhash_groups(docs, "doc_id", "text")
    assert len({r.key for r in groups.collect()}) == 3  # 1 and 2, 3 and 4
    found = similar._links(signs, docs, "text", 5, 0.8, 1024, groups).collect()
    assert {frozenset((name[r.a], name[r.b])) for r in found} == {frozenset((1, 2))}
