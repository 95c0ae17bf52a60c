"""Operators on literals worked out by hand, files, streams, and invariants."""

import json
import math
import random

from pyspark.sql import functions as F

from quillstore.operators import filters as fl
from quillstore.operators import graph as gr
from quillstore.operators import lifecycle as lc
from quillstore.operators import ranking as rk
from quillstore.sources import files
from quillstore.streaming import log


def test_path_overlap(spark):
    d = spark.createDataFrame([("src/comp", "src/components"), ("src", "src/components/Button"), ("a/b/", "a/b"), ("a", "b")], "p string, q string")
    assert [r[0] for r in d.select(fl.overlap(F.col("p"), F.col("q"))).collect()] == [False, True, True, False]


def test_scope_and_privacy(spark):
    rows = [(1, "active", "fact", None, ["x"], [], 0.9), (2, "active", "fact", "SECRET", ["x"], [], 0.9), (3, "draft", "fact", "TEAM", ["auto-extracted"], [], 0.9), (4, "expired", "fact", "TEAM", [], [], 0.9), (5, "active", "fact", "TEAM", [], ["lib"], 0.9)]
    d = spark.createDataFrame(rows, "n long, status string, type string, classification string, tags array<string>, paths array<string>, confidence double")
    ids = lambda **o: sorted(r.n for r in fl.candidates(d, **o).collect())
    assert ids() == [1, 5] and ids(include_drafts=True) == [1, 3, 5] and ids(paths=["src"]) == [1] and ids(statuses=["expired"]) == [4] and ids(types=[]) == [1, 5]


def test_bm25_by_hand(spark):
    words = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c", "c"]), (3, ["d", "d", "d"]), (4, ["e"])], "n long, words array<string>")
    got = {r.n: r.bm25 for r in rk.signals(words, rk.query_terms(spark, {"q": "b"})).collect()}
    idf = math.log((4 - 1 + 0.5) / 1.5)
    assert abs(got[1] - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2.5))) < 1e-12 and list(got) == [1]


def test_hidden_rows_change_nothing(spark):
    words = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"])], "n long, words array<string>")
    terms = rk.query_terms(spark, {"q": "a b"})
    full = words.unionByName(spark.createDataFrame([(9, ["a", "b", "b"])], words.schema))
    key = lambda d: sorted(map(tuple, rk.signals(d, terms).collect()))
    assert key(words) == key(full.where("n <> 9"))


def test_neighbour_boost_diminishes(spark):
    s = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 0.5), ("q", 3, 0.0)], "query_id string, n long, score double")
    e = spark.createDataFrame([(1, 3, "related"), (2, 3, "related")], "src long, tgt long, rel string")
    got = {r.n: r.boosted for r in rk.neighbour_boost(s, e).collect()}
    assert abs(got[3] - (0.15 + 0.5 * 0.15 / 1.15)) < 1e-12 and got[1] == 1.0


def test_greedy_fill_skips_what_does_not_fit(spark):
    d = spark.createDataFrame([("q", 1, 10, 60), ("q", 2, 11, 60), ("q", 3, 12, 40)], "query_id string, rank int, n long, tokens long")
    assert sorted(r.n for r in rk.greedy_fill(d, 100).collect()) == [10, 12]


def test_mmr_prefers_what_is_different(spark):
    w = "one two three four five six".split()
    d = spark.createDataFrame([("q", 1, 1.0, w), ("q", 2, 0.95, w), ("q", 3, 0.8, "a b c d e".split()), ("q", 4, 0.0, ["z"])], "query_id string, n long, score double, words array<string>")
    assert [r.n for r in rk.mmr(d).orderBy("position").collect()][:2] == [1, 3]


def _mmr_by_hand(rows, lam):
    """[(n, ...)] in diversity order: every pair of rows is compared."""
    grams = {n: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for n, _, w in rows}
    scores = {n: s for n, s, _ in rows}
    low, high = min(scores.values()), max(scores.values())
    rel = {n: (s - low) / (high - low) if high > low else 0.0 for n, s in scores.items()}
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    left, order, worst = set(scores), [], dict.fromkeys(scores, 0.0)
    while left:
        best = max(left, key=lambda n: (lam * rel[n] - (1 - lam) * worst[n], scores[n], -n))
        left.remove(best)
        order.append(best)
        for n in left:
            worst[n] = max(worst[n], alike(grams[n], grams[best]))
    return order


def _many_rows():
    rng = random.Random(5)
    texts = [[rng.choice("abcdef") for _ in range(rng.choice([0, 1, 2, 3, 8, 30, 400]))] for _ in range(120)]
    return [(n, round(rng.random(), 2), rng.choice(texts) + [rng.choice("abcxyz") for _ in range(rng.choice([0, 0, 1, 5]))]) for n in range(400)]


def test_mmr_orders_all_rows_as_brute_force_does(spark):
    rows = _many_rows()
    d = spark.createDataFrame([(q, n, s if q == "q" else 1.0, w) for q in ("q", "same") for n, s, w in rows], "query_id string, n long, score double, words array<string>")
    got = rk.mmr(d).orderBy("query_id", "position").collect()
    assert [r.n for r in got if r.query_id == "q"] == _mmr_by_hand(rows, rk.sc.MMR_LAMBDA)
    assert [r.n for r in got if r.query_id == "same"] == _mmr_by_hand([(n, 1.0, w) for n, _, w in rows], rk.sc.MMR_LAMBDA)


def test_budget_reaches_small_rows_behind_large_ones(spark):
    rows = [(n, 1 - n / 1000, [f"w{n}-{i}" for i in range(5)]) for n in range(300)]
    order = rk.mmr(spark.createDataFrame([("q", *r) for r in rows], "query_id string, n long, score double, words array<string>"))
    sized = order.select("query_id", F.col("position").alias("rank"), "n", F.when(F.col("n") < 290, 5000).otherwise(300).cast("long").alias("tokens"))
    assert sorted(r.n for r in rk.greedy_fill(sized, 4000).collect()) == list(range(290, 300))


def _fill_by_hand(rows, budget, quotas):
    used, left, out = dict.fromkeys(quotas, 0), [], []
    for rank, n, kind, tokens in sorted(rows):
        if used.get(kind, 0) + tokens <= quotas.get(kind, -1):
            used[kind] += tokens
            out.append((n, True))
        else:
            left.append((rank, n, tokens))
    gap = budget - sum(used.values())
    for _, n, tokens in left:
        if tokens <= gap:
            gap -= tokens
            out.append((n, False))
    return sorted(out)


def test_reserved_fill_as_by_hand(spark):
    rng = random.Random(9)
    for budget in (40, 400, 4000):
        rows = [(i, 1000 + i, rng.choice(["decision", "constraint", "fact", "belief"]), rng.choice([0, 1, 2, 3, 7, 50, 300, 900, 5000])) for i in range(700)]
        d = spark.createDataFrame([("q", *r) for r in rows], "query_id string, rank int, n long, type string, tokens long").repartition(3)
        scale = min(1.0, int(budget * 0.3) / 1600)
        quotas = {k: int(v * scale) for k, v in rk.sc.RESERVATIONS.items()}
        assert sorted((r.n, r.own) for r in rk.reserved_fill(d, budget).collect()) == _fill_by_hand(rows, budget, quotas)
        assert sorted(r.n for r in rk.greedy_fill(d, budget).collect()) == [n for n, _ in _fill_by_hand(rows, budget, {})]


def test_fuzzy_conflicts_with_hot_keys(spark):
    rng = random.Random(3)
    rows = sorted({(a, rng.choice([1, 1, 1, rng.randrange(30)]), rng.choice(["p", "q"]), rng.choice([5, 5, rng.randrange(40)]), rng.randrange(60)) for a in range(300)})
    d = spark.createDataFrame(rows, "atom long, subject long, predicate string, object long, day long")
    got = {}
    for r in lc.fuzzy_conflicts(d, d, 3).collect():
        got.setdefault((r.new_atom, r.subject, r.object), set()).add((r.old_atom, r.old_subject, r.old_object))
    for a, s, p, o, _ in rows:
        far = sorted((-day, b, t, q) for b, t, x, q, day in rows if x == p and b != a and t != s and q != o)
        assert got.get((a, s, o), set()) == {x[1:] for x in far[:3]}


def test_conflict_pairs(spark):
    rows = [(1, "fact", ["src"], 0.9), (2, "fact", ["src/a/b"], 0.4), (3, "fact", ["srcx"], 0.4), (4, "fact", [], 0.4), (5, "belief", [], 0.1), (6, "fact", ["src"], 0.8)]
    d = spark.createDataFrame(rows, "n long, type string, paths array<string>, confidence double")
    assert sorted((r.a, r.b) for r in lc.conflict_pairs(d, d).where("a < b").collect()) == [(1, 2), (1, 4), (2, 6), (4, 6)]


def test_hops_and_types(spark):
    e = spark.createDataFrame([(1, 2, "related"), (2, 1, "extends"), (2, 3, "related"), (3, 4, "related")], "src long, tgt long, rel string")
    assert {(r.n, r.hops) for r in gr.hops(e, spark.createDataFrame([(1,)], "n long"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {(r.n, r.m): r.rel for r in gr.neighbours(e).collect()}[1, 2] == "extends"


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: FACT-1\ntype: fact\nstatus: active\nconfidence: 0.5\ncreated_at: 2024-01-01T00:00:00Z\nupdated_at: 2024-02-01T12:30:00Z\nttl_days: null\ntags: [b, a, a]\npaths:\n  - src/x\n---\nBody\n---\nmore", encoding="utf-8")
    (tmp_path / "b.md").write_text("no header", encoding="utf-8")
    (tmp_path / "c.md").write_text("---\nid: X\n---\nno type", encoding="utf-8")
    got = files.read_atoms(spark, str(tmp_path)).collect()
    assert [(r.atom_id, r.confidence, r.ttl_days, r.tags, r.paths, r.body) for r in got] == [("FACT-1", 0.5, None, ["a", "b"], ["src/x"], "Body\n---\nmore")]
    text = files.read_atoms(spark, str(tmp_path)).select(files.atom_text()).first()[0]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text(text, encoding="utf-8")
    again = files.read_atoms(spark, str(tmp_path / "d")).first()
    assert again.asDict() | {"path": ""} == got[0].asDict() | {"path": ""} and again.created_at is not None and again.updated_at > again.created_at


def test_sealed_text(spark):
    d = spark.createDataFrame([("secret",)], "t string").withColumn("s", files.seal(F.col("t"), F.lit("k" * 32)))
    r = d.select("s", files.unseal(F.col("s"), F.lit("k" * 32)).alias("a"), files.unseal(F.col("s"), F.lit("x" * 32)).alias("b")).first()
    assert r.a == "secret" and r.b is None and "secret" not in r.s


def test_log_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    events = [{"event_id": f"e{i}", "timestamp": f"2024-01-01T00:{i % 60:02}:00Z", "action": "atom_read" if i % 3 else "atom_updated", "atom_refs": [f"A{i % 4}"], "atom_snapshot": None if i % 3 else f"v{i}"} for i in range(40)]
    (src / "1.json").write_text("\n".join(map(json.dumps, events[:25])) + "\nnot json\n")
    (src / "2.json").write_text("\n".join(map(json.dumps, events[20:])))
    q = log.once(log.read_events(spark, str(src))).writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 40
    out = log.replay_into(log.read_events(spark, str(src)), str(tmp_path / "state"), str(tmp_path / "ck")).start()
    out.processAllAvailable()
    last = out.lastProgress["batchId"] if out.lastProgress else 0
    out.stop()
    states = sorted((tmp_path / "state").iterdir(), key=lambda p: int(p.name))
    got = {r.atom_id: r.atom_snapshot for r in spark.read.parquet(str(states[-1])).collect()}
    want = {}
    for e in events:
        if e["atom_snapshot"]:
            want[e["atom_refs"][0]] = e["atom_snapshot"]
    assert got == want and last >= 0
