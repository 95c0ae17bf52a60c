from pyspark.sql import functions as F
from quillstore.operators import diversity as dv
from quillstore.operators import ranking as rk

from test_operators import _many_rows, _mmr_by_hand


def test_windows_smaller_than_the_rows_give_the_greedy_order(spark, monkeypatch):
    """Rows outside a window meet its picks in blocks, and picking stops where one of them comes first."""
    for name, most in (("WINDOW_ROWS", 150), ("CELLS", 1000), ("PAIRS", 50)):
        monkeypatch.setattr(dv, name, most)
    rows = _many_rows()
    d = spark.createDataFrame([("q", *r) for r in rows], "query_id string, n long, score double, words array<string>")
    got = dv.mmr(d).orderBy("position").collect()
    assert [r.n for r in got] == _mmr_by_hand(rows, rk.sc.MMR_LAMBDA) and [r.position for r in got] == list(range(1, 401))


def test_an_order_that_stops_early_fills_a_budget_as_the_whole_does(spark, monkeypatch):
    monkeypatch.setattr(dv, "WINDOW_ROWS", 40)
    rows = _many_rows()
    d = spark.createDataFrame([("q", *r) for r in rows], "query_id string, n long, score double, words array<string>")
    sized = d.select("query_id", "n", (F.size("words") + 5).cast("long").alias("tokens"))

    def placed(order):
        return order.join(sized, ["query_id", "n"]).select("query_id", "n", F.col("position").alias("rank"), "tokens")

    order = dv.mmr(d, enough=lambda o: rk.filled(placed(o), sized.join(o, ["query_id", "n"], "left_anti"), 90))
    gap, want = 90, []
    for n in _mmr_by_hand(rows, rk.sc.MMR_LAMBDA):
        size = len(dict((m, w) for m, _, w in rows)[n]) + 5
        if size <= gap:
            gap -= size
            want.append(n)
    assert order.count() < 400
    assert sorted(r.n for r in rk.greedy_fill(placed(order), 90).collect()) == sorted(want)


def test_a_fill_of_many_rows_is_one_pass(spark, monkeypatch):
    """What is left over is kept once, not copied for each row: 60,000 rows of which nearly all are left."""
    rows = spark.range(60_000).select(F.lit("q").alias("query_id"), "id", (F.col("id") % 4000 + 1).alias("tokens"), F.concat(F.lit("t"), F.col("id") % 9).alias("type"))
    rows = rows.select("query_id", F.col("id").alias("n"), F.col("id").alias("rank"), "type", "tokens")
    got = rk.reserved_fill(rows, 4000, {"t0": 800}).collect()
    first = [n for n in range(0, 60_000, 9)]
    used, own = 0, []
    for n in first:
        if used + n % 4000 + 1 <= 800:
            used, own = used + n % 4000 + 1, [*own, n]
    assert sorted(r.n for r in got if r.own) == sorted(own) and sum(r.n % 4000 + 1 for r in got) <= 4000
    assert "aggregate(" not in rk.reserved_fill(rows, 4000)._jdf.queryExecution().analyzed().toString()


def test_a_fill_is_over_once_all_that_fits_fits_together(spark):
    """Rows that all fit whatever their order need no place in it; the fill takes them last."""
    order = spark.createDataFrame([("q", 1, 1, 60), ("q", 2, 2, 50), ("q", 3, 3, 30)], "query_id string, rank long, n long, tokens long")
    left = lambda *tokens: spark.createDataFrame([("q", 10 + i, t) for i, t in enumerate(tokens)], "query_id string, n long, tokens long")
    for tokens, over in (((11, 500), True), ((4, 6, 11), True), ((4, 7, 11), False), ((10,), True), ((0, 3, 0), True), ((10, 1), False), ((9, 9), False)):
        assert rk.filled(order, left(*tokens), 100) == over, tokens
    assert rk.filled(order.where("false"), left(60, 41), 100) is False
    last = order.unionByName(left(4, 6, 11).withColumn("rank", F.lit(2**62)))
    assert sorted(r.n for r in rk.greedy_fill(last, 100).collect()) == [1, 3, 10, 11]


def test_a_query_whose_budget_is_filled_goes_no_further(spark, monkeypatch):
    """Its rows are not met by later rounds; the other query's order is the whole greedy order."""
    monkeypatch.setattr(dv, "WINDOW_ROWS", 40)
    rows = _many_rows()
    d = spark.createDataFrame([(q, *r) for q in "pq" for r in rows], "query_id string, n long, score double, words array<string>")
    got = dv.mmr(d, more=lambda o: {"q"}).orderBy("position").collect()
    assert [r.n for r in got if r.query_id == "q"] == _mmr_by_hand(rows, rk.sc.MMR_LAMBDA)
    first = [r.n for r in got if r.query_id == "p"]
    assert 0 < len(first) <= 40 and first == _mmr_by_hand(rows, rk.sc.MMR_LAMBDA)[: len(first)]
