"""Chat formatting: collapse cumulative snapshots of conversations, then render the maximal ones.

A service that logs the whole conversation after each turn leaves many that are the beginning of longer ones. Each turn
gets two hashes of its place, role and text; their running sums identify every prefix. A conversation goes if its whole
sum is a proper prefix's sum of another, or the whole of one with a smaller conv_id. Running sums are taken within
buckets of turns, and over the buckets' sums, so one conversation with very many turns is spread over tasks; prefixes
that many share are counted once by map-side distincts. Rendering is by parts of PART places, so no text is unbounded.

Turns are placed by `turn`; rows that share one are taken in order of role and text. A null turn comes before all
others; null role or text count as empty. Rows without conv_id belong to no conversation and are left out. Repeated
rows are turns of their own. Empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import written

BUCKET, PART = 256, 64


def maximal(turns: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no prefix of another one."""
    t = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    t = t.select("conv_id", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"))
    ends = t.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    ends = ends.select("conv_id", F.coalesce("low", F.lit(0).cast("long")).alias("low"), F.coalesce(F.col("high") - F.col("low"), F.lit(-1).cast("long")).alias("end"))
    t = t.join(ends, "conv_id").withColumn("place", F.coalesce(F.col("turn") - F.col("low"), F.lit(-1).cast("long")))
    big = "decimal(38,0)"
    sums = [F.sum(F.xxhash64("place", h).cast(big)).cast(big).alias(h) for h in ("h1", "h2")]
    places = t.groupBy("conv_id", "place", "end").agg(*sums, F.count(F.lit(1)).alias("n")).withColumn("bucket", F.expr(f"place div {BUCKET}"))
    places = written(places, "chat-places")
    over = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = places.groupBy("conv_id", "bucket").agg(*[F.sum(c).alias(c) for c in ("h1", "h2", "n")])
    buckets = buckets.select("conv_id", "bucket", *[F.coalesce(F.sum(c).over(over), F.lit(0)).cast(big).alias(f"{c}_before") for c in ("h1", "h2", "n")])
    within = Window.partitionBy("conv_id", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = places.withColumns({c: F.sum(c).over(within) for c in ("h1", "h2", "n")}).join(buckets, ["conv_id", "bucket"])
    prefixes = prefixes.select("conv_id", F.expr("place = `end`").alias("whole"), *[(F.col(c) + F.col(f"{c}_before")).cast(big).alias(c) for c in ("h1", "h2", "n")])
    prefixes = written(prefixes, "chat-prefixes")
    whole = prefixes.where("whole").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = prefixes.where("not whole").select("h1", "h2", "n").distinct()
    return whole.join(proper, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text", part=PART) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, chat): the maximal conversations as chat text, in parts of `part` places."""
    keep = written(maximal(turns, conv_id=conv_id, turn=turn, role=role, text=text), "chat-maximal").withColumnRenamed("conv_id", "_conv")
    t = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    t = t.join(keep, t["conv_id"] == keep["_conv"])
    low = t.groupBy("conv_id").agg(F.min("turn").alias("low")).withColumnRenamed("conv_id", "_of")
    t = t.join(low, t["conv_id"] == low["_of"]).withColumn("place", F.coalesce(F.col("turn") - F.col("low"), F.lit(0).cast("long")))
    one = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    parts = t.groupBy("conv_id", F.expr(f"place div {part}").alias("part"), "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text", one.alias("one")))).alias("rows")
    )
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("rows", lambda r: r["one"]), "").alias("chat"))


#: The same in DuckDB SQL, for conversations without nulls or shared turns.
ORACLE = f"""
WITH t AS (SELECT *, turn - min(turn) OVER (PARTITION BY conv_id) AS place FROM conversations),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(place || chr(31) || role || chr(31) || text, chr(30) ORDER BY place) || chr(30) AS s FROM t GROUP BY conv_id),
kept AS (
  SELECT min(a.conv_id) AS conv_id, any_value(a.n_turns) AS n_turns, count(*) AS n_copies FROM whole a
  WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.n_turns > a.n_turns AND starts_with(b.s, a.s)) GROUP BY a.s)
SELECT conv_id, place // {PART} AS part, n_turns, n_copies,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS chat
FROM t JOIN kept USING (conv_id) GROUP BY ALL
"""
