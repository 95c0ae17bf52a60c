"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are words. Targets share the total size by weight, capped at `max_repeat` times a source's size (water filling).
Blocks of `block` words, one size for all sources, are apportioned to sources by highest quotients v / (2s + 1), then,
within a source, to its shards. A shard is a stream of documents in seeded order. Its quota in words decides how often it
is taken whole; what is left is a run of blocks from a seeded block on, over the stream's end to its beginning if need be.
The stream's order is seeded, so a run is a sample like any other, and it cuts two or three documents only. It is counted in
words, so the short block at the end of a stream counts as what it is. A document's taken words follow from its place in the
stream, and no block is ever a row. Everything is DataFrame operations. A source comes within about a block of its target.

Nulls: a null text has size 0; a null source is a source, last in order; a null doc_id is kept. Empty input: no rows.
Equal rows are separate documents. plan_mix reads the named columns only; mix_documents carries each row as one struct, so
further columns never clash, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, n_words, same, small, written

#: Words a shard aims at; a shard is what one window task sorts.
SHARD_WORDS = 2_000_000


def _seats(parties: DataFrame, by: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Add `out`: the seats of each row, apportioned by highest Sainte-Laguë quotients among the rows of one `by`.

    With n parties and q = seats * votes / total, the final seats lie within q * n / (2 * seats) + 1 of q, so only that
    stretch of quotients is ranked: O(n) rows altogether, however many seats there are.
    """
    group = Window.partitionBy(*by)
    near = (
        parties.withColumn("_total", F.sum(votes).over(group))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_q", F.when(F.col("_total") > 0, F.col(seats) * F.col(votes) / F.col("_total")).otherwise(F.lit(0.0)))
        .withColumn("_slack", F.when(F.col(seats) > 0, F.col("_q") * F.col("_n") / (2.0 * F.col(seats))).otherwise(F.lit(0.0)) + 1)
        .withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_q") - F.col("_slack"))).cast("long"))
        .withColumn("_hi", F.when(F.col(votes) > 0, F.ceil(F.col("_q") + F.col("_slack"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_lo").over(group))
    )
    keys = [c for c in parties.columns if c not in (votes, seats)]
    ranked = near.withColumn("_s", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.col("_hi") - 1)))).withColumn(
        "_rank", F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_s") + 1)).desc_nulls_last(), F.col("_order"), F.col("_s")))
    )
    won = F.sum(F.when(F.col("_s").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    return ranked.groupBy(*keys, votes, seats).agg((F.first("_lo") + won).cast("long").alias(out))


def plan_mix(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", weights=(1, 2, 3), max_repeat=3, seed=42, block=16) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and how it was chosen.

    row_hash (of doc_id and text) finds the document again, whose words are start, start + 1, ... of its shard's stream. full
    is how often the whole document is taken; beyond that, its words in lo..hi - 1 and in 0..wrap - 1 of the stream are.
    """
    sized = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            n_words(text).alias("size"),
            F.xxhash64(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("row_hash"),
        ),
        "mix-sized",
    )
    one = Window.partitionBy()  # over sources, not documents
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.col("rank") - 1) % len(weights)) + 1).cast("int"))
    per = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * float(max_repeat))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    before = one.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = one.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = (
        per.withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(one)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")))
        .withColumn("_order", F.col("rank"))
        .withColumn("_all", F.lit(0))
        .withColumn("all_blocks", F.round(F.sum("target").over(one) / block).cast("long"))
        .select("source", "source_size", "rank", "_order", "_all", "target", "all_blocks")
    )
    quota = _seats(per, ["_all"], "target", "all_blocks", "source_blocks").withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long")
    )
    quota = written(quota.select("source", "source_size", "rank", "target", "source_blocks", "shards"), "mix-sources")
    q = small(quota)
    placed = sized.join(q, same(sized, q, "source"), "inner").drop(quota["source"]).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), "row_hash"), F.col("shards"))
    )
    shards = placed.groupBy("rank", "shard", "source_blocks").agg(F.sum("size").alias("shard_size")).withColumn("_order", F.col("shard"))
    shards = _seats(shards, ["rank"], "shard_size", "source_blocks", "shard_blocks")
    words, size = F.least(F.col("shard_blocks") * block, F.col("shard_size") * max_repeat), F.greatest(F.col("shard_size"), F.lit(1))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), F.ceil(size / block)) * block
    shards = shards.withColumn("full", F.floor(words / size).cast("long")).withColumn("lo", first).withColumn("end", F.col("lo") + words % size)
    shards = shards.select("rank", "shard", "full", "lo", F.least("end", "shard_size").alias("hi"), F.greatest(F.col("end") - F.col("shard_size"), F.lit(0)).alias("wrap"))
    shards = small(written(shards, "mix-shards"))
    stream = Window.partitionBy("rank", "shard").orderBy("row_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    chosen = placed.withColumn("start", F.sum("size").over(stream) - F.col("size")).join(shards, ["rank", "shard"])
    to = F.col("start") + F.col("size")
    run = F.greatest(F.least(to, "hi") - F.greatest("start", "lo"), F.lit(0)) + F.greatest(F.least(to, "wrap") - F.col("start"), F.lit(0))
    return chosen.select(
        "doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + run).cast("long").alias("taken"),
        F.col("rank").alias("source_rank"), "shard", "start", "full", "lo", "hi", "wrap", "row_hash",
    )


def mix_documents(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """The mixed documents, with the columns of docs: whole copies, and the selected words of partly taken ones.

    Rows that share doc_id and text are told apart by their number only. n_chars, where there is one, is set anew.
    """
    seed = options.get("seed", 42)
    plan = written(
        plan_mix(docs, doc_id=doc_id, text=text, **options).where("taken > 0")
        .select("row_hash", "start", "full", "lo", "hi", "wrap", F.expr("taken > full * size").alias("part")),
        "mix-plan",
    )
    keyed = docs.select(F.struct("*").alias("row"), F.col(text).alias("body"), F.xxhash64(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("key"))
    repeated = small(written(plan.groupBy("row_hash").count().where("count > 1").select("row_hash"), "mix-repeated"))
    again = keyed["key"] == repeated["row_hash"]
    once = keyed.join(repeated, again, "left_anti").unionByName(keyed.join(repeated, again, "left_semi").dropDuplicates(["key"]))
    plan = small(plan)
    rows = once.join(plan, once["key"] == plan["row_hash"])
    copies = F.when(F.col("full") > 0, F.sequence(F.lit(1), F.col("full").cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("copy", F.explode(F.concat(copies, F.when(F.col("part"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))))
    # words with the white space after them, so that what is kept reads as before
    pieces = F.regexp_extract_all("body", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    kept = F.expr("array_join(filter(pieces, (p, i) -> (start + i >= lo and start + i < hi) or start + i < wrap), '')")
    rows = rows.withColumn("pieces", F.when(F.col("copy") == 0, pieces)).withColumn("body", F.when(F.col("copy") == 0, kept).otherwise(F.col("body")))
    new = {text: F.col("body")}
    if "n_chars" in docs.columns and text != "n_chars":
        new["n_chars"] = F.length("body").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
