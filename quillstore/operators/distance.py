"""Distances by shared tags: atoms that share a tag are one hop apart. Hops alternate between sets of tags and tags.

Atoms with equal tags are alike, so the search runs over distinct sets of tags. A state row says when a source first
reached a set or a tag; each half step spreads only what was reached last, and first arrivals win. A tag that all atoms
hold is one row of a source's state and spreads once, however many atoms hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\u0001"


def tag_key(tags: Column | str) -> Column:
    """A set of tags as one string; no tags: empty."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.filter(tags, lambda t: t.isNotNull()), F.array().cast("array<string>")))), SEP)


def set_hops(keys: DataFrame, sources: DataFrame, depth: int = 4) -> DataFrame:
    """(source, key, hops): the distinct sets of tags (key) that each source set (key) reaches within `depth` hops; itself at 0."""
    tagged = keys.select("key").distinct().where("key <> ''").select(F.col("key").alias("holder"), F.explode(F.split("key", SEP)).alias("tag"))
    state = sources.select(F.col("key").alias("source"), F.lit("set").alias("side"), F.col("key").alias("id"), F.lit(0).alias("hops")).distinct()
    own = F.struct("side", "id", "hops")
    item = lambda side, d, name: F.struct(F.lit(side).alias("side"), name.alias("id"), F.lit(d).alias("hops"))
    tag_at = lambda d: lambda t: item("tag", d, t)
    first = lambda rows: rows.select("source", "x.*").groupBy("source", "side", "id").agg(F.min("hops").alias("hops"))
    for d in range(depth):
        last = (F.col("side") == "set") & (F.col("hops") == d) & (F.col("id") != "")
        tags = F.transform(F.split("id", SEP), tag_at(d))
        state = first(state.select("source", F.explode(F.when(last, F.concat(F.array(own), tags)).otherwise(F.array(own))).alias("x")))
        new = (F.col("side") == "tag") & (F.col("hops") == d) & (F.col("id") == F.col("tag"))
        spread = F.when(F.col("holder").isNull(), F.array(own)).otherwise(F.array(own, item("set", d + 1, F.col("holder"))))
        state = first(state.join(tagged, new, "left").select("source", F.explode(spread).alias("x")))
    return state.where("side = 'set'").select("source", F.col("id").alias("key"), "hops")


def distance_counts(nodes: DataFrame, sources: DataFrame, depth: int = 4) -> DataFrame:
    """(source, distance, atoms): how many nodes (n, tags) each source (n) has at each distance; depth + 1: out of reach."""
    keyed = nodes.select("n", tag_key("tags").alias("key"))
    sets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("atoms"))
    from_ = keyed.join(sources.select("n"), "n", "left_semi")
    reach = set_hops(sets, from_, depth).join(sets, "key").groupBy("source", "hops").agg(F.sum("atoms").alias("atoms"))
    by = reach.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("hops", "atoms"))).alias("by"))  # depth + 1 entries at most
    at = lambda d: F.coalesce(F.element_at("by", F.lit(d)), F.lit(0))
    total, rest = nodes.count(), at(0) - 1  # others with just the source's tags
    tagged = F.col("source") != ""
    counts = [F.lit(1).cast("long"), at(1) + F.when(tagged, rest).otherwise(0), *[at(d) for d in range(2, depth + 1)]]
    away = F.lit(total) - sum(counts[1:], counts[0])
    rows = by.select("source", F.posexplode(F.array(*counts, away)).alias("distance", "atoms")).where("atoms > 0")
    return from_.join(rows, from_["key"] == rows["source"]).select(from_["n"].alias("source"), "distance", "atoms")


def pair_distances(nodes: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """pairs (a, b, ...) of nodes (n, tags) with distance: 0 for one atom, depth + 1 if out of reach."""
    keyed = nodes.select("n", tag_key("tags").alias("key"))
    end = lambda x: keyed.select(F.col("n").alias(x), F.col("key").alias(f"_{x}"))
    rows = pairs.join(end("a"), "a").join(end("b"), "b")
    hops = set_hops(keyed.select("key"), rows.select(F.col("_a").alias("key")), depth)
    found = rows.join(hops, (rows["_a"] == hops["source"]) & (rows["_b"] == hops["key"]), "left")
    alike = F.when(F.col("_a") == "", depth + 1).otherwise(1)
    distance = F.when(F.col("a") == F.col("b"), 0).when(F.col("_a") == F.col("_b"), alike).otherwise(F.coalesce("hops", F.lit(depth + 1)))
    return found.select(*pairs.columns, distance.alias("distance"))
