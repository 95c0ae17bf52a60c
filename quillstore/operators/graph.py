"""Graph operators: neighbour types, spreading activation, bounded search, arcs. Steps are joins; of a step only its bounded frontier reaches the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import RELATION_WEIGHTS
from ..sources.scratch import held
from .distance import SEP, tag_key
from .ranking import weight


def both_ways(edges: DataFrame) -> DataFrame:
    """(n, m, rel): every edge from either end."""
    return edges.select(F.col("src").alias("n"), F.col("tgt").alias("m"), "rel").unionByName(edges.select(F.col("tgt").alias("n"), F.col("src").alias("m"), "rel"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(n, m, rel, w): each pair once per direction, by its strongest relation."""
    rows = both_ways(edges).withColumn("w", weight(RELATION_WEIGHTS, "rel", 0.3))
    return rows.groupBy("n", "m").agg(F.max(F.struct("w", "rel")).alias("x")).select("n", "m", "x.rel", "x.w")


def base_activation(age_days: Column, cited: Column) -> Column:
    return F.log(cited + 1) - 0.5 * F.log(F.greatest(age_days, F.lit(0.01)))


def spread(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, steps=3, threshold=0.05, top=20, decay=0.5, relation_weight=2.0) -> DataFrame:
    """(n, act): activation after `steps` rounds. nodes: (n, tags, base); seeds: (n).

    Tags spread by group: what a tag's active holders give is summed per tag, shared out, and one's own part taken back,
    so a tag that all nodes hold costs two grouped joins and no pairs. Each round keeps `top` rows, which bounds the
    frontier that the next round broadcasts.
    """
    spark = nodes.sparkSession
    nodes = nodes.cache()
    boost = 1 / F.sqrt(1 + F.exp(-F.col("base")))
    tagged = nodes.select("n", F.explode("tags").alias("tag"), F.size("tags").alias("k"))
    holders = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("holders"))
    near = neighbours(edges).where("n <> m").cache()
    degree = near.groupBy("n").agg(F.count(F.lit(1)).alias("degree"))
    active = [(r[0], 1.0) for r in seeds.select("n").collect()]
    for _ in range(steps):
        # the frontier is `top` rows at most: as literal rows it keeps each step's plan short
        front = F.broadcast(spark.createDataFrame(active, "n long, act double"))
        own = tagged.join(front, "n").join(holders, "tag").withColumn("gift", F.col("act") * decay / F.col("k") / F.col("holders"))
        per_tag = own.groupBy("tag").agg(F.sum("gift").alias("gift"))
        by_tag = tagged.join(F.broadcast(per_tag), "tag").groupBy("n").agg(F.sum("gift").alias("got"))
        back = own.groupBy("n").agg(F.sum("gift").alias("own"))
        by_tag = by_tag.join(F.broadcast(back), "n", "left").select("n", (F.col("got") - F.coalesce("own", F.lit(0.0))).alias("got"))
        by_edge = near.join(front, "n").join(degree, "n").groupBy(F.col("m").alias("n")).agg(F.sum(F.col("act") * decay * relation_weight * F.col("w") / F.col("degree")).alias("got"))
        got = by_tag.unionByName(by_edge).groupBy("n").agg(F.sum("got").alias("got"))
        new = nodes.select("n", "base").join(got, "n", "left").join(front, "n", "left")
        new = new.select("n", F.round(F.coalesce(F.col("act") * (1 - decay * 0.5), F.lit(0.0)) + F.coalesce(F.col("got") * boost, F.lit(0.0)), 9).alias("act"))
        best = new.where("act > 0").orderBy(F.desc("act"), "n").limit(top).collect()
        active = [(r.n, r.act) for r in best if r.act >= threshold]
    nodes.unpersist()
    near.unpersist()
    return spark.createDataFrame(active, "n long, act double")


def walks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, steps=3, threshold=0.05, top=20, decay=0.5, relation_weight=2.0) -> DataFrame:
    """(walk, n, act): spread() for many seed sets (walk, n) at once. nodes: (n, tags, base).

    What tags give is the same for all atoms with equal tags, so it is added up by set of tags; of a set's atoms only the
    2 * top best boosted ones can enter a walk's frontier, beside those that are active or at an edge. So a step's rows are
    walks times sets of tags, not times atoms, and each step ends in a window of a walk's rows.
    """
    keyed = nodes.select("n", tag_key("tags").alias("key"), (1 / F.sqrt(1 + F.exp(-F.col("base")))).alias("boost"))
    keyed = held(keyed.withColumn("k", F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", SEP)))), "walk-nodes")
    best = Window.partitionBy("key").orderBy(F.desc("boost"), "n")
    heads = held(keyed.where("k > 0").withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * top).select("n", "key", "boost"), "walk-heads")
    sets = held(keyed.where("k > 0").groupBy("key").agg(F.count(F.lit(1)).alias("atoms")).withColumn("tag", F.explode(F.split("key", SEP))), "walk-sets")
    holders = sets.groupBy("tag").agg(F.sum("atoms").alias("holders"))
    near = neighbours(edges).where("n <> m")
    near = held(near.join(near.groupBy("n").agg(F.count(F.lit(1)).alias("degree")), "n"), "walk-edges")
    state = held(seeds.select("walk", "n").distinct().join(keyed.select("n"), "n", "left_semi").select("walk", "n", F.lit(1.0).alias("act")), "walk")
    for _ in range(steps):
        own = state.join(keyed, "n").where("k > 0").withColumn("tag", F.explode(F.split("key", SEP))).join(holders, "tag")
        own = own.select("walk", "n", "tag", (F.col("act") * decay / F.col("k") / F.col("holders")).alias("gift"))
        by_set = own.groupBy("walk", "tag").agg(F.sum("gift").alias("gift")).join(sets.select("key", "tag"), "tag").groupBy("walk", "key").agg(F.sum("gift").alias("got"))
        back = own.groupBy("walk", "n").agg((-F.sum("gift")).alias("part"))
        at_edge = state.join(near, "n").select("walk", F.col("m").alias("n"), (F.col("act") * decay * relation_weight * F.col("w") / F.col("degree")).alias("part")).groupBy("walk", "n").agg(F.sum("part").alias("part"))
        some = state.select("walk", "n").unionByName(at_edge.select("walk", "n")).distinct().join(keyed.select("n", "key", "boost"), "n")
        rows = by_set.join(heads, "key").select("walk", "n", "boost", "got").unionByName(some.join(by_set, ["walk", "key"], "left").select("walk", "n", "boost", "got"))
        rows = rows.groupBy("walk", "n").agg(F.first("boost").alias("boost"), F.max(F.coalesce("got", F.lit(0.0))).alias("got"))
        more = back.unionByName(at_edge).groupBy("walk", "n").agg(F.sum("part").alias("part"))
        rows = rows.join(more, ["walk", "n"], "left").join(state, ["walk", "n"], "left")
        gain = (F.col("got") + F.coalesce("part", F.lit(0.0))) * F.col("boost")
        rows = rows.select("walk", "n", F.round(F.coalesce(F.col("act") * (1 - decay * 0.5), F.lit(0.0)) + gain, 9).alias("act")).where("act > 0")
        first = Window.partitionBy("walk").orderBy(F.desc("act"), "n")
        rows = rows.withColumn("r", F.row_number().over(first)).where((F.col("r") <= top) & (F.col("act") >= threshold))
        state = held(rows.select("walk", "n", "act"), "walk")
    return state


def hops(edges: DataFrame, sources: DataFrame, depth: int = 4) -> DataFrame:
    """(source, n, hops): shortest distance from each source, up to `depth`, by frontier joins."""
    near = both_ways(edges).select("n", "m").distinct()
    seen = sources.select(F.col("n").alias("source"), "n", F.lit(0).alias("hops"))
    layers = [seen]
    for d in range(1, depth + 1):
        new = layers[-1].join(near, "n").select("source", F.col("m").alias("n")).distinct()
        new = new.join(reduce(DataFrame.unionByName, layers).select("source", "n"), ["source", "n"], "left_anti")
        layers.append(new.withColumn("hops", F.lit(d)))
    return reduce(DataFrame.unionByName, layers)
