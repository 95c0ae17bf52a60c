"""Forests of any depth by pointer doubling: depth, root, size of each subtree, place in depth-first order, cycles.

After round k a node points to its ancestor 2**k levels up, so some log2(depth) rounds of equal joins do. Sizes of
subtrees grow with the same pointers. A node comes, in depth-first order, after its parent and the subtrees of its
earlier siblings; sums of that along its ancestors give its place, so no path is ever written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import held
from .orders import sums_before


def forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, parent, root, depth, size): nodes (n) under their parents by edges (child, parent).

    A parent that is no node makes its child a root. Of several parents the smallest counts. Nodes on a cycle, or below
    one, have no root: root and depth are null.
    """
    known = nodes.select("n").distinct()
    up = edges.join(known.withColumnRenamed("n", "child"), "child", "left_semi").join(known.withColumnRenamed("n", "parent"), "parent", "left_semi")
    up = up.groupBy(F.col("child").alias("n")).agg(F.min("parent").alias("parent"))
    far = F.coalesce("parent", "n")
    state = known.join(up, "n", "left").select("n", "parent", F.col("parent").alias("jump"), far.alias("last"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"))
    state, before = held(state, "forest"), -1
    while (open_ := state.where("jump is not null").count()) not in (0, before):  # as long as it falls; what is left is cyclic
        before = open_
        ahead = state.select(F.col("n").alias("jump"), F.col("jump").alias("_jump"), F.col("last").alias("_last"), F.col("depth").alias("_depth"))
        below = state.where("jump is not null").groupBy(F.col("jump").alias("n")).agg(F.sum("size").alias("_size"))
        state = held(
            state.join(ahead, "jump", "left").join(below, "n", "left").select(
                "n", "parent", F.col("_jump").alias("jump"), F.coalesce("_last", "last").alias("last"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
            ), "forest",
        )
    sound = F.col("jump").isNull()
    return state.select("n", "parent", F.when(sound, F.col("last")).alias("root"), F.when(sound, F.col("depth")).alias("depth"), F.when(sound, F.col("size")).alias("size"))


def depth_first(trees: DataFrame, order: list[str]) -> DataFrame:
    """trees with position: a node's place in its root's depth-first order, from 0, siblings by `order`, which has no ties.

    trees: (n, parent, root, depth, size, and the columns of `order`), as forest() gives them, without cyclic nodes.
    """
    ranked = sums_before(trees.where("parent is not null"), ["parent"], order, F.col("size"), "_skip")
    step = ranked.select("n", (F.col("_skip") + 1).alias("position"), F.col("parent").alias("jump"))
    roots = trees.where("parent is null").select("n", F.lit(0).cast("long").alias("position"), F.lit(None).cast(trees.schema["n"].dataType).alias("jump"))
    state = held(step.unionByName(roots), "forest-order")
    while state.where("jump is not null").limit(1).count():
        ahead = state.select(F.col("n").alias("jump"), F.col("jump").alias("_jump"), F.col("position").alias("_position"))
        state = held(state.join(ahead, "jump", "left").select("n", (F.col("position") + F.coalesce("_position", F.lit(0))).alias("position"), F.col("_jump").alias("jump")), "forest-order")
    return trees.join(state.select("n", "position"), "n")


def arcs(nodes: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """(n, root, depth, position): nodes (n, and the columns of `order`) in trees of two or more; others alone, with nulls.

    position is the place in the depth-first walk of a tree, children by `order`.
    """
    rows = nodes.select("n", *[c for c in order if c != "n"])
    trees = held(forest(nodes, edges).join(rows, "n"), "forest-trees")
    big = trees.where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("root")
    walked = depth_first(trees.join(big, "root", "left_semi"), order).select("n", "root", "depth", "position")
    alone = trees.join(walked.select("n"), "n", "left_anti")
    return walked.unionByName(alone.select("n", *[F.lit(None).cast(walked.schema[c].dataType).alias(c) for c in ("root", "depth", "position")]))
