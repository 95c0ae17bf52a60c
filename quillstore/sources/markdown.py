"""Chunks of Markdown files: sections under headings, else bullets, else the whole, each of at least twenty characters.

Lines are rows; what section or bullet a line belongs to is a running count of the lines that begin one, so a file of any
length is worked on by ordered windows and no line state is kept in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What begins a section, a bullet, and goes on with a bullet; the least length of a chunk.
HEADING, BULLET, INDENT, LEAST = r"^#{2,3}\s+([^\r]+)$", r"^[-*]\s+([^\r]*)", r"^\s{2,}", 20


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _joined(lines: str, by: str) -> Column:
    """The lines of a group (i, line), in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(lines).alias("x")))), lambda r: r["x"]), by)


def chunks(files: DataFrame) -> DataFrame:
    """(file, start, heading, body): chunks of files (file, text), at the line (from 0) where they begin.

    Files with a heading of level two or three give their sections; what stands before the first is left out. Files with
    none give their bullets with their indented lines, and files without bullets that are long enough are one chunk.
    """
    rows = files.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    upto = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    is_heading, is_bullet = F.col("line").rlike(HEADING), F.col("line").rlike(BULLET)
    starts = is_bullet | ~F.col("line").rlike(INDENT)  # a line that does not go on with the bullet before
    rows = rows.select("file", "i", "line", is_heading.alias("h"), is_bullet.alias("b"), starts.alias("s"))
    rows = rows.withColumn("section", F.sum(F.col("h").cast("int")).over(upto)).withColumn("item", F.sum(F.col("s").cast("int")).over(upto))
    rows = rows.withColumn("headings", F.sum(F.col("h").cast("int")).over(Window.partitionBy("file")))
    of = F.when(F.col("headings") > 0, F.col("section")).otherwise(F.col("item"))
    head = F.when(F.col("h"), trimmed(F.regexp_extract("line", HEADING, 1)))
    first = F.regexp_extract("line", BULLET, 1)
    part = F.when(F.col("headings") > 0, F.when(~F.col("h"), F.col("line"))).when(F.col("b"), first).otherwise(trimmed("line"))
    rows = rows.select("file", "i", "headings", of.alias("of"), head.alias("head"), "b", part.alias("part")).where("headings = 0 or of > 0")
    groups = rows.groupBy("file", "headings", "of").agg(
        F.min("i").alias("start"), F.max("head").alias("heading"), F.min_by("b", "i").alias("bullet"), F.min_by("part", "i").alias("first"),
        _joined("part", "\n").alias("section"), _joined("part", " ").alias("item"),
    )
    text = trimmed(F.when(F.col("headings") > 0, F.col("section")).otherwise(F.col("item")))
    kept = groups.where("headings > 0 or (bullet and first <> '')").select("file", "start", "heading", text.alias("body"))
    kept = kept.where(F.length("body") >= LEAST)
    plain = rows.where("headings = 0").select("file").distinct().join(kept.select("file").distinct(), "file", "left_anti")
    whole = files.join(plain, "file", "left_semi").select("file", F.lit(0).alias("start"), F.lit(None).cast("string").alias("heading"), trimmed(F.coalesce("text", F.lit(""))).alias("body"))
    return kept.unionByName(whole.where(F.length("body") >= LEAST))
