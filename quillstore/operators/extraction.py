"""What becomes of extracted candidates: two passes merged, types checked, slugs that exist skipped, likely duplicates marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import held
from .ranking import tokens
from .topk import OPERATORS, Postings, search_top

# Words that tell a text's type, in order; types that extraction may make; the rank of a likely duplicate.
TYPE_WORDS = (
    ("decided|decision|chose|use|adopt|selected", "decision"), ("must|never|always|constraint|forbidden|required|do not|shall not", "constraint"),
    ("question|unknown|unclear|open|unresolved|why|how do", "open_question"), ("believe|think|assume|probably|should be|might be", "belief"),
)
EXTRACTED = ("fact", "decision", "preference", "belief", "open_question")
DUPLICATE, LOOKED_AT, SLUG = 2.0, 200, 40


def inferred_type(text: str) -> Column:
    out = F.lit("fact")
    for words, kind in reversed(TYPE_WORDS):
        out = F.when(F.col(text).rlike(f"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"), kind).otherwise(out)
    return out


def slug(text: str) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, SLUG)


def merged(candidates: DataFrame) -> DataFrame:
    """(type, slug, at, body, n): of candidates (pass, at, type, slug, body) with one type and slug the one that is written.

    The second pass's last stands in the place of the first pass's last, and of what then stands there the first is
    written, as the others find its slug taken. n: how many stand there.
    """
    first = F.count_if(F.col("pass") == 1)
    own, more = [F.when(F.col("pass") == p, F.struct("at", "body")) for p in (1, 2)]
    rows = candidates.groupBy("type", "slug").agg(first.alias("m"), F.min_by(own, F.when(F.col("pass") == 1, F.col("at"))).alias("own"), F.max_by(more, F.when(F.col("pass") == 2, F.col("at"))).alias("more"))
    x = F.when(F.col("m") >= 2, F.col("own")).otherwise(F.coalesce("more", "own"))
    return rows.select("type", "slug", x.alias("x"), F.greatest("m", F.lit(1)).alias("n")).select("type", "slug", "x.at", "x.body", "n")


def reconciled(candidates: DataFrame, existing: DataFrame, index: Postings) -> DataFrame:
    """(type, slug, at, status, written, skipped, duplicate_of) for each type and slug of candidates.

    existing: (type, slug) of the store. a body's first characters are searched in `index`; a best hit
    beyond DUPLICATE marks the candidate as a likely duplicate, but it is written all the same.
    """
    rows = held(merged(candidates).join(existing.select("type", "slug").distinct().withColumn("taken", F.lit(True)), ["type", "slug"], "left"), "candidates")
    good = F.col("type").isin(*EXTRACTED) & F.col("taken").isNull()
    fresh = rows.where(good).select("at", "body")
    asked = fresh.select(F.col("at").alias("q"), F.explode(F.array_distinct(tokens(F.regexp_replace(F.substring("body", 1, LOOKED_AT), OPERATORS, " ")))).alias("term"))
    best = search_top(index, asked, 1).where(F.col("score") > DUPLICATE).select(F.col("q").alias("at"), F.col("n").alias("duplicate_of"))
    status = F.when(~F.col("type").isin(*EXTRACTED), "invalid type").when(F.col("taken"), "slug exists").when(F.col("duplicate_of").isNotNull(), "possible_duplicate").otherwise("new")
    written = F.when(good, 1).otherwise(0)
    return rows.join(best, "at", "left").select("type", "slug", "at", status.alias("status"), written.alias("written"), (F.col("n") - written).alias("skipped"), "duplicate_of")
