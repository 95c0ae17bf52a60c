"""Retrieval: postings, BM25, the score's factors, the neighbour boost, budgets and diversity.

Everything is keyed by query_id, so a batch of queries is one plan. Frames of queries and dimensions are tiny and
literal; postings are filtered to the queries' terms before anything is grouped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemming import stems_of
from ..sources import schema as sc
from ..sources.scratch import held, small
from .diversity import mmr  # noqa: F401

K1, B = 1.2, 0.75
TOKEN = "[\\p{L}\\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def title(body: str = "body") -> Column:
    """The first line with text, at most 80 characters."""
    return F.coalesce(F.substring(F.trim(F.get(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), 0)), 1, 80), F.lit(""))


def documents_terms(atoms: DataFrame) -> DataFrame:
    """(n, words): the terms of title and body, in order."""
    return atoms.select("n", tokens(F.concat(title(), F.lit(" "), F.coalesce("body", F.lit("")))).alias("words"))


def query_terms(spark, texts: dict[str, str]) -> DataFrame:
    """(query_id, term, n_terms) of query texts."""
    rows = [(q, t) for q, text in texts.items() for t in dict.fromkeys(text.lower().split())]
    counts = pd.Series([q for q, _ in rows]).value_counts()
    return spark.createDataFrame([(q, t, int(counts[q])) for q, t in rows], "query_id string, term string, n_terms int")


def asked_words(words: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """(n, dl, hits): every document's length and those of its words that `keep` takes. Held, so that texts are read once."""
    return held(words.select("n", F.size("words").alias("dl"), F.filter("words", keep).alias("hits")), "asked-words")


def _size(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.avg("dl").alias("mean"))


def bm25(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, n, term, tf, df, total, part): BM25 parts, one row for each matched term.

    The corpus's size and mean length are one row; only postings of query terms are kept, counted in place per document.
    """
    wanted = [r[0] for r in terms.select("term").distinct().collect()]  # the queries' own words
    return _bm25_asked(asked_words(words, lambda w: w.isin(*wanted)), terms)


def _bm25_asked(rows: DataFrame, terms: DataFrame) -> DataFrame:
    tf = rows.select("n", "dl", F.explode("hits").alias("term")).groupBy("n", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return bm25_parts(tf, _size(rows), terms)


def bm25_parts(tf: DataFrame, size: DataFrame, terms: DataFrame) -> DataFrame:
    """As bm25, from the queries' postings (n, dl, term, tf) and the corpus's size (total, mean; one row)."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(size)).join(F.broadcast(terms), "term")  # terms: the queries' words; size: one row
    idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return rows.withColumn("part", part)


def search_index(index, terms: DataFrame) -> DataFrame:
    """As bm25, from a SegmentedIndex: only the buckets of the queries' terms are read."""
    total, mean = index.size()
    size = terms.sparkSession.createDataFrame([(total, mean)], "total long, mean double")
    return bm25_parts(index.postings([r[0] for r in terms.select("term").distinct().collect()]), size, terms)


def bm25_stemmed(words: DataFrame, terms: DataFrame) -> DataFrame:
    """As bm25, over Porter stems: terms of documents and queries match if their stems do.

    Distinct terms are stemmed once each; those with a query's stem, and no others, meet the documents' words. A stem differs
    from the beginning of its term in its last two letters at most (biliti, ble), so words that begin otherwise are left out first.
    """
    asked = held(stems_of(terms).join(terms, "term").groupBy("query_id", "stem").agg(F.lit(1).alias("one")), "stemmed-queries")
    begins = sorted({r[0][: max(1, len(r[0]) - 2)] for r in asked.select("stem").distinct().collect() if r[0]})  # the queries' own stems
    rows = asked_words(words, lambda w: reduce(lambda a, b: a | b, [w.startswith(x) for x in begins], F.lit(False)))
    vocabulary = stems_of(rows.select(F.explode("hits").alias("term")))
    wanted = small(held(vocabulary.join(F.broadcast(asked.select("stem").distinct()), "stem"), "stems"))  # the queries' own stems
    hits = rows.select("n", "dl", F.explode("hits").alias("term")).join(wanted, "term")
    tf = hits.groupBy("n", "dl", F.col("stem").alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    each = asked.select("query_id", F.col("stem").alias("term"), F.count(F.lit(1)).over(Window.partitionBy("query_id")).cast("int").alias("n_terms"))
    return bm25_parts(tf, _size(rows), each)


def signals(words: DataFrame, terms: DataFrame, *, damping: float = 1.0, power: float = sc.COVERAGE_POWER) -> DataFrame:
    """(query_id, n, bm25, fts, specificity, coverage) of every hit.

    fts is min-max normalised over all hits of the query, specificity the damped share of matched idf, coverage a power
    of the share of matched terms; the latter two are off for queries of one term.
    """
    wanted = [r[0] for r in terms.select("term").distinct().collect()]  # the queries' own words
    asked = asked_words(words, lambda w: w.isin(*wanted))
    parts = _bm25_asked(asked, terms)
    idf = F.log(1 + F.col("total") / F.col("df"))
    hits = parts.groupBy("query_id", "n", "n_terms").agg(F.sum("part").alias("bm25"), F.sum(idf).alias("matched"), F.count(F.lit(1)).alias("k"))
    known = parts.select("query_id", "term", "df", "total").distinct()
    size = asked.agg(F.count(F.lit(1)).alias("size"))
    all_ = terms.join(known, ["query_id", "term"], "left").crossJoin(F.broadcast(size)).groupBy("query_id").agg(
        F.sum(F.log(1 + F.col("size") / F.coalesce("df", F.lit(1)))).alias("idf_all")
    )
    spread = hits.groupBy("query_id").agg(F.min("bm25").alias("low"), F.max("bm25").alias("high"))
    rows = hits.join(F.broadcast(all_), "query_id").join(F.broadcast(spread), "query_id")  # a row for each query
    many = F.col("n_terms") > 1
    return rows.select(
        "query_id", "n", "bm25", F.when(F.col("high") > F.col("low"), (F.col("bm25") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0).alias("fts"),
        F.when(many, 1 - damping * (1 - F.col("matched") / F.col("idf_all"))).otherwise(1.0).alias("specificity"),
        F.when(many, F.pow(F.col("k") / F.col("n_terms"), power)).otherwise(1.0).alias("coverage"),
    )


def word_count(body: str = "body") -> Column:
    return F.size(F.filter(F.split(body, "\\s+"), lambda x: x != ""))


def length_factors(atoms: DataFrame, k: float = sc.LENGTH_K) -> DataFrame:
    """(n, words, length): 1 up to the mean word count of the rows, falling beyond it. Rows have their count as `words`, or a body."""
    rows = atoms.select("n", "words") if "words" in atoms.columns else atoms.select("n", word_count().alias("words"))
    ratio = F.col("words") / F.col("mean")
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("words").alias("mean")))).select("n", "words", F.when(ratio > 1, 1 / (1 + k * (ratio - 1))).otherwise(1.0).alias("length"))


def weight(table: dict, column: str = "type", default: float = 1.0) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col(column) == k, float(v)).otherwise(out)
    return out


def score(pool: DataFrame, age: Column, *, decay_weight: float = 0.2, half_life: float = sc.DECAY_HALF_LIFE) -> DataFrame:
    """pool with recency and score. pool: fts, specificity, length, coverage, confidence, type."""
    recency = F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life)
    relevance = F.col("fts") * F.col("specificity") * F.col("length") * F.col("coverage")
    base = relevance * (1 - decay_weight) + recency * decay_weight
    confidence = sc.CONFIDENCE_FLOOR + (1 - sc.CONFIDENCE_FLOOR) * F.col("confidence")
    return pool.withColumn("recency", recency).withColumn("score", base * weight(sc.TYPE_WEIGHTS) * confidence)


def neighbour_boost(scores: DataFrame, edges: DataFrame, boost: float = sc.NEIGHBOUR_BOOST) -> DataFrame:
    """scores (query_id, n, score) with boosted: what neighbours give, with diminishing returns, in edge order.

    Each edge gives source to target, then target to source. The fold runs over one atom's own edges.
    """
    give = lambda a, b, side: edges.select(F.col(a).alias("giver"), F.col(b).alias("taker"), F.struct("src", "tgt", "rel", F.lit(side).alias("side")).alias("ord"))
    both = give("src", "tgt", 0).unionByName(give("tgt", "src", 1))
    gifts = both.join(scores.where("score > 0").select("query_id", F.col("n").alias("giver"), F.col("score").alias("s")), "giver")
    folded = gifts.groupBy("query_id", F.col("taker").alias("n")).agg(F.array_sort(F.collect_list(F.struct("ord", "s"))).alias("g"))
    added = F.aggregate("g", F.lit(0.0), lambda acc, x: acc + x["s"] * boost / (1 + acc))
    return scores.join(folded.select("query_id", "n", added.alias("added")), ["query_id", "n"], "left").withColumn("boosted", F.col("score") + F.coalesce("added", F.lit(0.0)))


def _within(ranked: DataFrame, most, *by: str) -> DataFrame:
    """ranked without rows that no fill can take: a gap only shrinks, so of rows of one size the first `most` tokens' worth count."""
    w = Window.partitionBy("query_id", *by, "tokens").orderBy("rank")
    return ranked.where("tokens > 0").withColumn("_k", F.row_number().over(w)).where(F.col("_k") * F.col("tokens") <= most).drop("_k")


def greedy_fill(ranked: DataFrame, budget: int) -> DataFrame:
    """(query_id, n): rows of (query_id, rank, n, tokens) that fit a token budget, in rank order; rows too large are skipped.

    Rows without tokens always fit. Of the others some budget * ln(budget) at most can matter, whatever the ranking's length.
    """
    return reserved_fill(ranked.withColumn("type", F.lit("")), budget, {}).select("query_id", "n")


def unfilled(order: DataFrame, left: DataFrame, budget: int) -> set[str]:
    """The queries for which it matters how `order` (query_id, rank, n, tokens) goes on: of the rows `left` (query_id, tokens) some fit
    a greedy fill, but not all that fit alone fit together. With the others, what is left adds the same in any order."""
    used = greedy_fill(order, budget).join(order, ["query_id", "n"]).groupBy("query_id").agg(F.sum("tokens").alias("used"))
    fits = left.join(F.broadcast(used), "query_id", "left").withColumn("gap", budget - F.coalesce("used", F.lit(0))).where("tokens <= gap")  # a row for each query
    open_ = fits.groupBy("query_id").agg(F.sum("tokens").alias("together"), F.first("gap").alias("gap")).where("together > gap")
    return {r.query_id for r in open_.select("query_id").collect()}  # a row for each query


def filled(order: DataFrame, left: DataFrame, budget: int) -> bool:
    """Whether what is left adds the same in any order, for all queries."""
    return not unfilled(order, left, budget)


def _fill(rows: pd.DataFrame, budget: int, quotas: dict[str, int]) -> pd.DataFrame:
    """(query_id, n, own): a query's rows that its quotas and then the rest of the budget take, in one pass each."""
    rows = rows.sort_values(["rank", "n", "tokens"])
    gaps, kept, left = dict(quotas), [], []
    for n, kind, tokens in zip(rows.n.to_list(), rows.type.to_list(), rows.tokens.to_list()):
        if tokens <= gaps.get(kind, -1):
            gaps[kind] -= tokens
            kept.append((n, True))
        else:
            left.append((n, tokens))
    gap = budget - sum(quotas.values()) + sum(gaps.values())
    for n, tokens in left:
        if tokens <= gap:
            gap -= tokens
            kept.append((n, False))
    return pd.DataFrame({"query_id": rows.query_id.iloc[0], "n": [n for n, _ in kept], "own": [o for _, o in kept]}).astype({"n": "int64", "own": "bool"})


def reserved_fill(ranked: DataFrame, budget: int, reservations: dict[str, int] = sc.RESERVATIONS, share: float = 0.3) -> DataFrame:
    """(query_id, n, own): rows of (query_id, rank from 0 or 1, n, type, tokens) within a budget of which types have quotas.

    Quotas are scaled to `share` of the budget. First each type fills its quota in rank order, then all other rows the
    rest; rows too large are skipped. own: the row is in its type's quota.
    """
    raw = sum(reservations.values())
    scale = min(1.0, int(budget * share) / raw) if raw else 1.0
    quotas = {k: int(v * scale) for k, v in reservations.items() if int(v * scale) > 0}
    # it asks for the rank, so that both branches share one exchange of the ranking
    free = ranked.where("tokens = 0 and rank >= 0").select("query_id", "n", F.col("type").isin(*quotas).alias("own") if quotas else F.lit(False).alias("own"))
    rows = _within(ranked, budget + max(quotas.values(), default=0), "type").select("query_id", F.col("rank").cast("long").alias("rank"), F.col("n").cast("long").alias("n"), "type", F.col("tokens").cast("long").alias("tokens"))
    # a query's rows that can matter, which the budget bounds
    taken = rows.groupBy("query_id").applyInPandas(lambda d: _fill(d, budget, quotas), "query_id string, n long, own boolean")
    return taken.unionByName(free)


#: Rows of a block of vectors, and of a block of query vectors: what one group of a block join holds.
VECTOR_BLOCK, QUERY_BLOCK = 20_000, 1000


def knn(vectors: DataFrame, queries: DataFrame, k: int | None = 20, least: float = 0.3) -> DataFrame:
    """(query_id, n, similarity): the k nearest unit vectors (n, v) of each query vector (query_id, q), by matrix products;
    without k, all at `least` or more.

    Vectors and queries are dealt to blocks, and each pair of blocks is a bounded group of its own, whose k best for each
    query go on. Neither side is collected or broadcast.
    """
    import numpy as np

    # both sides' keys are of one type: a cogroup deals an int and a long of one value to different tasks
    spread = lambda d, key, size: (d.withColumn("_of", F.pmod(F.xxhash64(key), F.lit(size)).cast("int")), size)
    v, n_v = spread(vectors, "n", max(1, -(-vectors.count() // VECTOR_BLOCK)))
    q, n_q = spread(queries.toDF("query_id", "q"), "query_id", max(1, -(-queries.count() // QUERY_BLOCK)))
    v = v.select(F.col("_of").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), "n", F.col("v").cast("array<double>").alias("v"))
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"), F.col("_of").alias("qb"), "query_id", F.col("q").cast("array<double>").alias("q"))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype=object), "n": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})]
        if len(left) and len(right):
            a, b, n = unit(np.array(left.v.tolist(), float)), unit(np.array(right.q.tolist(), float)), left.n.to_numpy()
            for at in range(0, len(b), 100):
                s = np.round(a @ b[at : at + 100].T, 6)
                for j, name in enumerate(right.query_id[at : at + 100]):
                    keep = np.lexsort((n, -s[:, j]))[:k]
                    keep = keep[s[keep, j] >= least]
                    out.append(pd.DataFrame({"query_id": name, "n": n[keep], "similarity": s[keep, j]}))
        return pd.concat(out[1:] or out)

    best = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(each, "query_id string, n long, similarity double")
    if k is None:
        return best
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "n")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
