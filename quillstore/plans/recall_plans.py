"""Recall: full-text search, scores, boosts, budgets and diversity, as batches of queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import ranking as rk
from ..operators.orders import numbered
from ..sources import schema as sc
from ..sources import tables as tb
from ..sources.scratch import held
from ..sources.tables import AS_OF, ATOMS, EDGES, EPISODES, LOG, QUERY_TEXTS
from .registry import ORACLE_SQL, query
from .store_plans import CAND, REVISED, VIS, age

_QT = "qt(query_id, term, n_terms) AS (VALUES " + ", ".join(f"('{q}', '{t}', {len(s.split())})" for q, s in QUERY_TEXTS.items() for t in s.split()) + ")"
FTS = _QT + """,
words AS (SELECT n, regexp_extract_all(lower(coalesce(left(trim(list_filter(string_split(body, chr(10)), lambda l: trim(l) <> '')[1]), 80), '') || ' ' || body), '[\\p{L}\\p{N}]+') AS words FROM vis),
size AS (SELECT count(*) AS total, avg(len(words)) AS mean FROM words),
tf AS (SELECT n, dl, term, count(*) AS tf FROM (SELECT n, len(words) AS dl, unnest(words) AS term FROM words) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT query_id, n, n_terms, term, df, total, greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part
  FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN size),
idfs AS (SELECT query_id, sum(ln(1 + total / coalesce(df, 1))) AS idf_all FROM qt LEFT JOIN df USING (term) CROSS JOIN size GROUP BY query_id),
hits AS (SELECT query_id, n, n_terms, sum(part) AS bm25, sum(ln(1 + total / df)) AS matched, count(*) AS k FROM parts GROUP BY ALL),
sig AS (SELECT query_id, n, bm25, coalesce((bm25 - min(bm25) OVER q) / nullif(max(bm25) OVER q - min(bm25) OVER q, 0), 1.0) AS fts,
  CASE WHEN n_terms > 1 THEN matched / idf_all ELSE 1.0 END AS specificity, CASE WHEN n_terms > 1 THEN pow(k / n_terms, 0.5) ELSE 1.0 END AS coverage
  FROM hits JOIN idfs USING (query_id) WINDOW q AS (PARTITION BY query_id))"""


def weight_sql(table: dict, column: str, default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


_TW = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sc.TYPE_WEIGHTS.items()) + " END"
SCORES = f"""lens0 AS (SELECT n, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS words FROM cand),
lens AS (SELECT n, words, CASE WHEN words / mean > 1 THEN 1 / (1 + 0.5 * (words / mean - 1)) ELSE 1.0 END AS length FROM lens0 CROSS JOIN (SELECT avg(words) AS mean FROM lens0)),
pool AS (SELECT s.query_id, c.n, c.type, c.status, c.confidence, c.updated_at, fts, specificity, coverage, length, pow(0.5, greatest((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400.0, 0) / 30) AS recency, body
  FROM sig s JOIN cand c USING (n) JOIN lens USING (n)),
scores AS (SELECT *, (fts * specificity * length * coverage * 0.8 + recency * 0.2) * {_TW} * (0.7 + 0.3 * confidence) AS score FROM pool)"""
BOOST = """gifts AS (
  SELECT query_id, tgt AS n, src, tgt, rel, 0 AS side, score AS s FROM edges JOIN scores ON src = n WHERE score > 0 UNION ALL
  SELECT query_id, src, src, tgt, rel, 1, score FROM edges JOIN scores ON tgt = n WHERE score > 0),
added AS (SELECT query_id, n, list_reduce(list_prepend(0.0, list(s ORDER BY src, tgt, rel, side)), lambda a, x: a + x * 0.15 / (1 + a)) AS added FROM gifts GROUP BY ALL),
final AS (SELECT s.*, score + coalesce(added, 0.0) AS boosted FROM scores s LEFT JOIN added USING (query_id, n))"""
CHAIN = (ATOMS, VIS, CAND, FTS)


def words_of(spark, sf):
    return rk.documents_terms(tb.atoms(spark, sf).where(fl.visible()))


def signals_of(spark, sf):
    return rk.signals(words_of(spark, sf), rk.query_terms(spark, QUERY_TEXTS))


def scores_of(spark, sf):
    cand = fl.candidates(tb.atoms(spark, sf)).withColumn("tokens", F.ceil(F.length("body") / 4)).withColumn("words", rk.word_count())
    cand = held(cand.drop("body"), "candidates")  # so that no body has to go further, and each is read once
    pool = signals_of(spark, sf).join(cand.drop("words"), "n").join(rk.length_factors(cand), "n")
    return rk.score(pool, age())


def final_of(spark, sf):
    s = held(scores_of(spark, sf), "scores")  # it is read on both sides
    boosted = rk.neighbour_boost(s.select("query_id", "n", "score"), tb.edges(spark, sf)).select("query_id", "n", "boosted")
    return s.join(boosted, ["query_id", "n"])


@query("R1_bm25_search", *CHAIN, sql="SELECT query_id, n, round(bm25, 6) AS bm25 FROM hits")
def r1(spark, sf):
    return signals_of(spark, sf).select("query_id", "n", F.round("bm25", 6).alias("bm25"))


@query("R1_stemmed_search")
def r1_stemmed(spark, sf):
    """R1 with words and queries reduced to their stems. SQL has no stemmer: tests hold it against a plain version."""
    hits = rk.bm25_stemmed(words_of(spark, sf), rk.query_terms(spark, QUERY_TEXTS))
    return hits.groupBy("query_id", "n").agg(F.round(F.sum("part"), 6).alias("bm25"))


ORACLE_SQL["S15_segments"] = "WITH " + ",\n".join((ATOMS, LOG, REVISED, FTS)) + "\nSELECT query_id, n, round(bm25, 6) AS bm25 FROM hits"


@query("R3_term_matches", *CHAIN, sql="SELECT query_id, term, n FROM parts")
def r3(spark, sf):
    return rk.bm25(words_of(spark, sf), rk.query_terms(spark, QUERY_TEXTS)).select("query_id", "term", "n")


@query("R4_normalised_ranks", *CHAIN, sql="SELECT query_id, n, round(fts, 6) AS fts FROM sig")
def r4(spark, sf):
    return signals_of(spark, sf).select("query_id", "n", F.round("fts", 6).alias("fts"))


@query("R5_specificity", *CHAIN, sql="SELECT query_id, n, round(specificity, 6) AS specificity FROM sig")
def r5(spark, sf):
    return signals_of(spark, sf).select("query_id", "n", F.round("specificity", 6).alias("specificity"))


@query("R6_coverage", *CHAIN, sql="SELECT query_id, n, round(coverage, 6) AS coverage FROM sig")
def r6(spark, sf):
    return signals_of(spark, sf).select("query_id", "n", F.round("coverage", 6).alias("coverage"))


@query("R7_length_factors", *CHAIN, SCORES, sql="SELECT n, words, round(length, 6) AS length FROM lens")
def r7(spark, sf):
    return rk.length_factors(fl.candidates(tb.atoms(spark, sf))).select("n", "words", F.round("length", 6).alias("length"))


@query("R9_candidate_pool", *CHAIN, EDGES, sql="""SELECT DISTINCT query_id, n FROM (SELECT query_id, n FROM sig UNION ALL SELECT query_id, tgt FROM sig JOIN edges ON src = n UNION ALL SELECT query_id, src FROM sig JOIN edges ON tgt = n) WHERE n IN (SELECT n FROM cand)""")
def r9(spark, sf):
    hits, e = signals_of(spark, sf).select("query_id", "n"), tb.edges(spark, sf)
    both = e.select(F.col("src").alias("n"), F.col("tgt").alias("m")).union(e.select("tgt", "src"))
    pool = hits.unionByName(hits.join(both, "n").select("query_id", F.col("m").alias("n"))).distinct()
    return pool.join(fl.candidates(tb.atoms(spark, sf)).select("n"), "n", "left_semi").select("query_id", "n")


@query("R10_recall_scores", *CHAIN, SCORES, sql="SELECT query_id, n, round(score, 6) AS score FROM scores")
def r10(spark, sf):
    return scores_of(spark, sf).select("query_id", "n", F.round("score", 6).alias("score"))


@query("R11_neighbour_boost", *CHAIN, EDGES, SCORES, BOOST, sql="SELECT query_id, n, round(boosted, 6) AS boosted FROM final")
def r11(spark, sf):
    return final_of(spark, sf).select("query_id", "n", F.round("boosted", 6).alias("boosted"))


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted, 9) DESC, list_position(['active', 'draft', 'accepted', 'resolved', 'rejected'], status), updated_at DESC, n) AS rank, ceil(length(body) / 4)::BIGINT AS tokens FROM final)"


def ranked_of(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.round("boosted", 9).desc(), fl.priority(), F.desc("updated_at"), "n")
    return final_of(spark, sf).withColumn("rank", F.row_number().over(w))


@query("T2_task_sort", *CHAIN, EDGES, SCORES, BOOST, RANKED, sql="SELECT query_id, rank, n FROM ranked WHERE rank <= 20")
def t2(spark, sf):
    return ranked_of(spark, sf).where("rank <= 20").select("query_id", "rank", "n")


@query("R20_score_trace", *CHAIN, EDGES, SCORES, BOOST, RANKED, sql="SELECT query_id, n, round(fts, 6) AS fts, round(specificity, 6) AS specificity, round(length, 6) AS length, round(coverage, 6) AS coverage, round(recency, 6) AS recency, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def r20(spark, sf):
    r = ranked_of(spark, sf).where("rank <= 10")
    return r.select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("fts", "specificity", "length", "coverage", "recency", "score")])


FILL = """, fill(query_id, rank, n, used, taken) AS (
  SELECT query_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT query_id FROM ranked) UNION ALL
  SELECT f.query_id, r.rank, r.n, CASE WHEN f.used + r.tokens <= 4000 THEN f.used + r.tokens ELSE f.used END, f.used + r.tokens <= 4000 FROM fill f JOIN ranked r ON r.query_id = f.query_id AND r.rank = f.rank + 1)
SELECT query_id, n FROM fill WHERE taken"""


def _recursive(sql_ctes: tuple, tail: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(sql_ctes) + tail


@query("W8_greedy_fill", sql=_recursive((*CHAIN, EDGES, SCORES, BOOST, RANKED), FILL))
def w8(spark, sf):
    return rk.greedy_fill(ranked_of(spark, sf), 4000)


@query("W9_stop_at_overflow", *CHAIN, EDGES, SCORES, BOOST, RANKED, sql="SELECT query_id, n FROM (SELECT query_id, n, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked) WHERE used <= 4000")
def w9(spark, sf):
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked_of(spark, sf).withColumn("used", F.sum("tokens").over(w)).where("used <= 4000").select("query_id", "n")


def _with_words(spark, sf, rows):
    """rows (n, ...) with the words whose trigrams tell likeness; texts join ranked rows, not the other way round."""
    words = F.filter(F.split(F.regexp_replace(F.lower("body"), "[^\\p{L}\\p{N}\\s]", ""), "\\s+"), lambda x: x != "")
    return rows.join(tb.atoms(spark, sf).select("n", "body"), "n").select(*rows.columns, words.alias("words"))


@query("R12_diversity")
def r12(spark, sf):
    return rk.mmr(_with_words(spark, sf, held(scores_of(spark, sf).select("query_id", "n", "score"), "scores")))


@query("R15_recall")
def r15(spark, sf):
    """The whole chain: search, scores, boost, diversity, budget. A query's diversity is followed until what is left and fits all fits, whatever its order."""
    final = held(final_of(spark, sf).select("query_id", "n", F.col("boosted").alias("score"), "tokens"), "boosted")

    def more(order):
        placed = order.join(final, ["query_id", "n"]).select("query_id", "n", F.col("position").alias("rank"), "tokens")
        return rk.unfilled(placed, final.join(order, ["query_id", "n"], "left_anti"), 4000)

    order = rk.mmr(_with_words(spark, sf, final.select("query_id", "n", "score")), more=more)
    # rows without a position are larger than what is left, or fit in any order
    rank = F.coalesce("position", F.lit(2**62))
    return rk.greedy_fill(final.join(order, ["query_id", "n"], "left").select("query_id", "n", rank.alias("rank"), "tokens"), 4000)


@query("T3_recency_recall", ATOMS, VIS, CAND, sql="SELECT n FROM cand ORDER BY list_position(['active', 'draft', 'accepted', 'resolved', 'rejected'], status), created_at DESC, n LIMIT 50")
def t3(spark, sf):
    return fl.candidates(tb.atoms(spark, sf)).orderBy(fl.priority(), F.desc("created_at"), "n").limit(50).select("n")


_DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"


@query("T4_knn", sql=f"""SELECT query_id, n, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, n) AS r FROM (
  SELECT 'v' || q.vec_id AS query_id, e.vec_id AS n, round({_DOT}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE r <= 20 AND similarity >= 0.3""")
def t4(spark, sf):
    e = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("v"))
    return rk.knn(e, e.where("n % 100 = 0").select(F.concat(F.lit("v"), "n"), "v"))


@query("R23_stale_vectors", ATOMS, sql="SELECT n, (row_number() OVER (ORDER BY n) - 1) // 100 AS batch FROM atoms WHERE n NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0)")
def r23(spark, sf):
    done = tb.table(spark, sf, "embeddings").where("vec_id % 4 <> 0").select(F.col("vec_id").alias("n"))
    left = tb.atoms(spark, sf).select("n").join(done, "n", "left_anti")
    return numbered(left, ["n"]).select("n", F.floor((F.col("rank") - 1) / 100).alias("batch"))


@query("A14_mean_words", ATOMS, VIS, CAND, sql="SELECT type, round(avg(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> ''))), 6) AS mean_words FROM cand GROUP BY type")
def a14(spark, sf):
    words = F.size(F.filter(F.split("body", "\\s+"), lambda x: x != ""))
    return fl.candidates(tb.atoms(spark, sf)).groupBy("type").agg(F.round(F.avg(words), 6).alias("mean_words"))
