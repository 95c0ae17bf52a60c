"""Reports over whole stores: all lint and doctor findings, evaluation by golden queries, freshness, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..operators import ranking as rk
from ..operators import topk as tk
from ..sources import tables as tb
from ..sources.tables import ATOMS, EPISODES, EVENTS_AS_OF, LOG, QUERY_TEXTS
from .recall_plans import _DOT, _QT, FTS, words_of
from .registry import ORACLE_SQL, QUERIES, query
from .store_plans import CADENCE, VIS


def one():
    return F.count(F.lit(1))


def _count_sql(name: str) -> str:
    return f"(SELECT count(*) FROM ({ORACLE_SQL[name]}))"


# Lint categories and doctor checks in order, with the query that finds each and its severity.
LINT = (
    ("contradiction", "H1_contradictions", "warning"), ("stale", "H2_stale", "warning"), ("orphan", "H3_orphans", "info"), ("duplicate", "H4_near_duplicates", "warning"),
    ("confidence_drift", "H5_belief_drift", "info"), ("ttl_warning", "H6_ttl_warnings", "warning"),
)
DOCTOR = (
    ("schema", "H9_schema_problems", "error"), ("ids", "H10_id_problems", "error"), ("links", "J15_broken_references", "error"), ("sections", "H11_stale_sections", "warning"),
    ("prose", "H12_prose_references", "warning"), ("orphans", "H3_orphans", "info"),
)
CORE = ("fact", "decision", "procedure", "preference")
_COMPOSITION = f"""(SELECT CASE WHEN count(*) >= 20 THEN (count(*) FILTER (type = 'belief') / count(*) > 0.8)::INT + (count(DISTINCT type) FILTER (type IN {CORE}) < {len(CORE)})::INT ELSE 0 END FROM (WITH {ATOMS} SELECT type FROM atoms WHERE status = 'active'))"""


@query("H8_lint_summary", sql=" UNION ALL ".join([f"SELECT '{c}' AS category, '{s}' AS severity, {_count_sql(q)}::BIGINT AS n" for c, q, s in LINT] + [f"SELECT 'composition', 'warning', {_COMPOSITION}::BIGINT"]))
def h8(spark, sf):
    """Findings by category, over all lint rules; none found is a row too."""
    rows = [QUERIES[q](spark, sf).agg(one().alias("n")).select(F.lit(c).alias("category"), F.lit(s).alias("severity"), "n") for c, q, s in LINT]
    active = tb.atoms(spark, sf).where("status = 'active'").agg(one().alias("n"), F.count_if(F.col("type") == "belief").alias("b"), F.count_distinct(F.when(F.col("type").isin(*CORE), F.col("type"))).alias("core"))
    found = (F.col("b") / F.col("n") > 0.8).cast("long") + (F.col("core") < len(CORE)).cast("long")
    rows.append(active.select(F.lit("composition").alias("category"), F.lit("warning").alias("severity"), F.when(F.col("n") >= 20, found).otherwise(0).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, rows)


_DOCTOR_SQL = " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS part, '{s}' AS worst, {_count_sql(q)}::BIGINT AS n" for i, (c, q, s) in enumerate(DOCTOR) if q in ORACLE_SQL)


@query("H14_doctor", sql=f"SELECT place, part, n, CASE WHEN n = 0 THEN 'ok' ELSE worst END AS severity FROM ({_DOCTOR_SQL})")
def h14(spark, sf):
    """All checks in order, each with its number of findings and what they amount to."""
    rows = [QUERIES[q](spark, sf).agg(one().alias("n")).select(F.lit(i).alias("place"), F.lit(c).alias("part"), "n", F.when(F.col("n") == 0, "ok").otherwise(s).alias("severity")) for i, (c, q, s) in enumerate(DOCTOR) if q in ORACLE_SQL]
    return reduce(DataFrame.unionByName, rows)


@query("H13_freshness", ATOMS, LOG, sql=f"""SELECT 'atoms without a vector' AS part, count(*)::DOUBLE AS value, CASE WHEN count(*) > 0 THEN 'stale' ELSE 'ok' END AS state FROM atoms WHERE n NOT IN (SELECT vec_id FROM embeddings) UNION ALL
  SELECT 'vectors without an atom', count(*), CASE WHEN count(*) > 0 THEN 'stale' ELSE 'ok' END FROM embeddings WHERE vec_id NOT IN (SELECT n FROM atoms) UNION ALL
  SELECT 'days since the last event', round((epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(max(ts))) / 86400.0, 6), CASE WHEN epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(max(ts)) > 7 * 86400 THEN 'stale' ELSE 'ok' END FROM log UNION ALL
  SELECT 'events of no atom', count(*), CASE WHEN count(*) > 0 THEN 'stale' ELSE 'ok' END FROM log WHERE ref NOT IN (SELECT n FROM atoms)""")
def h13(spark, sf):
    """Whether vectors, atoms and the log keep up with each other."""
    a, e, log = tb.atoms(spark, sf).select("n"), tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("n")), tb.log(spark, sf)
    state = lambda bad: F.when(bad, "stale").otherwise("ok").alias("state")
    missing = lambda name, d: d.agg(one().cast("double").alias("value")).select(F.lit(name).alias("part"), "value", state(F.col("value") > 0))
    days = (F.unix_timestamp(tb.clock(EVENTS_AS_OF).cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))) / 86400.0
    last = log.agg(F.round(days, 6).alias("value")).select(F.lit("days since the last event").alias("part"), "value", state(F.col("value") > 7))
    return (
        missing("atoms without a vector", a.join(e, "n", "left_anti")).unionByName(missing("vectors without an atom", e.join(a, "n", "left_anti"))).unionByName(last)
        .unionByName(missing("events of no atom", log.select(F.col("ref").alias("n")).where("n is not null").join(a, "n", "left_anti")))
    )


GOLDEN = """asks AS (SELECT n AS q, unnest(list_distinct(words[1:8])) AS term FROM words WHERE n % 100 = 0),
tf0 AS (SELECT n, dl, term, count(*) AS tf FROM (SELECT n, len(words) AS dl, unnest(words) AS term FROM words) GROUP BY ALL), df0 AS (SELECT term, count(*) AS df FROM tf0 GROUP BY term),
best AS (SELECT q, n FROM (SELECT q, n, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM asks JOIN tf0 USING (term) JOIN df0 USING (term) CROSS JOIN size GROUP BY q, n) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, n) <= 5)"""


@query("L27_eval", ATOMS, VIS, FTS, GOLDEN, sql="SELECT q, type, count(*) FILTER (best.n = q) > 0 AS passed FROM (SELECT DISTINCT q FROM asks) JOIN best USING (q) JOIN atoms a ON a.n = q GROUP BY q, type")
def l27(spark, sf):
    """Golden queries: an atom's first eight words are to find it among five. Every hundredth visible atom asks."""
    words = words_of(spark, sf)
    asks = words.where("n % 100 = 0").select(F.col("n").alias("q"), F.explode(F.array_distinct(F.slice("words", 1, 8))).alias("term"))
    top = tk.search_top(tk.postings(words), asks, 5)
    types = tb.atoms(spark, sf).select(F.col("n").alias("q"), "type")
    return top.groupBy("q").agg(F.max(F.col("n") == F.col("q")).alias("passed")).join(types, "q").select("q", "type", "passed")


EPISODE_FTS = _QT + """,
heard AS (SELECT episode, regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+') AS words FROM episodes), size AS (SELECT count(*) AS total, avg(len(words)) AS mean FROM heard),
tf AS (SELECT episode, dl, term, count(*) AS tf FROM (SELECT episode, len(words) AS dl, unnest(words) AS term FROM heard) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


@query("R2_episode_search", EPISODES, EPISODE_FTS, sql="""SELECT query_id, episode, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS bm25
  FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN size GROUP BY query_id, episode""")
def r2(spark, sf):
    """BM25 over episodes' summaries for each query's text."""
    words = tb.episodes(spark, sf).select(F.col("episode").alias("n"), rk.tokens(F.coalesce("summary", F.lit(""))).alias("words"))
    hits = rk.bm25(words, rk.query_terms(spark, QUERY_TEXTS))
    return hits.groupBy("query_id", F.col("n").alias("episode")).agg(F.round(F.sum("part"), 6).alias("bm25"))


@query("R22_semantic_search", sql=f"""WITH newest AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 10000) SELECT query_id, n, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, n) AS r FROM (
  SELECT 'v' || q.vec_id AS query_id, e.vec_id AS n, round({_DOT}, 6) AS similarity FROM newest e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE r <= 20 AND similarity >= 0.3""")
def r22(spark, sf):
    """Nearest vectors among the ten thousand newest, which is the search's own bound."""
    e = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("v"))
    return rk.knn(e.orderBy(F.desc("n")).limit(10_000), e.where("n % 100 = 0").select(F.concat(F.lit("v"), "n"), "v"))


_TRIMMED = "trim(body, ' ' || chr(10) || chr(9) || chr(13))"


@query(
    "L2_deduplicate", ATOMS, "firsts AS (SELECT *, row_number() OVER (PARTITION BY atom_id[1:15] ORDER BY updated_at DESC, n) AS r FROM atoms WHERE status NOT IN ('archived', 'expired'))",
    f"seconds AS (SELECT n, row_number() OVER (PARTITION BY type, {_TRIMMED} ORDER BY updated_at DESC, n) AS r FROM firsts WHERE r = 1)",
    sql="SELECT n, 'id' AS reason FROM firsts WHERE r > 1 UNION ALL SELECT n, 'content' FROM seconds WHERE r > 1",
)
def l2(spark, sf):
    """What goes as a copy: first by id, then, of those that stay, by content; the newest stays."""
    a = tb.atoms(spark, sf).where("status not in ('archived', 'expired')")
    a = a.select("n", "type", "updated_at", F.substring("atom_id", 1, 15).alias("id"), F.md5(F.regexp_replace("body", r"^[ \n\t\r]+|[ \n\t\r]+$", "")).alias("h"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("updated_at"), "n"))
    a = a.withColumn("r", place("id"))
    left = a.where("r = 1").withColumn("r", place("type", "h"))
    return a.where("r > 1").select("n", F.lit("id").alias("reason")).unionByName(left.where("r > 1").select("n", F.lit("content").alias("reason")))


@query("L8_compact_log", LOG, sql="""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, session_id, action, ref, value, CASE WHEN action = 'atom_updated' AND ref IS NOT NULL THEN updates - 1 ELSE 0 END AS dropped FROM (
  SELECT *, max(event_id) FILTER (action = 'atom_updated') OVER (PARTITION BY ref) AS last, count(*) FILTER (action = 'atom_updated') OVER (PARTITION BY ref) AS updates FROM log) WHERE action <> 'atom_updated' OR ref IS NULL OR event_id = last""")
def l8(spark, sf):
    """The log that compaction leaves, event by event: of an atom's updates the last, with how many went before it; all else stays."""
    e = tb.log(spark, sf).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "session_id", "action", "ref", "value")
    named = (F.col("action") == "atom_updated") & F.col("ref").isNotNull()
    last = e.where(named).groupBy("ref").agg(F.max("event_id").alias("event_id"), (one() - 1).alias("dropped"))
    return e.where(~named).withColumn("dropped", F.lit(0).cast("long")).unionByName(e.where(named).join(last, ["ref", "event_id"]))


@query("H15_closure_trajectory", ATOMS, sql="""SELECT month, sum(a) OVER w AS atoms, round(100.0 * sum(b) OVER w / sum(a) OVER w, 2) AS belief_pct, a AS new FROM (
  SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS a, count(*) FILTER (type = 'belief') AS b FROM atoms GROUP BY 1) WINDOW w AS (ORDER BY month)""".replace("sum(a) OVER w AS atoms", "(sum(a) OVER w)::BIGINT AS atoms"))
def h15(spark, sf):
    """How the share of beliefs moved, month by month."""
    months = tb.atoms(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(one().alias("a"), F.count_if(F.col("type") == "belief").alias("b"))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row for each month
    return months.select("month", F.sum("a").over(w).alias("atoms"), F.round(100.0 * F.sum("b").over(w) / F.sum("a").over(w), 2).alias("belief_pct"), F.col("a").alias("new"))


@query("H16_eval_cadence", CADENCE, sql="""SELECT cat, day, round(rate, 6) AS rate, round(prior, 6) AS prior, round(rate - prior, 6) AS delta, baseline_runs,
  CASE WHEN prior IS NULL THEN 'new' WHEN prior - rate >= 0.10 THEN 'drop' WHEN rate - prior >= 0.15 THEN 'improve' ELSE 'steady' END AS alert, day = max(day) OVER () AS latest
  FROM (SELECT *, count(*) OVER (PARTITION BY cat ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS baseline_runs FROM base)""")
def h16(spark, sf):
    """Each run of each category against the week before: by how much it moved, over how many runs, and whether it is the latest. A first run has nothing to compare with."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    runs = tb.table(spark, sf, "events").groupBy(F.col("event_type").alias("cat"), day.alias("day")).agg(F.avg(F.when(F.col("value") > 10, 1.0).otherwise(0.0)).alias("rate"))
    week = Window.partitionBy("cat").orderBy("day").rangeBetween(-7, -1)  # a row for each day
    rows = runs.withColumn("prior", F.avg("rate").over(week)).withColumn("baseline_runs", one().over(week)).withColumn("delta", F.col("rate") - F.col("prior"))
    alert = F.when(F.col("prior").isNull(), "new").when(F.col("prior") - F.col("rate") >= 0.10, "drop").when(F.col("delta") >= 0.15, "improve").otherwise("steady")
    last = tb.table(spark, sf, "events").agg(F.max(day).alias("last"))  # one row
    return rows.crossJoin(F.broadcast(last)).select("cat", "day", *[F.round(c, 6).alias(c) for c in ("rate", "prior", "delta")], "baseline_runs", alert.alias("alert"), (F.col("day") == F.col("last")).alias("latest"))


@query("W10_trailing_mean", LOG, sql="""SELECT ref, day, events, round(avg(events) OVER (PARTITION BY ref ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS before FROM (
  SELECT ref, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, count(*) AS events FROM log GROUP BY 1, 2)""")
def w10(spark, sf):
    """An atom's events a day, against their mean over its days of the week before."""
    days = tb.log(spark, sf).groupBy("ref", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")).agg(one().alias("events"))
    w = Window.partitionBy("ref").orderBy("day").rangeBetween(-7, -1)
    return days.select("ref", "day", "events", F.round(F.avg("events").over(w), 6).alias("before"))


_COUNTERS = (("reflect", "L5_reflect", "n"), ("consolidate", "L13_consolidate", None), ("relink", "L16_relink", None), ("dedup", "L2_deduplicate", None), ("compact", "W3_compaction", None))


@query("A15_result_counters", sql=" UNION ALL ".join(f"SELECT '{c}' AS operation, (SELECT {f'coalesce(sum({n}), 0)' if n else 'count(*)'} FROM ({ORACLE_SQL[q]}))::BIGINT AS n" for c, q, n in _COUNTERS))
def a15(spark, sf):
    """What each maintenance operation counts."""
    return reduce(DataFrame.unionByName, [QUERIES[q](spark, sf).agg((F.coalesce(F.sum(n), F.lit(0)) if n else one()).cast("long").alias("n")).select(F.lit(c).alias("operation"), "n") for c, q, n in _COUNTERS])


@query("M6_link_episode", LOG, sql="SELECT session_id AS session, count(*) AS requests, count(DISTINCT ref) AS linked, count(*) - count(DISTINCT ref) AS repeated FROM log WHERE ref IS NOT NULL GROUP BY session_id")
def m6(spark, sf):
    """Sessions linked to the atoms that their events name: a link asked for again changes nothing."""
    asked = tb.log(spark, sf).where("ref is not null").select(F.col("session_id").alias("session"), "ref")
    return asked.groupBy("session", "ref").agg(one().alias("k")).groupBy("session").agg(F.sum("k").alias("requests"), one().alias("linked"), (F.sum("k") - one()).alias("repeated"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)\\b({w})\\b') THEN '{t}'" for w, t in ex.TYPE_WORDS) + " ELSE 'fact' END"
CANDIDATES = rf"""said AS (SELECT conv_id * 1000000 + turn AS spot, CASE role WHEN 'assistant' THEN 2 ELSE 1 END AS pass, text, {_KIND} AS type, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 40) AS slug FROM conversations),
grouped AS (SELECT type, slug, count(*) FILTER (pass = 1) AS m, min(spot) FILTER (pass = 1) AS own, max(spot) FILTER (pass = 2) AS more FROM said GROUP BY type, slug),
picked AS (SELECT type, slug, CASE WHEN m >= 2 THEN own ELSE coalesce(more, own) END AS spot, greatest(m, 1) AS n FROM grouped),
old AS (SELECT DISTINCT type, left(regexp_replace(regexp_replace(lower(body), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 40) AS slug FROM atoms),
asks AS (SELECT p.spot AS q, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(left(text, 200), '\b(AND|OR|NOT|NEAR)\b', ' ', 'g')), '[\p{{L}}\p{{N}}]+'))) AS term
  FROM picked p JOIN said s ON s.spot = p.spot ANTI JOIN old o ON o.type = p.type AND o.slug = p.slug WHERE p.type <> 'constraint'),
tf0 AS (SELECT n, dl, term, count(*) AS tf FROM (SELECT n, len(words) AS dl, unnest(words) AS term FROM words) GROUP BY ALL), df0 AS (SELECT term, count(*) AS df FROM tf0 GROUP BY term),
top AS (SELECT q, n FROM (SELECT q, n, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM asks JOIN tf0 USING (term) JOIN df0 USING (term) CROSS JOIN size GROUP BY q, n) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, n) = 1 AND score > 2)"""


@query("L14_extraction", ATOMS, VIS, FTS, CANDIDATES, sql="""SELECT p.type, p.slug, p.spot AS candidate, CASE WHEN p.type = 'constraint' THEN 'invalid type' WHEN o.slug IS NOT NULL THEN 'slug exists' WHEN t.n IS NOT NULL THEN 'possible_duplicate' ELSE 'new' END AS status,
  CASE WHEN p.type = 'constraint' OR o.slug IS NOT NULL THEN 0 ELSE 1 END AS written, p.n - CASE WHEN p.type = 'constraint' OR o.slug IS NOT NULL THEN 0 ELSE 1 END AS skipped, t.n AS duplicate_of
  FROM picked p LEFT JOIN old o ON o.type = p.type AND o.slug = p.slug LEFT JOIN top t ON t.q = p.spot""")
def l14(spark, sf):
    """Candidates are what conversations say, the assistant's turns as the second pass; the store's texts are what exists."""
    c = tb.table(spark, sf, "conversations")
    at, kind = (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("at"), F.when(F.col("role") == "assistant", 2).otherwise(1).alias("pass")
    said = c.select(at, kind, F.col("text").alias("body"), ex.inferred_type("text").alias("type"), ex.slug("text").alias("slug"))
    old = tb.atoms(spark, sf).select("type", ex.slug("body").alias("slug"))
    return ex.reconciled(said, old, tk.postings(words_of(spark, sf))).withColumnRenamed("at", "candidate")
