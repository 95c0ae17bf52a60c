"""Maintenance, text mining, health checks and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conflicts as cf
from ..operators import filters as fl
from ..operators import lifecycle as lc
from ..operators.orders import sums_before
from ..sources import tables as tb
from ..sources.scratch import dealt, held
from ..sources.tables import AS_OF, ATOMS, EDGES, EPISODES, LOG, TRIPLES
from .registry import query
from .store_plans import AGE, CAND, VIS, age

_OVERLAP = "len(list_filter(x.paths, lambda p: len(list_filter(y.paths, lambda q: p = q OR starts_with(p, q || '/') OR starts_with(q, p || '/'))) > 0)) > 0"
_CLASH = f"x.type = y.type AND x.n <> y.n AND abs(x.confidence - y.confidence) > 0.3 + 1e-9 AND (len(x.paths) = 0 OR len(y.paths) = 0 OR {_OVERLAP})"


@query("J6_conflict_pairs", ATOMS, sql=f"SELECT x.n AS a, y.n AS b FROM atoms x JOIN atoms y ON {_CLASH} AND x.n < y.n WHERE x.status = 'active' AND y.status = 'active'")
def j6(spark, sf):
    return cf.all_pairs(tb.atoms(spark, sf).where("status = 'active'"))


@query("J7_blocked_drafts", ATOMS, sql=f"SELECT x.n FROM atoms x WHERE x.status = 'draft' AND EXISTS (SELECT 1 FROM atoms y WHERE y.status = 'active' AND {_CLASH})")
def j7(spark, sf):
    a = tb.atoms(spark, sf)
    return cf.blocked(a.where("status = 'draft'"), a.where("status = 'active'"))


@query("J6_conflict_links", ATOMS, sql=f"SELECT x.n, count(y.n) AS links FROM atoms x LEFT JOIN atoms y ON {_CLASH} AND y.status = 'active' WHERE x.status = 'active' GROUP BY x.n")
def j6_links(spark, sf):
    """With how many others each active atom conflicts: all of J6's pairs, counted without a row for each."""
    return cf.conflict_links(tb.atoms(spark, sf).where("status = 'active'"))


@query("L1_expiry", ATOMS, sql=f"SELECT n FROM atoms WHERE ttl_days IS NOT NULL AND {AGE} > ttl_days AND status NOT IN ('archived', 'expired')")
def l1(spark, sf):
    return tb.atoms(spark, sf).where((age() > F.col("ttl_days")) & ~F.col("status").isin("archived", "expired")).select("n")


PROMOTE = f"""blocked AS (SELECT DISTINCT x.n FROM atoms x JOIN atoms y ON {_CLASH} WHERE x.status = 'draft' AND y.status = 'active'),
promoted AS (SELECT n, type FROM atoms WHERE status = 'draft' AND (type = 'open_question' OR (confidence >= 0.7 AND n NOT IN (SELECT n FROM blocked)
  AND ((type IN ('fact', 'preference', 'decision') AND {AGE} >= 2) OR (type = 'procedure' AND executed_at IS NOT NULL)))))"""


def promoted(a):
    """Drafts among the atoms `a` that become active."""
    drafts = a.where("status = 'draft'")
    blocked = cf.blocked(drafts, a.where("status = 'active'"))
    free = drafts.where("confidence >= 0.7").join(blocked, "n", "left_anti")
    old = F.col("type").isin("fact", "preference", "decision") & (age() >= 2)
    return drafts.where("type = 'open_question'").select("n", "type").unionByName(free.where(old | ((F.col("type") == "procedure") & F.col("executed_at").isNotNull())).select("n", "type"))


@query("L3_promotion", ATOMS, PROMOTE, sql="SELECT n, type FROM promoted")
def l3(spark, sf):
    return promoted(tb.atoms(spark, sf))


@query("L4_conflict_records", ATOMS, EDGES, sql=f"""SELECT x.n AS a, y.n AS b, 'CONF-' || x.n || '-' || y.n AS record FROM atoms x JOIN atoms y ON {_CLASH} AND x.n < y.n WHERE x.status = 'active' AND y.status = 'active'
  AND NOT EXISTS (SELECT 1 FROM edges WHERE rel = 'contradicts' AND least(src, tgt) = x.n AND greatest(src, tgt) = y.n)""")
def l4(spark, sf):
    """A record for each conflict that no relation states yet."""
    known = tb.edges(spark, sf).where("rel = 'contradicts'").select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    return cf.all_pairs(tb.atoms(spark, sf).where("status = 'active'"), known).select("a", "b", F.concat(F.lit("CONF-"), "a", F.lit("-"), "b").alias("record"))


_TRIMMED = "trim(body, ' ' || chr(10) || chr(9) || chr(13))"
REFLECT = (
    f"late AS (SELECT n FROM atoms WHERE ttl_days IS NOT NULL AND {AGE} > ttl_days AND status NOT IN ('archived', 'expired')), alive0 AS (SELECT * FROM atoms WHERE n NOT IN (SELECT n FROM late))",
    "same_id AS (SELECT n, atom_id FROM (SELECT *, row_number() OVER (PARTITION BY atom_id ORDER BY updated_at DESC, n) AS r FROM alive0 WHERE status NOT IN ('archived', 'expired')) WHERE r > 1)",
    "alive1 AS (SELECT * FROM alive0 WHERE atom_id NOT IN (SELECT atom_id FROM same_id))",
    f"same_body AS (SELECT n FROM (SELECT n, row_number() OVER (PARTITION BY type, {_TRIMMED} ORDER BY updated_at DESC, n) AS r FROM alive1 WHERE status NOT IN ('archived', 'expired')) WHERE r > 1)",
    "alive2 AS (SELECT * FROM alive1 WHERE n NOT IN (SELECT n FROM same_body))",
    PROMOTE.replace("FROM atoms", "FROM alive2").replace("JOIN atoms", "JOIN alive2"),
    "alive3 AS (SELECT * REPLACE (CASE WHEN n IN (SELECT n FROM promoted) THEN 'active' ELSE status END AS status) FROM alive2)",
)


@query("L5_reflect", ATOMS, *REFLECT, sql=f"""SELECT 'expired' AS stage, count(*) AS n FROM late UNION ALL SELECT 'same_id', count(*) FROM same_id UNION ALL SELECT 'same_body', count(*) FROM same_body UNION ALL
  SELECT 'promoted', count(*) FROM promoted UNION ALL SELECT 'conflicts', count(*) FROM alive3 x JOIN alive3 y ON {_CLASH} AND x.n < y.n WHERE x.status = 'active' AND y.status = 'active'""")
def l5(spark, sf):
    """The maintenance run: each stage works on what the one before left; promoted drafts are active for the conflicts."""
    body = F.md5(F.regexp_replace("text", r"^[ \n\t\r]+|[ \n\t\r]+$", ""))
    a = tb.atoms(spark, sf, body).select("n", "atom_id", "type", "status", "confidence", "paths", "created_at", "updated_at", "ttl_days", "executed_at", F.col("body").alias("h"))
    # which stage takes an atom out, by windows over one pass: no join of a stage's result with the rows
    live, last = ~F.col("status").isin("archived", "expired"), [F.desc("updated_at"), "n"]
    a = a.withColumn("out", F.when(live & F.coalesce(age() > F.col("ttl_days"), F.lit(False)), "expired"))
    left = live & F.col("out").isNull()
    a = a.withColumn("k", F.when(left, F.row_number().over(Window.partitionBy("atom_id", left).orderBy(*last))))
    twice = F.max("k").over(Window.partitionBy("atom_id")) > 1  # a survivor waits for the next run too
    a = a.withColumn("out", F.coalesce("out", F.when(twice, F.when(F.col("k") > 1, "same_id").otherwise("waits"))))
    a = a.withColumn("k", F.when(left, F.row_number().over(Window.partitionBy("type", "h", left).orderBy(*last))))
    a = a.withColumn("out", F.coalesce("out", F.when(F.col("k") > 1, "same_body")))
    a = held(a.select("n", "type", "status", "confidence", "paths", "created_at", "executed_at", "out"), "reflect")
    alive = a.where("out is null")
    new = held(promoted(alive), "promoted")
    active = alive.where("status = 'active'").unionByName(alive.join(new.select("n"), "n", "left_semi"))
    stages = spark.createDataFrame([(x,) for x in ("expired", "same_id", "same_body")], "stage string")
    taken = a.where("out is not null").groupBy(F.col("out").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    out = stages.join(taken, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))
    stage = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    return out.unionByName(stage("promoted", new)).unionByName(cf.n_conflicts(active).select(F.lit("conflicts").alias("stage"), "n"))


@query("L6_replay", LOG, sql="SELECT ref, arg_max(value, event_id) AS value FROM log WHERE action IN ('atom_updated', 'conflict_detected') GROUP BY ref HAVING arg_max(action, event_id) <> 'conflict_detected'")
def l6(spark, sf):
    e = tb.log(spark, sf).where("action in ('atom_updated', 'conflict_detected')")
    return lc.replay(e, gone=F.col("action") == "conflict_detected").select("ref", "value")


@query("L6_as_of", LOG, sql="SELECT ref, arg_max(value, event_id) AS value FROM log WHERE action = 'atom_updated' AND ts <= TIMESTAMP '2024-01-10' GROUP BY ref")
def l6t(spark, sf):
    return lc.replay(tb.log(spark, sf).where(F.col("action") == "atom_updated").where(F.col("ts") <= tb.clock("2024-01-10 00:00:00"))).select("ref", "value")


@query("L7_merge", LOG, sql="SELECT ref, arg_max(value, (ts, event_id)) AS value, count(DISTINCT CASE WHEN event_id % 3 = 1 THEN 1 WHEN event_id % 3 = 0 THEN 2 END) = 2 AS concurrent FROM log WHERE action = 'atom_updated' GROUP BY ref")
def l7(spark, sf):
    e = tb.log(spark, sf).where("action = 'atom_updated'")
    local, remote = e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1")
    both = local.unionByName(remote.join(local.select("event_id"), "event_id", "left_anti"))
    sides = F.countDistinct(F.when(F.col("event_id") % 3 == 1, 1).when(F.col("event_id") % 3 == 0, 2))
    return both.groupBy("ref").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), (sides == 2).alias("concurrent"))


@query("L9_unprovenanced", ATOMS, LOG, sql="SELECT n FROM atoms JOIN (SELECT ref, max(ts) AS t FROM log WHERE action = 'atom_updated' GROUP BY ref) ON n = ref WHERE updated_at > t")
def l9(spark, sf):
    last = tb.log(spark, sf).where("action = 'atom_updated'").groupBy(F.col("ref").alias("n")).agg(F.max("ts").alias("t"))
    return tb.atoms(spark, sf).select("n", "updated_at").join(last, "n").where("updated_at > t").select("n")


@query("L10_supersede", ATOMS, EDGES, sql="SELECT n, CASE WHEN n IN (SELECT tgt FROM edges WHERE rel = 'supersedes') THEN 'superseded' ELSE status END AS status FROM atoms")
def l10(spark, sf):
    old = tb.edges(spark, sf).where("rel = 'supersedes'").select(F.col("tgt").alias("n")).distinct().withColumn("old", F.lit(True))
    return tb.atoms(spark, sf).select("n", "status").join(old, "n", "left").select("n", F.when(F.col("old"), "superseded").otherwise(F.col("status")).alias("status"))


@query("L13_consolidate", ATOMS, sql="SELECT n, array_to_string(list_filter(tags, lambda t: t <> 'auto-extracted'), '|') AS tags FROM atoms WHERE status = 'draft' AND list_contains(tags, 'auto-extracted') ORDER BY n LIMIT 50")
def l13(spark, sf):
    drafts = tb.atoms(spark, sf).where(fl.unvetted()).orderBy("n").limit(50)
    return drafts.select("n", F.array_join(F.array_remove("tags", "auto-extracted"), "|").alias("tags"))


@query("L15_triple_resolution", TRIPLES, sql="""SELECT new_atom, old_atom, CASE WHEN new_day < old_day THEN 'wrong-direction' WHEN NOT old_live THEN 'stale' WHEN (new_atom + old_atom) % 2 = 0 THEN 'superseded' ELSE 'rejected' END AS outcome
  FROM (SELECT DISTINCT a.atom AS new_atom, b.atom AS old_atom, a.day AS new_day, b.day AS old_day, b.live AS old_live FROM triples a JOIN triples b ON a.subject = b.subject AND a.object <> b.object AND a.atom <> b.atom WHERE a.atom % 100 = 0)""")
def l15(spark, sf):
    a = tb.triples(spark, sf, one_in=100).select(F.col("atom").alias("new_atom"), "subject", "object", F.col("day").alias("new_day"))
    b = tb.triples(spark, sf).select(F.col("atom").alias("old_atom"), F.col("subject").alias("s"), F.col("object").alias("o"), F.col("day").alias("old_day"), F.col("live").alias("old_live"))
    rows = tb.n_lines(spark, sf)
    a, b = dealt(a, rows, "subject"), dealt(b, rows, "s")
    j = a.join(b, (a.subject == b.s) & (a.object != b.o) & (a.new_atom != b.old_atom)).select("new_atom", "old_atom", "new_day", "old_day", "old_live").distinct()
    outcome = F.when(F.col("new_day") < F.col("old_day"), "wrong-direction").when(~F.col("old_live"), "stale").when((F.col("new_atom") + F.col("old_atom")) % 2 == 0, "superseded").otherwise("rejected")
    return j.select("new_atom", "old_atom", outcome.alias("outcome"))


CUT = "\n[... truncated]"  # fixed value: ends a conversation that was cut


@query("L20_observe", EPISODES, sql="SELECT episode, CASE WHEN length(summary) > 60000 THEN left(summary, 60000) || chr(10) || '[... truncated]' ELSE summary END AS observed FROM episodes WHERE length(trim(summary, ' ' || chr(9) || chr(10) || chr(13))) >= 50")
def l20(spark, sf):
    """What an observer is given of each conversation; short ones are passed over, long ones say that they are cut."""
    e = tb.episodes(spark, sf).where(F.length(F.regexp_replace("summary", r"^[ \t\n\r]+|[ \t\n\r]+$", "")) >= 50)
    return e.select("episode", F.when(F.length("summary") > 60000, F.concat(F.substring("summary", 1, 60000), F.lit(CUT))).otherwise(F.col("summary")).alias("observed"))


@query("L21_seed_lifecycle", ATOMS, sql="SELECT type, CASE WHEN count(*) = 0 THEN 'created' WHEN count(*) = 1 THEN 'unchanged' ELSE 'deduped' END AS outcome, count(*) AS n FROM atoms WHERE status = 'active' AND list_contains(tags, 'src3') GROUP BY type")
def l21(spark, sf):
    a = tb.atoms(spark, sf).where((F.col("status") == "active") & F.array_contains("tags", "src3")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return a.select("type", F.when(F.col("n") == 1, "unchanged").otherwise("deduped").alias("outcome"), "n")


@query("L22_share", ATOMS, sql="SELECT n, 'shared' AS store FROM atoms WHERE classification = 'PUBLIC' AND status = 'active' UNION ALL SELECT n, 'own' FROM atoms")
def l22(spark, sf):
    a = tb.atoms(spark, sf)
    return a.where("classification = 'PUBLIC' and status = 'active'").select("n", F.lit("shared").alias("store")).unionByName(a.select("n", F.lit("own").alias("store")))


@query("L23_migrate", LOG, sql="SELECT string_split(first, '-')[1] AS agent, count(*) AS n FROM (SELECT ref, arg_min(session_id, event_id) AS first FROM log GROUP BY ref) GROUP BY 1")
def l23(spark, sf):
    first = tb.log(spark, sf).groupBy("ref").agg(F.min_by("session_id", "event_id").alias("first"))
    return first.groupBy(F.split("first", "-")[0].alias("agent")).agg(F.count(F.lit(1)).alias("n"))


@query("L25_views", ATOMS, VIS, CAND, sql="SELECT type, row_number() OVER (PARTITION BY type ORDER BY atom_id) AS line, '- ' || atom_id AS text FROM cand WHERE status = 'active' AND type IN ('decision', 'constraint', 'open_question')")
def l25(spark, sf):
    """The lines of each type's view, numbered over partitions: no view is one row or one task."""
    a = fl.candidates(tb.atoms(spark, sf), types=("decision", "constraint", "open_question"), statuses=("active",))
    rows = sums_before(a.select("type", "atom_id"), ["type"], ["atom_id"], F.lit(1).cast("long"), "before")
    return rows.select("type", (F.col("before") + 1).alias("line"), F.concat(F.lit("- "), "atom_id").alias("text"))


@query("H1_contradictions", ATOMS, EDGES, sql="SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM edges JOIN atoms x ON x.n = src AND x.status = 'active' JOIN atoms y ON y.n = tgt AND y.status = 'active' WHERE rel = 'contradicts'")
def h1(spark, sf):
    active = tb.atoms(spark, sf).where("status = 'active'").select("n")
    e = tb.edges(spark, sf).where("rel = 'contradicts'")
    e = e.join(active.withColumnRenamed("n", "src"), "src", "left_semi").join(active.withColumnRenamed("n", "tgt"), "tgt", "left_semi")
    return e.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()


@query("H2_stale", ATOMS, LOG, sql=f"SELECT n FROM atoms LEFT JOIN (SELECT ref, max(ts) AS t FROM log GROUP BY ref) ON n = ref WHERE type IN ('fact', 'decision') AND (epoch(TIMESTAMP '{AS_OF}') - epoch(coalesce(t, updated_at))) / 86400.0 > 90")
def h2(spark, sf):
    last = tb.log(spark, sf).groupBy(F.col("ref").alias("n")).agg(F.max("ts").alias("t"))
    a = tb.atoms(spark, sf).where("type in ('fact', 'decision')").select("n", "updated_at").join(last, "n", "left")
    return a.withColumn("created_at", F.coalesce("t", "updated_at")).where(age() > 90).select("n")


@query("H5_belief_drift", ATOMS, sql=f"SELECT n FROM atoms WHERE type = 'belief' AND confidence < 0.5 AND {AGE} > 30")
def h5(spark, sf):
    return tb.atoms(spark, sf).where("type = 'belief' and confidence < 0.5").where(age() > 30).select("n")


@query("H6_ttl_warnings", ATOMS, sql=f"SELECT n, floor(ttl_days - {AGE})::BIGINT AS days_left FROM atoms WHERE ttl_days IS NOT NULL AND floor(ttl_days - {AGE}) BETWEEN 0 AND 7")
def h6(spark, sf):
    left = F.floor(F.col("ttl_days") - age())
    return tb.atoms(spark, sf).where(left.between(0, 7)).select("n", left.alias("days_left"))


@query("H9_schema_problems", ATOMS, sql="SELECT n, 'classification' AS field, 'lookup' AS plan FROM atoms WHERE classification IS NULL UNION ALL SELECT n, 'confidence', 'manual' FROM atoms WHERE confidence < 0.5 UNION ALL SELECT n, 'ttl_days', 'structural' FROM atoms WHERE ttl_days < 60")
def h9(spark, sf):
    a = tb.atoms(spark, sf)
    fault = lambda when, field, plan: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(plan).alias("plan")))
    faults = F.array(fault(F.col("classification").isNull(), "classification", "lookup"), fault(F.col("confidence") < 0.5, "confidence", "manual"), fault(F.col("ttl_days") < 60, "ttl_days", "structural"))
    return a.select("n", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("x")).select("n", "x.field", "x.plan")


@query("H10_id_problems", ATOMS, sql="SELECT atom_id[1:15] AS id, count(*) AS n FROM atoms GROUP BY 1 HAVING count(*) > 1")
def h10(spark, sf):
    return tb.atoms(spark, sf).groupBy(F.substring("atom_id", 1, 15).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("H17_seed_freshness", ATOMS, sql="SELECT t.type, count(n) AS n, CASE count(n) WHEN 0 THEN 'error' WHEN 1 THEN 'ok' ELSE 'duplicate' END AS state FROM (VALUES ('decision'), ('fact'), ('belief'), ('lesson')) t(type) LEFT JOIN atoms a ON a.type = t.type AND status = 'active' AND list_contains(tags, 'src3') GROUP BY t.type")
def h17(spark, sf):
    want = spark.createDataFrame([(x,) for x in ("decision", "fact", "belief", "lesson")], "type string")
    have = tb.atoms(spark, sf).where((F.col("status") == "active") & F.array_contains("tags", "src3")).groupBy("type").agg(F.count(F.lit(1)).alias("c"))
    n = F.coalesce("c", F.lit(0))
    return want.join(have, "type", "left").select("type", n.alias("n"), F.when(n == 0, "error").when(n == 1, "ok").otherwise("duplicate").alias("state"))
