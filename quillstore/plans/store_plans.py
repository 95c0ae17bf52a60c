"""Scans, filters, joins, aggregates, windows, set operations and scalar functions over a store."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import lifecycle as lc
from ..operators import ranking as rk
from ..operators.orders import sums_before
from ..sources import markdown as md
from ..sources import tables as tb
from ..sources.index import SegmentedIndex
from ..sources.scratch import dealt, held, shared_dir, small
from ..sources.tables import AS_OF, ATOMS, EDGES, EPISODES, EVENTS_AS_OF, LOG, NOTES, TRIPLES
from .registry import query

VISIBLE = "(classification IS NULL OR classification NOT IN ('SECRET', 'PERSONAL'))"
CURRENT = "status NOT IN ('archived', 'expired', 'superseded')"
UNVETTED = "(status = 'draft' AND list_contains(tags, 'auto-extracted'))"
VIS = f"vis AS (SELECT * FROM atoms WHERE {VISIBLE})"
CAND = f"cand AS (SELECT * FROM vis WHERE {CURRENT} AND NOT {UNVETTED})"


def _atoms_where(name, spark_filter, sql_filter):
    query(name, ATOMS, sql=f"SELECT n, type, status FROM atoms WHERE {sql_filter}")(
        lambda spark, sf: tb.atoms(spark, sf).where(spark_filter()).select("n", "type", "status")
    )


@query("S1_scan_atoms", ATOMS, sql="SELECT n, atom_id, type, status, confidence, classification, ttl_days, len(tags) AS n_tags, len(paths) AS n_paths, length(body) AS body_chars FROM atoms")
def s1(spark, sf):
    return tb.atoms(spark, sf).select("n", "atom_id", "type", "status", "confidence", "classification", "ttl_days", F.size("tags").alias("n_tags"), F.size("paths").alias("n_paths"), F.length("body").alias("body_chars"))


@query("S3_normalised_header", ATOMS, sql="SELECT n, array_to_string(list_sort(list_distinct(tags || ['Team', type])), '|') AS tags FROM atoms")
def s3(spark, sf):
    return tb.atoms(spark, sf).select("n", F.array_join(F.array_sort(F.array_union("tags", F.array(F.lit("Team"), "type"))), "|").alias("tags"))


@query("S5_event_scan", LOG, sql="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, session_id, action, ref FROM log")
def s5(spark, sf):
    return tb.log(spark, sf).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "session_id", "action", "ref")


@query("S6_events_for_atoms", LOG, sql="SELECT event_id, action, ref FROM log WHERE action = 'atom_updated' AND ref IN (1, 2, 3, 5, 8, 13)")
def s6(spark, sf):
    return tb.log(spark, sf).where((F.col("action") == "atom_updated") & F.arrays_overlap(F.array("ref"), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 5, 8, 13)]))).select("event_id", "action", "ref")


@query("S7_event_counts", LOG, sql="SELECT count(*) AS n_events, max(event_id) AS last_id, arg_max(action, event_id) AS last_action FROM log")
def s7(spark, sf):
    return tb.log(spark, sf).agg(F.count(F.lit(1)).alias("n_events"), F.max("event_id").alias("last_id"), F.max_by("action", "event_id").alias("last_action"))


@query("S10_triple_scan", TRIPLES, sql="SELECT atom, subject, object, day FROM triples WHERE live")
def s10(spark, sf):
    return tb.triples(spark, sf).where("live").select("atom", "subject", "object", "day")


@query("S11_episodes", EPISODES, sql="SELECT episode, n_turns, length(summary) AS chars FROM episodes WHERE hours % 3 <> 1 ORDER BY hours DESC, episode LIMIT 20")
def s11(spark, sf):
    return tb.episodes(spark, sf).where("hours % 3 <> 1").orderBy(F.desc("hours"), "episode").limit(20).select("episode", "n_turns", F.length("summary").alias("chars"))


@query("S12_episode_upsert", EPISODES, sql="""SELECT episode, min(first_hour) AS started, arg_max(v, hour_at) AS n_turns FROM (
  SELECT episode, hours AS first_hour, hours AS hour_at, n_turns AS v FROM episodes UNION ALL
  SELECT episode, hours + 5, hours + 5, n_turns + 1 FROM episodes WHERE episode % 2 = 0) GROUP BY episode""")
def s12(spark, sf):
    e = tb.episodes(spark, sf).select("episode", F.col("hours").alias("at"), F.col("n_turns").alias("v"))
    newer = e.where("episode % 2 = 0").select("episode", F.col("at") + 5, F.col("v") + 1)
    return e.union(newer).groupBy("episode").agg(F.min("at").alias("started"), F.max_by("v", "at").alias("n_turns"))


@query("S13_import_chunks", sql="""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  SELECT doc_id, i AS chunk, length(trim(line)) AS chars FROM lines WHERE length(trim(line)) >= 20""")
def s13(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return d.where(F.length(F.trim("line")) >= 20).select("doc_id", (F.col("p") + 1).alias("chunk"), F.length(F.trim("line")).alias("chars"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CHUNKS = rf"""lines AS (SELECT file, i - 1 AS i, l[i] AS line FROM (SELECT file, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT file, string_split(text, chr(10)) AS l FROM notes WHERE text IS NOT NULL))),
kinds AS (SELECT *, regexp_matches(line, '^#{{2,3}}\s+[^\r]+$') AS h, regexp_matches(line, '^[-*]\s+') AS b, regexp_matches(line, '^\s{{2,}}') AS c FROM lines),
runs AS (SELECT *, sum(h::INT) OVER w AS section, sum((b OR NOT c)::INT) OVER w AS item, sum(h::INT) OVER (PARTITION BY file) AS headings FROM kinds WINDOW w AS (PARTITION BY file ORDER BY i)),
sections AS (SELECT file, min(i) AS start, max(CASE WHEN h THEN {_TRIM.format("regexp_extract(line, '^#{2,3}\\s+(.+)$', 1)")} END) AS heading, {_TRIM.format("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), '')")} AS body FROM runs WHERE headings > 0 AND section > 0 GROUP BY file, section),
bullets AS (SELECT file, min(i) AS start, NULL AS heading, {_TRIM.format("string_agg(CASE WHEN b THEN regexp_extract(line, '^[-*]\\s+(.*)', 1) ELSE " + _TRIM.format("line") + " END, ' ' ORDER BY i)")} AS body
  FROM runs WHERE headings = 0 GROUP BY file, item HAVING arg_min(b, i) AND regexp_matches(arg_min(line, i), '^[-*]\s+[^\s]')),
long AS (SELECT * FROM sections WHERE length(body) >= 20 UNION ALL SELECT * FROM bullets WHERE length(body) >= 20),
chunks AS (SELECT * FROM long UNION ALL SELECT file, 0, NULL, {_TRIM.format("text")} FROM notes WHERE length({_TRIM.format("text")}) >= 20 AND file NOT IN (SELECT file FROM long) AND file NOT IN (SELECT file FROM runs WHERE headings > 0))"""


@query("S13_markdown_import", NOTES, CHUNKS, sql="SELECT file, start, heading, md5(body) AS body, length(body) AS chars FROM chunks")
def s13_import(spark, sf):
    """Sections, else bullets, else the whole, of all files."""
    return md.chunks(tb.notes(spark, sf)).select("file", "start", "heading", F.md5("body").alias("body"), F.length("body").alias("chars"))


@query("S14_index_rebuild", ATOMS, EDGES, LOG, sql="""SELECT part, n::BIGINT AS n FROM (SELECT 'atoms' AS part, count(*) AS n FROM atoms UNION ALL SELECT 'tags', sum(len(tags)) FROM atoms UNION ALL
  SELECT 'paths', sum(len(paths)) FROM atoms UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT * FROM edges) UNION ALL SELECT 'events', count(*) FROM log)""")
def s14(spark, sf):
    a = tb.atoms(spark, sf)
    part = lambda name, d, n: d.agg(n.cast("long").alias("n")).select(F.lit(name).alias("part"), "n")
    one = F.count(F.lit(1))
    return (
        part("atoms", a, one).union(part("tags", a, F.sum(F.size("tags")))).union(part("paths", a, F.sum(F.size("paths"))))
        .union(part("edges", tb.edges(spark, sf).distinct(), one)).union(part("events", tb.log(spark, sf), one))
    )


@query("S15_index_upsert", ATOMS, sql="SELECT n, CASE WHEN n % 10 = 0 THEN 'archived' ELSE status END AS status FROM atoms WHERE n % 13 <> 5 UNION ALL SELECT n + 10000000, 'draft' FROM atoms WHERE n % 100 = 0")
def s15(spark, sf):
    a = tb.atoms(spark, sf).select("n", "status")
    changed = a.where("n % 10 = 0").select("n", F.lit("archived").alias("status"))
    new = a.where("n % 100 = 0").select((F.col("n") + 10000000).alias("n"), F.lit("draft").alias("status"))
    gone = a.where("n % 13 = 5").select("n")
    kept = a.join(changed, "n", "left_anti").unionByName(changed).join(gone, "n", "left_anti")
    return kept.unionByName(new)


REVISED = f"""changes AS (SELECT ref AS n, arg_max(action, event_id) AS last, count(*) AS k FROM log WHERE action IN ('atom_updated', 'conflict_detected') GROUP BY ref),
vis AS (SELECT a.* REPLACE (CASE WHEN last = 'atom_updated' THEN body || ' revised thea erin ' || k ELSE body END AS body) FROM atoms a LEFT JOIN changes USING (n) WHERE {VISIBLE} AND coalesce(last, '') <> 'conflict_detected')"""


@query("S15_segments")
def s15_segments(spark, sf):
    """Search over an index in segments: all atoms, then the log's revisions and removals as a batch, then a merge."""
    changes = tb.log(spark, sf).where("action in ('atom_updated', 'conflict_detected')").groupBy(F.col("ref").alias("n")).agg(F.max_by("action", "event_id").alias("last"), F.count(F.lit(1)).alias("k"))
    changes, seen = held(changes, "changes"), tb.visible_texts(spark, sf)
    revised = seen.join(small(changes).where("last = 'atom_updated'"), "n").withColumn("body", F.concat("body", F.lit(" revised thea erin "), F.col("k").cast("string")))
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.apply(rk.documents_terms(seen))
    index.apply(rk.documents_terms(revised.select("n", "body")), changes.where("last = 'conflict_detected'").select("n"))
    index.merge()
    hits = rk.search_index(index, rk.query_terms(spark, tb.QUERY_TEXTS))
    return hits.groupBy("query_id", "n").agg(F.round(F.sum("part"), 6).alias("bm25"))


@query("S16_vector_stats", sql="SELECT label, count(*) AS n, min(len(embedding)) AS dims FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 3")
def s16(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("dims")).orderBy(F.desc("n"), "label").limit(3)


@query("S17_blobs", sql="SELECT sha256(text) AS hash, count(*) AS refs, min(length(text)) AS chars FROM documents GROUP BY 1")
def s17(spark, sf):
    return tb.table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("refs"), F.min(F.length("text")).alias("chars"))


@query("S19_bootstrap_events", ATOMS, LOG, sql="SELECT n, 'atom_imported' AS action FROM atoms WHERE n NOT IN (SELECT ref FROM log WHERE action = 'atom_updated' AND ref IS NOT NULL)")
def s19(spark, sf):
    known = tb.log(spark, sf).where("action = 'atom_updated'").select(F.col("ref").alias("n")).distinct()
    return tb.atoms(spark, sf).select("n").join(known, "n", "left_anti").withColumn("action", F.lit("atom_imported"))


@query("S21_status_report", ATOMS, sql="SELECT type, status, count(*) AS n FROM atoms GROUP BY GROUPING SETS ((type), (status), ())")
def s21(spark, sf):
    a = tb.atoms(spark, sf).select("type", "status")
    return a.groupingSets([["type"], ["status"], []], "type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("F1_candidate_filter", ATOMS, VIS, sql=f"""SELECT n, type, status, atom_id FROM vis WHERE {CURRENT} AND NOT {UNVETTED} AND type IN ('decision', 'fact', 'procedure')
  AND list_has_any(tags, ['en', 'hub']) AND confidence >= 0.5 ORDER BY CASE status WHEN 'active' THEN 1 WHEN 'draft' THEN 2 WHEN 'accepted' THEN 3 WHEN 'resolved' THEN 4 ELSE 9 END, updated_at DESC, n LIMIT 100""")
def f1(spark, sf):
    a = fl.candidates(tb.atoms(spark, sf), types=("decision", "fact", "procedure"), tags=("en", "hub"), min_confidence=0.5)
    return a.orderBy(fl.priority(), F.desc("updated_at"), "n").limit(100).select("n", "type", "status", "atom_id")


@query("F2_scan_filter", ATOMS, VIS, CAND, sql="SELECT n FROM cand WHERE type = 'belief'")
def f2(spark, sf):
    return fl.candidates(tb.atoms(spark, sf), types=("belief",)).select("n")


_atoms_where("F3_default_status", fl.current, CURRENT)
_atoms_where("F4_unvetted_drafts", lambda: ~fl.unvetted(), f"NOT {UNVETTED}")
_atoms_where("F5_privacy", fl.visible, VISIBLE)
_atoms_where("F6_type_status", lambda: F.col("type").isin("decision", "fact") & F.col("status").isin("active", "draft"), "type IN ('decision', 'fact') AND status IN ('active', 'draft')")
_atoms_where("F7_tags_any", lambda: F.arrays_overlap("tags", F.array(F.lit("hub"), F.lit("fr"))), "list_has_any(tags, ['hub', 'fr'])")
_atoms_where("F8_path_overlap", lambda: fl.in_scope(["src/en/"]), "len(paths) = 0 OR len(list_filter(paths, lambda p: p = 'src/en' OR starts_with(p, 'src/en/') OR starts_with('src/en', p || '/'))) > 0")
_atoms_where("F9_valid_tags", lambda: F.forall("tags", lambda t: ~t.rlike("\\s")), "len(list_filter(tags, lambda t: regexp_matches(t, '\\s'))) = 0")
_atoms_where(
    "F11_validation",
    lambda: F.col("confidence").between(0, 1) & (F.col("ttl_days").isNull() | (F.col("ttl_days") >= 1)) & (F.col("updated_at") >= F.col("created_at")) & (F.length("atom_id") >= 20),
    "confidence BETWEEN 0 AND 1 AND (ttl_days IS NULL OR ttl_days >= 1) AND updated_at >= created_at AND length(atom_id) >= 20",
)
GRAPH = f"nodes AS (SELECT * FROM vis WHERE {CURRENT} AND type <> 'conflict'), links AS (SELECT e.* FROM edges e JOIN nodes a ON e.src = a.n JOIN nodes b ON e.tgt = b.n)"


def graph_nodes(spark, sf):
    return tb.atoms(spark, sf).where(fl.visible() & fl.current() & (F.col("type") != "conflict"))


def graph_edges(spark, sf):
    """Edges with both ends in the graph."""
    ids = graph_nodes(spark, sf).select("n")
    return tb.edges(spark, sf).join(ids.withColumnRenamed("n", "src"), "src", "left_semi").join(ids.withColumnRenamed("n", "tgt"), "tgt", "left_semi").select("src", "tgt", "rel")


@query("F10_graph_filter", ATOMS, EDGES, VIS, GRAPH, sql="SELECT src, tgt, rel FROM links")
def f10(spark, sf):
    return graph_edges(spark, sf)


@query("J4_triple_conflicts", TRIPLES, sql="""SELECT a.atom AS new_atom, b.atom AS old_atom, a.subject, a.object AS new_object, b.object AS old_object
  FROM triples a JOIN triples b ON a.subject = b.subject AND a.object <> b.object AND a.atom <> b.atom AND b.live WHERE a.atom % 100 = 0""")
def j4(spark, sf):
    a = tb.triples(spark, sf, one_in=100).select(F.col("atom").alias("new_atom"), "subject", F.col("object").alias("new_object"))
    b = tb.triples(spark, sf).where("live").select(F.col("atom").alias("old_atom"), F.col("subject").alias("s"), F.col("object").alias("old_object"))
    rows = tb.n_lines(spark, sf)
    a, b = dealt(a, rows, "subject"), dealt(b, rows, "s")
    return a.join(b, (a.subject == b.s) & (a.new_object != b.old_object) & (a.new_atom != b.old_atom)).select("new_atom", "old_atom", "subject", "new_object", "old_object")


@query("J5_fuzzy_triples", TRIPLES, sql="""SELECT new_atom, subject, object, old_atom, old_subject, old_object FROM (
  SELECT a.atom AS new_atom, a.subject, a.object, b.atom AS old_atom, b.subject AS old_subject, b.object AS old_object,
    row_number() OVER (PARTITION BY a.atom, a.subject, a.object ORDER BY b.day DESC, b.atom, b.subject, b.object) AS r
  FROM triples a JOIN triples b ON a.subject <> b.subject AND a.object <> b.object AND a.atom <> b.atom AND b.live WHERE a.atom % 100 = 0) WHERE r <= 20""")
def j5(spark, sf):
    """The fixture has one predicate, so a new triple's fuzzy conflicts are the newest of all other live triples."""
    t = tb.triples(spark, sf).withColumn("predicate", F.lit("supplied_by"))
    return lc.fuzzy_conflicts(t.where("atom % 100 = 0"), t.where("live"), 20)


@query("J8_left_default", ATOMS, LOG, sql="SELECT n, coalesce(r, 0) AS reads FROM atoms LEFT JOIN (SELECT ref, count(*) AS r FROM log WHERE action = 'atom_read' GROUP BY ref) ON n = ref")
def j8(spark, sf):
    reads = tb.log(spark, sf).where("action = 'atom_read'").groupBy(F.col("ref").alias("n")).agg(F.count(F.lit(1)).alias("r"))
    return tb.atoms(spark, sf).select("n").join(reads, "n", "left").select("n", F.coalesce("r", F.lit(0)).alias("reads"))


@query("J9_neighbours", EDGES, sql="SELECT DISTINCT m AS n FROM (SELECT src AS a, tgt AS m FROM edges UNION ALL SELECT tgt, src FROM edges) WHERE a % 100 = 0")
def j9(spark, sf):
    e = tb.edges(spark, sf)
    both = e.select(F.col("src").alias("a"), F.col("tgt").alias("n")).union(e.select("tgt", "src"))
    return both.where("a % 100 = 0").select("n").distinct()


@query("J10_own_wins", ATOMS, sql="SELECT n, 'own' AS store FROM atoms WHERE n % 3 = 0 UNION ALL SELECT n, 'shared' FROM atoms WHERE n % 2 = 0 AND n % 3 <> 0")
def j10(spark, sf):
    a = tb.atoms(spark, sf).select("n")
    own, shared = a.where("n % 3 = 0"), a.where("n % 2 = 0")
    return own.withColumn("store", F.lit("own")).unionByName(shared.join(own, "n", "left_anti").withColumn("store", F.lit("shared")))


@query("J11_remote_events", LOG, sql="SELECT event_id, action FROM log WHERE event_id % 3 <> 1 AND event_id NOT IN (SELECT event_id FROM log WHERE event_id % 3 <> 0)")
def j11(spark, sf):
    e = tb.log(spark, sf)
    return e.where("event_id % 3 <> 1").join(e.where("event_id % 3 <> 0").select("event_id"), "event_id", "left_anti").select("event_id", "action")


@query("J12_concurrent_edits", LOG, sql="SELECT ref FROM log WHERE action = 'atom_updated' AND event_id % 3 = 1 INTERSECT SELECT ref FROM log WHERE action = 'atom_updated' AND event_id % 3 = 0")
def j12(spark, sf):
    e = tb.log(spark, sf).where("action = 'atom_updated'")
    return e.where("event_id % 3 = 1").select("ref").intersect(e.where("event_id % 3 = 0").select("ref"))


@query("J14_id_references", ATOMS, EDGES, sql="SELECT DISTINCT a.n, b.n AS target FROM atoms a JOIN edges e ON e.src = a.n JOIN atoms b ON b.n = e.tgt WHERE b.atom_id <> a.atom_id")
def j14(spark, sf):
    a = tb.atoms(spark, sf).select("n", "atom_id", "body")
    e = tb.edges(spark, sf)
    t = a.select(F.col("n").alias("tgt"), F.col("atom_id").alias("target_id"))
    bodies = a.join(e, a.n == e.src).join(t, "tgt").select("n", "atom_id", F.concat("body", F.lit("\nextends "), "target_id", F.lit(" here")).alias("body"))
    refs = bodies.select("n", "atom_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[A-Z]{4}-\\d{4}-\\d{2}-\\d{2}-[A-Z0-9-]+"), F.lit(0)))).alias("ref"))
    known = a.select(F.col("n").alias("target"), F.col("atom_id").alias("ref"))
    return refs.where("ref <> atom_id").join(known, "ref").select("n", "target").distinct()


@query("J15_broken_references", EDGES, ATOMS, sql="SELECT src, tgt + 3 AS missing FROM edges WHERE tgt + 3 NOT IN (SELECT n FROM atoms)")
def j15(spark, sf):
    e = tb.edges(spark, sf).select("src", (F.col("tgt") + 3).alias("missing"))
    return e.join(tb.atoms(spark, sf).select(F.col("n").alias("missing")), "missing", "left_anti").select("src", "missing")


@query("J17_sessions_since", ATOMS, LOG, sql="""SELECT n, (SELECT count(*) FROM (SELECT min(ts) AS t FROM log GROUP BY session_id) s WHERE t >= created_at) AS sessions FROM atoms""")
def j17(spark, sf):
    # both sides merged in one order, latest first, a session before an atom of its time: running sums over range partitions
    starts = tb.log(spark, sf).groupBy("session_id").agg(F.min("ts").alias("at")).select("at", F.lit(0).alias("side"), F.col("session_id").alias("id"), F.lit(None).cast("long").alias("n"))
    a = tb.atoms(spark, sf).select(F.col("created_at").alias("at"), F.lit(1).alias("side"), F.col("n").cast("string").alias("id"), "n")
    counted = sums_before(starts.unionByName(a), [], [F.desc("at"), "side", "id"], (1 - F.col("side")).cast("long"), "sessions")
    return counted.where("side = 1").select("n", "sessions")


@query("A1_counts", ATOMS, EDGES, sql="SELECT 'type' AS what, type AS v, count(*) AS n FROM atoms GROUP BY type UNION ALL SELECT 'relation', rel, count(*) FROM edges GROUP BY rel")
def a1(spark, sf):
    a = tb.atoms(spark, sf).groupBy(F.col("type").alias("v")).count()
    r = tb.edges(spark, sf).groupBy(F.col("rel").alias("v")).count()
    return a.select(F.lit("type").alias("what"), "v", F.col("count").alias("n")).union(r.select(F.lit("relation"), "v", "count"))


@query("A2_citations", EDGES, sql="SELECT tgt, count(*) AS cited, count(DISTINCT src) AS sources FROM edges GROUP BY tgt ORDER BY cited DESC, tgt LIMIT 10")
def a2(spark, sf):
    return tb.edges(spark, sf).groupBy("tgt").agg(F.count(F.lit(1)).alias("cited"), F.countDistinct("src").alias("sources")).orderBy(F.desc("cited"), "tgt").limit(10)


@query("A3_latest_event", LOG, sql="SELECT ref, max(epoch(ts))::BIGINT AS last FROM log GROUP BY ref")
def a3(spark, sf):
    return tb.log(spark, sf).groupBy("ref").agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last"))


@query("A4_latest_mutation", LOG, sql="SELECT ref, max(event_id) AS event_id, arg_max(session_id, event_id) AS session_id FROM log WHERE action = 'atom_updated' GROUP BY ref")
def a4(spark, sf):
    return tb.log(spark, sf).where("action = 'atom_updated'").groupBy("ref").agg(F.max("event_id").alias("event_id"), F.max_by("session_id", "event_id").alias("session_id"))


USE = """use AS (SELECT ref, count(*) FILTER (action = 'atom_read') AS n_access, max(ts) FILTER (action = 'atom_read') AS last_read,
  count(DISTINCT session_id) FILTER (action = 'atom_read') AS sessions, count(*) FILTER (action = 'conflict_detected') AS n_conflict FROM log GROUP BY ref)"""


def usage(spark, sf):
    read = F.col("action") == "atom_read"
    return tb.log(spark, sf).groupBy("ref").agg(
        F.count_if(read).alias("n_access"), F.max(F.when(read, F.col("ts"))).alias("last_read"),
        F.countDistinct(F.when(read, F.col("session_id"))).alias("sessions"), F.count_if(F.col("action") == "conflict_detected").alias("n_conflict"),
    )


@query("A5_usage_counters", LOG, USE, sql="SELECT ref, n_access, sessions, n_conflict FROM use")
def a5(spark, sf):
    return usage(spark, sf).drop("last_read")


@query("A6_session_starts", LOG, sql="SELECT session_id, min(epoch(ts))::BIGINT AS start FROM log GROUP BY session_id")
def a6(spark, sf):
    return tb.log(spark, sf).groupBy("session_id").agg(F.min(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("start"))


@query("A8_pass_rates", sql="SELECT lang, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def a8(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", "lang").join(tb.table(spark, sf, "labels"), "doc_id")
    return d.rollup("lang").agg(F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


CADENCE = """runs AS (SELECT event_type AS cat, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY ALL),
  base AS (SELECT *, avg(rate) OVER (PARTITION BY cat ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prior FROM runs)"""


@query("A9_eval_cadence", CADENCE, sql="SELECT cat, day, round(rate, 6) AS rate, round(prior, 6) AS prior, CASE WHEN prior - rate >= 0.10 THEN 'drop' WHEN rate - prior >= 0.15 THEN 'improve' ELSE 'steady' END AS alert FROM base WHERE prior IS NOT NULL")
def a9(spark, sf):
    e = tb.table(spark, sf, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    runs = e.groupBy(F.col("event_type").alias("cat"), day.alias("day")).agg(F.avg(F.when(F.col("value") > 10, 1.0).otherwise(0.0)).alias("rate"))
    b = runs.withColumn("prior", F.avg("rate").over(Window.partitionBy("cat").orderBy("day").rangeBetween(-7, -1))).where("prior is not null")
    alert = F.when(F.col("prior") - F.col("rate") >= 0.10, "drop").when(F.col("rate") - F.col("prior") >= 0.15, "improve").otherwise("steady")
    return b.select("cat", "day", F.round("rate", 6).alias("rate"), F.round("prior", 6).alias("prior"), alert.alias("alert"))


CLOSURE = """clo AS (SELECT (SELECT count(*) FROM atoms) AS atom_count, (SELECT count(*) FROM atoms WHERE type = 'belief') AS belief_count, (SELECT count(*) FROM edges) AS relations)"""


def closure(spark, sf):
    a = tb.atoms(spark, sf).agg(F.count(F.lit(1)).alias("atom_count"), F.count_if(F.col("type") == "belief").alias("belief_count"))
    return a.crossJoin(tb.edges(spark, sf).agg(F.count(F.lit(1)).alias("relations")))  # one row each


@query("A10_closure", ATOMS, EDGES, CLOSURE, sql="""SELECT atom_count, belief_count, round(100.0 * belief_count / atom_count, 2) AS belief_pct, round(relations / atom_count, 2) AS avg_relations,
  round(100.0 * belief_count / atom_count * (relations / atom_count) / 100, 2) AS closure_index, CASE WHEN atom_count < 20 THEN 'early' WHEN 100.0 * belief_count / atom_count < 60 THEN 'type-composition' ELSE 'entanglement' END AS phase FROM clo""")
def a10(spark, sf):
    pct, rel = 100.0 * F.col("belief_count") / F.col("atom_count"), F.col("relations") / F.col("atom_count")
    phase = F.when(F.col("atom_count") < 20, "early").when(pct < 60, "type-composition").otherwise("entanglement")
    return closure(spark, sf).select("atom_count", "belief_count", F.round(pct, 2).alias("belief_pct"), F.round(rel, 2).alias("avg_relations"), F.round(pct * rel / 100, 2).alias("closure_index"), phase.alias("phase"))


@query("M7_predictions", ATOMS, EDGES, CLOSURE, sql="""SELECT CASE WHEN belief_count / atom_count * relations / atom_count < 3 THEN 'reliable' ELSE 'degraded' END AS classification,
  CASE WHEN belief_count / atom_count * relations / atom_count < 2 THEN 'reliable' ELSE 'degraded' END AS transplant FROM clo""")
def m7(spark, sf):
    index = F.col("belief_count") / F.col("atom_count") * F.col("relations") / F.col("atom_count")
    return closure(spark, sf).select(F.when(index < 3, "reliable").otherwise("degraded").alias("classification"), F.when(index < 2, "reliable").otherwise("degraded").alias("transplant"))


@query("A11_trajectory", ATOMS, sql="""SELECT day, (sum(a) OVER (ORDER BY day))::BIGINT AS atoms, (sum(b) OVER (ORDER BY day))::BIGINT AS beliefs FROM (
  SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS a, count(*) FILTER (type = 'belief') AS b FROM atoms GROUP BY 1)""")
def a11(spark, sf):
    days = tb.atoms(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("type") == "belief").alias("b"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    return days.select("day", F.sum("a").over(w).alias("atoms"), F.sum("b").over(w).alias("beliefs"))


@query("A12_composition", ATOMS, sql="SELECT type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () > 0.8 AS skewed FROM atoms WHERE status = 'active' GROUP BY type")
def a12(spark, sf):
    a = tb.atoms(spark, sf).where("status = 'active'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # nine types
    return a.select("type", "n", F.round(share, 6).alias("share"), (share > 0.8).alias("skewed"))


@query("W1_content_duplicates", ATOMS, sql=f"""SELECT n FROM (SELECT n, row_number() OVER (PARTITION BY type, trim(body, ' ' || chr(10) || chr(9) || chr(13)) ORDER BY updated_at DESC, n) AS r FROM atoms WHERE status NOT IN ('archived', 'expired')) WHERE r > 1""")
def w1(spark, sf):
    a = tb.atoms(spark, sf).where("status not in ('archived', 'expired')")
    body = F.md5(F.regexp_replace("body", r"^[ \n\t\r]+|[ \n\t\r]+$", ""))
    w = Window.partitionBy("type", "h").orderBy(F.desc("updated_at"), "n")
    return a.select("n", "type", "updated_at", body.alias("h")).withColumn("r", F.row_number().over(w)).where("r > 1").select("n")


@query("W2_id_duplicates", ATOMS, sql="SELECT id, n AS survivor FROM (SELECT atom_id[1:15] AS id, n, row_number() OVER (PARTITION BY atom_id[1:15] ORDER BY updated_at DESC, n) AS r FROM atoms) WHERE r = 1")
def w2(spark, sf):
    a = tb.atoms(spark, sf).select(F.substring("atom_id", 1, 15).alias("id"), "n", "updated_at")
    return a.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated_at"), "n"))).where("r = 1").select("id", F.col("n").alias("survivor"))


@query("W3_compaction", LOG, sql="SELECT event_id FROM log WHERE action <> 'atom_updated' OR event_id IN (SELECT max(event_id) FROM log WHERE action = 'atom_updated' GROUP BY ref)")
def w3(spark, sf):
    e = tb.log(spark, sf)
    last = e.where("action = 'atom_updated'").groupBy("ref").agg(F.max("event_id").alias("event_id")).select("event_id").distinct()
    return e.where("action <> 'atom_updated'").select("event_id").unionByName(e.select("event_id").join(last, "event_id", "left_semi"))


@query("W4_first_agent", LOG, sql="SELECT ref, arg_min(session_id, event_id) AS first_session FROM log GROUP BY ref")
def w4(spark, sf):
    return tb.log(spark, sf).groupBy("ref").agg(F.min_by("session_id", "event_id").alias("first_session"))


SEEDS = "seeds AS (SELECT n, type, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, n) AS r, min(n) OVER (PARTITION BY type) AS o FROM atoms)"


@query("W5_round_robin", ATOMS, SEEDS, sql="SELECT n, type, r FROM seeds ORDER BY r, o, type LIMIT 12")
def w5(spark, sf):
    a = tb.atoms(spark, sf).select("n", "type", "confidence")
    first = a.groupBy("type").agg(F.min("n").alias("o"))
    r = a.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("confidence"), "n"))).where("r <= 12")
    return r.join(first, "type").orderBy("r", "o", "type").limit(12).select("n", "type", "r")


@query("W6_same_second", ATOMS, sql="SELECT n, c FROM (SELECT n, count(*) OVER (PARTITION BY updated_at) AS c FROM atoms) WHERE c >= 3")
def w6(spark, sf):
    a = tb.atoms(spark, sf).select("n", "updated_at")
    c = a.groupBy("updated_at").agg(F.count(F.lit(1)).alias("c")).where("c >= 3")
    return a.join(c, "updated_at").select("n", "c")


@query("W7_last_session", LOG, sql="SELECT event_id, action FROM log WHERE session_id = (SELECT arg_max(session_id, event_id) FROM log) ORDER BY event_id DESC LIMIT 20")
def w7(spark, sf):
    e = tb.log(spark, sf)
    last = e.agg(F.max_by("session_id", "event_id").alias("session_id"))
    return e.join(F.broadcast(last), "session_id").orderBy(F.desc("event_id")).limit(20).select("event_id", "action")


@query("T1_status_sort", ATOMS, sql="SELECT n, status FROM atoms ORDER BY list_position(['active', 'draft', 'accepted', 'resolved', 'rejected', 'superseded', 'archived', 'expired'], status), updated_at DESC, n LIMIT 50")
def t1(spark, sf):
    return tb.atoms(spark, sf).orderBy(fl.priority(), F.desc("updated_at"), "n").limit(50).select("n", "status")


@query("U1_merge_logs", LOG, sql="SELECT DISTINCT event_id, action FROM (SELECT * FROM log WHERE event_id % 3 <> 0 UNION ALL SELECT * FROM log WHERE event_id % 3 <> 1)")
def u1(spark, sf):
    e = tb.log(spark, sf)
    local, remote = e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1")
    return local.unionByName(remote.join(local.select("event_id"), "event_id", "left_anti")).select("event_id", "action")


@query("U4_reference_union", EDGES, sql="SELECT DISTINCT src, tgt FROM (SELECT src, tgt FROM edges UNION ALL SELECT src, tgt FROM edges WHERE src % 2 = 0 UNION ALL SELECT tgt, src FROM edges)")
def u4(spark, sf):
    e = tb.edges(spark, sf).select("src", "tgt")
    return e.union(e.where("src % 2 = 0")).union(e.select("tgt", "src")).dropDuplicates(["src", "tgt"])


@query("U6_vanished", sql="SELECT DISTINCT event_type AS cat FROM events EXCEPT SELECT event_type FROM events WHERE value > 40")
def u6(spark, sf):
    e = tb.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("cat")).distinct().join(e.where("value > 40").select(F.col("event_type").alias("cat")).distinct(), "cat", "left_anti")


@query("A13_document_frequency", ATOMS, VIS, sql="SELECT term, count(*) AS df FROM (SELECT DISTINCT n, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS term FROM vis) GROUP BY term HAVING count(*) >= 5")
def a13(spark, sf):
    v = tb.atoms(spark, sf).where(fl.visible())
    words = v.select("n", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 5")


AGE = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400.0"


def age(column="created_at", at=AS_OF):
    return (F.unix_timestamp(tb.clock(at).cast("timestamp")) - F.unix_timestamp(F.col(column).cast("timestamp"))) / 86400.0


@query("X1_scores", ATOMS, sql=f"SELECT n, round(pow(0.5, greatest({AGE}, 0) / 30), 6) AS decay, round(0.7 + 0.3 * confidence, 6) AS conf_factor, ceil(length(body) / 4)::BIGINT AS tokens, len(list_filter(regexp_split_to_array(body, '[ \\n\\t\\r]+'), lambda x: x <> '')) AS words, floor({AGE})::BIGINT AS age_days FROM atoms")
def x1(spark, sf):
    words = F.size(F.filter(F.split("body", "[ \n\t\r]+"), lambda x: x != ""))
    return tb.atoms(spark, sf).select(
        "n", F.round(F.pow(F.lit(0.5), F.greatest(age(), F.lit(0)) / 30), 6).alias("decay"), F.round(0.7 + 0.3 * F.col("confidence"), 6).alias("conf_factor"),
        F.ceil(F.length("body") / 4).alias("tokens"), words.alias("words"), F.floor(age()).alias("age_days"),
    )


@query("X10_titles", ATOMS, sql="SELECT n, left(trim(list_filter(string_split(body, chr(10)), lambda l: trim(l) <> '')[1]), 80) AS title FROM atoms")
def x10(spark, sf):
    return tb.atoms(spark, sf).select("n", title().alias("title"))


def title(body="body"):
    return F.substring(F.trim(F.get(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), 0)), 1, 80)


@query("X14_slugs", ATOMS, sql="SELECT n, array_to_string(string_split(atom_id, '-')[5:-2], '-') AS slug, lower(regexp_replace(source, '[^A-Za-z0-9]+', '-', 'g')) AS s FROM atoms JOIN documents ON n = doc_id")
def x14(spark, sf):
    parts = F.split("atom_id", "-")
    s = F.lower(F.regexp_replace(F.element_at("tags", 2), "[^A-Za-z0-9]+", "-"))
    return tb.atoms(spark, sf).select("n", F.array_join(F.slice(parts, 5, F.size(parts) - 5), "-").alias("slug"), s.alias("s"))


@query("X19_inferred_type", ATOMS, sql="""SELECT n, CASE WHEN regexp_matches(lower(body), 'licen[cs]e') THEN 'constraint' WHEN regexp_matches(lower(body), 'token =') THEN 'fact' WHEN regexp_matches(body, '\\?') THEN 'open_question' ELSE 'belief' END AS inferred FROM atoms""")
def x19(spark, sf):
    low = F.lower("body")
    return tb.atoms(spark, sf).select("n", F.when(low.rlike("licen[cs]e"), "constraint").when(low.rlike("token ="), "fact").when(F.col("body").rlike("\\?"), "open_question").otherwise("belief").alias("inferred"))


@query("X23_reconciled", ATOMS, sql="SELECT n, round(least(greatest(confidence + CASE WHEN 0.6 < confidence THEN 0.08 ELSE 0.03 END * (0.6 - confidence), 0), 1), 4) AS reconciled FROM atoms")
def x23(spark, sf):
    rate = F.when(F.col("confidence") > 0.6, 0.08).otherwise(0.03)
    return tb.atoms(spark, sf).select("n", F.round(F.least(F.greatest(F.col("confidence") + rate * (0.6 - F.col("confidence")), F.lit(0)), F.lit(1)), 4).alias("reconciled"))


@query("X31_line_diff", sql="""WITH l AS (SELECT doc_id % 50 AS g, doc_id % 2 AS side, unnest(string_split(text, chr(10))) AS line FROM documents),
  c AS (SELECT g, line, count(*) FILTER (side = 1) - count(*) FILTER (side = 0) AS d FROM l GROUP BY g, line)
  SELECT g, sum(greatest(d, 0))::BIGINT AS added, sum(greatest(-d, 0))::BIGINT AS removed FROM c GROUP BY g""")
def x31(spark, sf):
    d = tb.table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("g"), (F.col("doc_id") % 2).alias("side"), F.explode(F.split("text", "\n")).alias("line"))
    c = d.groupBy("g", "line").agg(F.sum(F.when(F.col("side") == 1, 1).otherwise(-1)).alias("d"))
    return c.groupBy("g").agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


@query("M1_lookup", ATOMS, sql="SELECT n, atom_id FROM atoms WHERE atom_id LIKE '%-000042'")
def m1(spark, sf):
    return tb.atoms(spark, sf).where(F.col("atom_id").endswith("-000042")).select("n", "atom_id")


@query("M2_known_ids", ATOMS, sql="SELECT DISTINCT atom_id FROM atoms")
def m2(spark, sf):
    return tb.atoms(spark, sf).select("atom_id").distinct()


@query("M4_active_conflicts", ATOMS, VIS, sql="SELECT n FROM vis WHERE type = 'conflict' AND status = 'active'")
def m4(spark, sf):
    return fl.candidates(tb.atoms(spark, sf), types=("conflict",), statuses=("active",)).select("n")


@query("M9_ttl_backfill", ATOMS, sql="SELECT n, CASE type WHEN 'fact' THEN 120 WHEN 'decision' THEN 180 END AS ttl FROM atoms WHERE ttl_days IS NULL AND type IN ('fact', 'decision')")
def m9(spark, sf):
    return tb.atoms(spark, sf).where("ttl_days is null and type in ('fact', 'decision')").select("n", F.when(F.col("type") == "fact", 120).otherwise(180).alias("ttl"))
