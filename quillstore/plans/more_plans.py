"""Write path, rendering, query routing, and the parts of larger operators as queries of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classify as cl
from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import ranking as rk
from ..sources import files, header
from ..sources import schema as sc
from ..sources import tables as tb
from ..sources.eventlog import EventLog
from ..sources.scratch import shared_dir
from ..sources.tables import ATOMS, EDGES, EPISODES, LOG
from .graph_plans import BASE, GROUND, NEAR, WALK, grounding, nodes_of, walk
from .recall_plans import _DOT, BOOST, CHAIN, RANKED, SCORES, ranked_of, signals_of
from .registry import query
from .store_plans import AGE, CAND, GRAPH, USE, VIS, age


def _texts(spark, sf):
    """Atoms as file texts."""
    return tb.atoms(spark, sf).select("n", files.atom_text().alias("value"))


_FIELDS = "atom_id, type, status, confidence, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated, classification, ttl_days, array_to_string(list_sort(list_distinct(tags)), '|') AS tags, md5(body) AS body"


@query("S2_front_matter", ATOMS, sql=f"SELECT n, {_FIELDS} FROM atoms")
def s2(spark, sf):
    """Texts written and read back: header fields and body."""
    got = files.parse_atoms(_texts(spark, sf).select(F.col("n").alias("path"), "value"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return got.select(F.col("path").alias("n"), "atom_id", "type", "status", "confidence", at("created_at").alias("created"), at("updated_at").alias("updated"), "classification", "ttl_days", F.array_join("tags", "|").alias("tags"), F.md5("body").alias("body"))


@query("S2_headers", ATOMS, EDGES, sql="""SELECT a.n, a.atom_id, a.type, a.status, a.confidence, a.ttl_days, array_to_string(a.tags, '|') AS tags, array_to_string(a.paths, '|') AS paths,
  coalesce(r.relations, '') AS relations, md5(a.body) AS body FROM atoms a LEFT JOIN (SELECT src, string_agg(rel || ' ' || t.atom_id, '|' ORDER BY rel, t.atom_id) AS relations FROM edges JOIN atoms t ON t.n = tgt GROUP BY src) r ON r.src = a.n""")
def s2_headers(spark, sf):
    """Files with nested scopes and lists of relations, written as YAML and read back."""
    a = tb.atoms(spark, sf)
    ids = a.select(F.col("n").alias("tgt"), F.col("atom_id").alias("target"))
    links = tb.edges(spark, sf).join(ids, "tgt").groupBy(F.col("src").alias("n")).agg(F.array_sort(F.collect_list(F.struct("rel", "target"))).alias("links"))  # an atom's own
    relations = F.transform(F.coalesce("links", F.array().cast("array<struct<rel:string,target:string>>")), lambda x: F.struct(x["target"].alias("target"), x["rel"].alias("type")))
    head = F.struct(F.col("atom_id").alias("id"), "type", "status", "confidence", "ttl_days", F.struct("tags", "paths").alias("scope"), relations.alias("relations"))
    texts = a.join(links, "n", "left").select("n", header.rendered(F.to_json(head, {"ignoreNullFields": "false"}), "body").alias("text"))
    kind = "id string, type string, status string, confidence double, ttl_days int, scope struct<tags: array<string>, paths: array<string>>, relations array<struct<target: string, type: string>>"
    got = texts.select("n", header.parsed("text").alias("x")).select("n", F.from_json("x.header", kind).alias("h"), "x.body")
    listed = F.array_join(F.transform("h.relations", lambda r: F.concat(r["type"], F.lit(" "), r["target"])), "|")
    return got.select("n", F.col("h.id").alias("atom_id"), "h.type", "h.status", "h.confidence", "h.ttl_days", F.array_join("h.scope.tags", "|").alias("tags"), F.array_join("h.scope.paths", "|").alias("paths"), listed.alias("relations"), F.md5("body").alias("body"))


@query("S4_atom_text", ATOMS, sql="""SELECT n, md5('---' || chr(10) || 'id: ' || atom_id || chr(10) || 'type: ' || type || chr(10) || 'status: ' || status || chr(10) || 'confidence: ' || confidence::DOUBLE || chr(10)
  || 'created_at: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'updated_at: ' || strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'classification: ' || coalesce(classification, 'null') || chr(10)
  || 'ttl_days: ' || coalesce(ttl_days::VARCHAR, 'null') || chr(10) || 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10) || 'paths: [' || array_to_string(paths, ', ') || ']' || chr(10) || '---' || chr(10) || body) AS h FROM atoms""")
def s4(spark, sf):
    return _texts(spark, sf).select("n", F.md5("value").alias("h"))


@query("S8_valid_events", LOG, sql="SELECT event_id, ref IS NOT NULL AND session_id <> '' AND action IN ('atom_read', 'atom_updated', 'session_started') AS valid FROM log")
def s8(spark, sf):
    """Which events an append would accept: the action is known, and refs and session are there."""
    ok = F.col("ref").isNotNull() & (F.col("session_id") != "") & F.col("action").isin("atom_read", "atom_updated", "session_started")
    return tb.log(spark, sf).select("event_id", ok.alias("valid"))


@query("S8_append", LOG, sql="SELECT action, count(*) AS events, count(DISTINCT ref) AS refs, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS first FROM log GROUP BY action")
def s8_append(spark, sf):
    """The log appended in three batches that overlap, one of them twice: each event is there once."""
    e = tb.log(spark, sf)
    rows = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("agent").alias("agent_id"), "session_id", "action",
        F.array(F.col("ref").cast("string")).alias("atom_refs"), F.lit(1).alias("schema_version"), F.lit(None).cast("string").alias("atom_snapshot"),
    )
    log = EventLog(spark, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}")
    log.append(rows.where("action <> 'session_started'"), batch=0)
    log.append(rows.where("action in ('atom_updated', 'session_started')"), batch=1)
    log.append(rows, batch=1)
    log.append(rows, batch=2)
    return log.read().groupBy("action").agg(F.count(F.lit(1)).alias("events"), F.countDistinct(F.col("atom_refs")[0]).alias("refs"), F.min("timestamp").alias("first"))


@query("S18_sealed_atoms", ATOMS, sql="SELECT n, md5(body) AS h, true AS hidden FROM atoms WHERE classification = 'SECRET'")
def s18(spark, sf):
    """Secret bodies encrypted and decrypted again."""
    a = tb.atoms(spark, sf).where("classification = 'SECRET'").select("n", "body", files.seal(F.col("body"), F.lit("k" * 32)).alias("sealed"))
    return a.select("n", F.md5(files.unseal(F.col("sealed"), F.lit("k" * 32))).alias("h"), (~F.contains("sealed", "body")).alias("hidden"))


@query("X2_confidence_factor", ATOMS, sql="SELECT n, round(0.7 + 0.3 * confidence, 6) AS factor FROM atoms")
def x2(spark, sf):
    return tb.atoms(spark, sf).select("n", F.round(sc.CONFIDENCE_FLOOR + (1 - sc.CONFIDENCE_FLOOR) * F.col("confidence"), 6).alias("factor"))


@query("X3_token_estimate", ATOMS, sql="SELECT n, ceil((length(body) + length('{\"id\":\"' || atom_id || '\",\"type\":\"' || type || '\",\"status\":\"' || status || '\",\"tags\":[\"' || array_to_string(tags, '\",\"') || '\"]}')) / 4)::BIGINT AS tokens FROM atoms")
def x3(spark, sf):
    """A body and its header as JSON, four characters a token."""
    head = F.to_json(F.struct(F.col("atom_id").alias("id"), "type", "status", "tags"))
    return tb.atoms(spark, sf).select("n", F.ceil((F.length("body") + F.length(head)) / 4).alias("tokens"))


@query("X4_word_count", ATOMS, sql="SELECT n, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS words FROM atoms")
def x4(spark, sf):
    return tb.atoms(spark, sf).select("n", F.size(F.filter(F.split("body", "\\s+"), lambda x: x != "")).alias("words"))


_TRI = "list_distinct(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3]))"


@query("X6_text_jaccard", ATOMS, EDGES, f"g AS (SELECT n, CASE WHEN len(w) >= 3 THEN {_TRI} ELSE [] END AS g FROM (SELECT n, list_filter(regexp_split_to_array(trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '\\s+'), lambda x: x <> '') AS w FROM atoms))",
       sql="SELECT src, tgt, CASE WHEN len(a.g) = 0 AND len(b.g) = 0 THEN 1.0 WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0 ELSE round(len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)), 6) END AS jaccard FROM edges JOIN g a ON a.n = src JOIN g b ON b.n = tgt")
def x6(spark, sf):
    """Similarity of the word trigrams of related atoms; two empty sets are alike."""
    w = F.filter(F.split(F.regexp_replace(F.lower("body"), "[^\\p{L}\\p{N}\\s]", ""), "\\s+"), lambda x: x != "")
    grams = F.expr("if(size(w) < 3, cast(array() as array<bigint>), array_distinct(transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))))")
    g = tb.atoms(spark, sf).select("n", w.alias("w")).select("n", grams.alias("g"))
    a, b = g.select(F.col("n").alias("src"), F.col("g").alias("a")), g.select(F.col("n").alias("tgt"), F.col("g").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    j = F.when((F.size("a") == 0) & (F.size("b") == 0), 1.0).otherwise(both / F.greatest(F.size("a") + F.size("b") - both, F.lit(1)))
    return tb.edges(spark, sf).join(a, "src").join(b, "tgt").select("src", "tgt", F.round(j, 6).alias("jaccard"))


@query("X8_tag_dissimilarity", ATOMS, EDGES, sql="SELECT src, tgt, round(1 - len(list_intersect(a.tags, b.tags)) / len(list_distinct(a.tags || b.tags)), 6) AS apart FROM edges JOIN atoms a ON a.n = src JOIN atoms b ON b.n = tgt WHERE len(a.tags || b.tags) > 0")
def x8(spark, sf):
    t = tb.atoms(spark, sf)
    a, b = t.select(F.col("n").alias("src"), F.col("tags").alias("a")), t.select(F.col("n").alias("tgt"), F.col("tags").alias("b"))
    rows = tb.edges(spark, sf).join(a, "src").join(b, "tgt").where(F.size(F.array_union("a", "b")) > 0)
    return rows.select("src", "tgt", F.round(1 - F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("apart"))


@query("X15_body_hash", ATOMS, sql="""SELECT n, CASE WHEN h >= 2147483648 THEN '-' || lower(to_base(4294967296 - h, 36)) ELSE lower(to_base(h, 36)) END AS hash
  FROM (SELECT n, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(body, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM atoms WHERE body <> '')""")
def x15(spark, sf):
    """The 32-bit rolling hash of a body, by 31, in base 36."""
    h = F.aggregate(F.split("body", ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 31 + F.ascii(c)) % 4294967296))
    a = tb.atoms(spark, sf).where("body <> ''").select("n", h.alias("h"))
    text = lambda x: F.lower(F.conv(x.cast("string"), 10, 36))
    return a.select("n", F.when(F.col("h") >= 2147483648, F.concat(F.lit("-"), text(4294967296 - F.col("h")))).otherwise(text(F.col("h"))).alias("hash"))


@query("X16_sha256", ATOMS, sql="SELECT n, sha256(body) AS hash FROM atoms")
def x16(spark, sf):
    return tb.atoms(spark, sf).select("n", F.sha2("body", 256).alias("hash"))


@query("X18_term_sanitiser", ATOMS, sql="SELECT n, md5(trim(regexp_replace(regexp_replace(regexp_replace(body, '[\"*()^:\\-]', ' ', 'g'), '\\b(AND|OR|NOT|NEAR)\\b', ' ', 'g'), '\\s+', ' ', 'g'))) AS term FROM atoms")
def x18(spark, sf):
    clean = F.regexp_replace(F.regexp_replace("body", '["*()^:\\-]', " "), "\\b(AND|OR|NOT|NEAR)\\b", " ")
    return tb.atoms(spark, sf).select("n", F.md5(F.trim(F.regexp_replace(clean, "\\s+", " "))).alias("term"))


QUESTIONS = (
    "When did I last visit Rome?", "How long ago did we move, and what is my job?", "What is my favorite food?", "How do I list the files step by step?",
    "What did you suggest in our last conversation?", "Do you remember what we talked about before?", "Is she still married?", "How old am I according to the code for age?",
    "What  are\nthe command and the port?", "Tell me a story", "",
)
_VALUES = "questions AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i - len(QUESTIONS), q.replace("'", "''")) for i, q in enumerate(QUESTIONS)) + ") q(id, text) UNION ALL SELECT conv_id * 100000 + turn, text FROM conversations WHERE role = 'user')"
_FLAT = "regexp_replace(left(text, 10000), '\\s+', ' ', 'g')"
_SCORE = {k: " + ".join("regexp_matches(flat, '(?i){}')::INT".format(p.replace("'", "''")) for p in v) for k, v in cl.FAMILIES.items()}
ROUTES = f"flats AS (SELECT id, {_FLAT} AS flat FROM questions), points AS (SELECT id, " + ", ".join(f'{v} AS "{k}"' for k, v in _SCORE.items()) + ' FROM flats), sums AS (SELECT *, temporal + personal + preference + "multi-session" + assistant AS o FROM points)'
_KINDS = "CASE WHEN retrieval > o THEN 'knowledge-update' WHEN o > retrieval THEN CASE greatest(temporal, personal, preference, \"multi-session\", assistant) " + " ".join(f'WHEN "{k}" THEN \'{n}\'' for k, n in sorted(cl.KINDS.items(), key=lambda x: x[1])) + " END END"


@query("X21_query_route", _VALUES, ROUTES, sql=f"SELECT id, CASE WHEN retrieval > o THEN 'retrieval' WHEN o > retrieval THEN 'observer' ELSE 'hybrid' END AS route, round(CASE WHEN retrieval > o THEN least(0.9, 0.4 + retrieval * 0.15) WHEN o > retrieval THEN least(0.9, 0.5 + o * 0.1) WHEN o = 0 THEN 0.3 ELSE 0.4 END, 6) AS confidence, {_KINDS} AS kind FROM sums")
def x21(spark, sf):
    mine = spark.createDataFrame([(i - len(QUESTIONS), q) for i, q in enumerate(QUESTIONS)], "id long, text string")
    asked = tb.table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    each = cl.scores("text")
    rows = mine.unionByName(asked).select("id", *[v.alias(k) for k, v in each.items()])
    named = {k: F.col(f"`{k}`") for k in each}
    o, r = sum((named[k] for k in cl.KINDS), F.lit(0)), named["retrieval"]
    return rows.select("id", cl.route(o, r).alias("route"), F.round(cl.confidence(o, r), 6).alias("confidence"), cl.kind(o, r, named).alias("kind"))


@query("X22_quadrants", ATOMS, LOG, USE, GROUND, sql="SELECT n, quadrant FROM quad")
def x22(spark, sf):
    return grounding(spark, sf).select("n", "quadrant")


@query("X25_base_boost", ATOMS, EDGES, VIS, GRAPH, BASE, sql="SELECT n, round(1 / sqrt(1 + exp(-base)), 6) AS boost FROM base")
def x25(spark, sf):
    return nodes_of(spark, sf).select("n", F.round(1 / F.sqrt(1 + F.exp(-F.col("base"))), 6).alias("boost"))


@query("X26_age_and_expiry", ATOMS, sql=f"SELECT n, floor({AGE})::BIGINT AS age_days, floor(ttl_days - {AGE})::BIGINT AS days_left FROM atoms")
def x26(spark, sf):
    return tb.atoms(spark, sf).select("n", F.floor(age()).alias("age_days"), F.floor(F.col("ttl_days") - age()).alias("days_left"))


@query("X28_bounded_text", EPISODES, sql="SELECT episode, replace(replace(CASE WHEN length(summary) > 500 THEN right(summary, 500) ELSE summary END, '<', '&lt;'), '>', '&gt;') AS tail, length(summary) > 500 AS cut FROM episodes")
def x28(spark, sf):
    """The last 500 characters of a text, marks escaped."""
    tail = F.right("summary", F.lit(500))
    return tb.episodes(spark, sf).select("episode", F.replace(F.replace(tail, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("tail"), (F.length("summary") > 500).alias("cut"))


@query("R8_semantic_scores", sql=f"""SELECT 'v' || q.vec_id AS query_id, e.vec_id AS n, round({_DOT}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND round({_DOT}, 6) >= 0.3""")
def r8(spark, sf):
    """All vectors at 0.3 or more to each query's, by blocks of vectors and queries."""
    e = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("v"))
    return rk.knn(e, e.where("n % 100 = 0").select(F.concat(F.lit("v"), "n"), "v"), k=None)


@query("R14_reservation_rule", sql="""SELECT conv_id, has_task, explicit, CASE explicit WHEN 'on' THEN true WHEN 'off' THEN false ELSE NOT has_task END AS reserved FROM (
  SELECT conv_id, count(*) FILTER (role = 'user' AND trim(text) <> '') > 0 AS has_task, CASE arg_min(role, turn) WHEN 'system' THEN 'on' WHEN 'assistant' THEN 'off' ELSE 'unset' END AS explicit FROM conversations GROUP BY conv_id)""")
def r14(spark, sf):
    """Quotas apply without a task, unless the caller says. A conversation's user turns are its task; who opens it says."""
    c = tb.table(spark, sf, "conversations").groupBy("conv_id").agg(
        (F.count_if((F.col("role") == "user") & (F.trim("text") != "")) > 0).alias("has_task"), F.min_by("role", "turn").alias("opens")
    )
    explicit = F.when(F.col("opens") == "system", "on").when(F.col("opens") == "assistant", "off").otherwise("unset")
    rows = c.select("conv_id", "has_task", explicit.alias("explicit"))
    return rows.withColumn("reserved", F.when(F.col("explicit") == "unset", ~F.col("has_task")).otherwise(F.col("explicit") == "on"))


HYBRID = "q2 AS (SELECT 'q' || (vec_id + 1) AS query_id, embedding AS q FROM embeddings WHERE vec_id < 3), sem AS (SELECT query_id, vec_id AS n, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(q::DOUBLE[], q::DOUBLE[])), 6) AS sem FROM embeddings, q2)"


@query("R18_hybrid_recall", *CHAIN, HYBRID, sql="SELECT query_id, n, round(coalesce(fts, 0) * 0.4 + coalesce(sem, 0) * 0.6, 6) AS relevance FROM (SELECT query_id, n, fts FROM sig) FULL JOIN (SELECT * FROM sem WHERE sem >= 0.3) USING (query_id, n) WHERE n IN (SELECT n FROM cand)")
def r18(spark, sf):
    """Words and vectors together: each query has a vector too, and either signal lets an atom in."""
    e = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("v"))
    q = F.broadcast(e.where("n < 3").select(F.concat(F.lit("q"), F.col("n") + 1).alias("query_id"), F.col("v").alias("q")))  # a vector for each of three queries
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    sem = e.join(q).select("query_id", "n", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 6).alias("sem")).where("sem >= 0.3")
    both = signals_of(spark, sf).select("query_id", "n", "fts").join(sem, ["query_id", "n"], "full")
    cand = fl.candidates(tb.atoms(spark, sf)).select("n")
    return both.join(cand, "n", "left_semi").select("query_id", "n", F.round(F.coalesce("fts", F.lit(0.0)) * 0.4 + F.coalesce("sem", F.lit(0.0)) * 0.6, 6).alias("relevance"))


@query("R21_read_audit", *CHAIN, EDGES, SCORES, BOOST, RANKED, sql="SELECT query_id, 'atom_read' AS action, count(*) AS refs, min(n) AS first_ref FROM ranked WHERE rank <= 20 GROUP BY query_id")
def r21(spark, sf):
    """The event that a recall writes: which atoms it read."""
    top = ranked_of(spark, sf).where("rank <= 20")
    return top.groupBy("query_id").agg(F.lit("atom_read").alias("action"), F.count(F.lit(1)).alias("refs"), F.min("n").alias("first_ref"))


@query("T5_lateral_inhibition", ATOMS, EDGES, VIS, GRAPH, NEAR, BASE, *WALK, sql="SELECT n, round(act, 6) AS act FROM act1")
def t5(spark, sf):
    """The first step's strongest twenty nodes above the threshold."""
    from .graph_plans import graph_edges, seeds_of

    return gr.spread(nodes_of(spark, sf), graph_edges(spark, sf), seeds_of(spark, sf), steps=1).select("n", F.round("act", 6).alias("act"))


@query("J16_active_pairs", ATOMS, EDGES, VIS, GRAPH, NEAR, BASE, *WALK, sql="SELECT x.n AS a, y.n AS b FROM act3 x JOIN act3 y ON x.n < y.n")
def j16(spark, sf):
    """Pairs of the active nodes, twenty at most."""
    active = walk(spark, sf)
    return active.select(F.col("n").alias("a")).join(F.broadcast(active.select(F.col("n").alias("b"))), F.col("a") < F.col("b")).select("a", "b")


@query("M5_store_vectors", sql="SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS model, len(embedding) AS dims FROM embeddings")
def m5(spark, sf):
    """Stored vectors after an upsert by id: a stored one gives way to a new one."""
    old = tb.table(spark, sf, "embeddings").select("vec_id", F.lit("old").alias("model"), F.size("embedding").alias("dims"))
    new = old.where("vec_id % 5 = 0").withColumn("model", F.lit("new"))
    return old.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)


@query("M12_embed_modes", ATOMS, sql="""SELECT mode, type, count(*) FILTER (mode = 'on' OR (mode = 'auto' AND v.vec_id IS NOT NULL)) AS embeds, count(*) AS atoms
  FROM atoms LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON vec_id = n CROSS JOIN (VALUES ('auto'), ('on'), ('off')) m(mode) GROUP BY ALL""")
def m12(spark, sf):
    """For which atoms each mode of a fixture searches by vector: always, never, or where a vector is."""
    has = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.lit(True).alias("has")).distinct()
    rows = tb.atoms(spark, sf).select("n", "type").join(has, "n", "left").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("auto", "on", "off")])))
    embeds = (F.col("mode") == "on") | ((F.col("mode") == "auto") & F.col("has").isNotNull())
    return rows.groupBy("mode", "type").agg(F.count_if(embeds).alias("embeds"), F.count(F.lit(1)).alias("atoms"))


LIFE = """requests AS (SELECT ref AS n, arg_max(action, event_id) AS action, max(ts) AS seen, arg_max(value, event_id) AS value FROM log WHERE action <> 'session_started' GROUP BY ref)"""


@query("L11_write_path", ATOMS, LOG, LIFE, sql="""SELECT n, CASE WHEN action = 'conflict_detected' AND type = 'conflict' THEN 'resolved' WHEN action = 'conflict_detected' THEN 'archived' ELSE status END AS status,
  CASE WHEN action = 'atom_updated' THEN round(least(greatest(value / 100, 0), 1), 4) ELSE confidence END AS confidence, CASE WHEN action IN ('atom_updated', 'conflict_detected') THEN strftime(seen, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') END AS updated
  FROM atoms LEFT JOIN requests USING (n) UNION ALL
  SELECT n, CASE WHEN n % 9 = 3 THEN 'draft' ELSE 'active' END, CASE WHEN n % 9 = 3 THEN 0.5 ELSE 0.8 END, strftime(seen, '%Y-%m-%dT%H:%M:%SZ') FROM requests WHERE n NOT IN (SELECT n FROM atoms)""")
def l11(spark, sf):
    """The last request for each atom applied: update, archive, resolve a conflict; requests for unknown atoms create them.

    New beliefs are drafts at 0.5, all else is active at 0.8.
    """
    log = tb.log(spark, sf).where("action <> 'session_started'")
    last = log.groupBy(F.col("ref").alias("n")).agg(F.max_by("action", "event_id").alias("action"), F.max("ts").alias("at"), F.max_by("value", "event_id").alias("value"))
    a = tb.atoms(spark, sf).select("n", "type", "status", "confidence", "updated_at").join(last, "n", "left")
    gone, stamp = F.col("action") == "conflict_detected", lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    changed = F.coalesce(F.col("action").isin("atom_updated", "conflict_detected"), F.lit(False))
    kept = a.select(
        "n", F.when(gone & (F.col("type") == "conflict"), "resolved").when(gone, "archived").otherwise(F.col("status")).alias("status"),
        F.when(F.col("action") == "atom_updated", F.round(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)), 4)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(changed, stamp("at")).otherwise(stamp("updated_at")).alias("updated"),
    )
    belief = F.col("n") % 9 == 3
    new = last.where("n is not null").join(tb.atoms(spark, sf).select("n"), "n", "left_anti")
    return kept.unionByName(new.select("n", F.when(belief, "draft").otherwise("active").alias("status"), F.when(belief, 0.5).otherwise(0.8).alias("confidence"), stamp("at").alias("updated")))


@query("L12_executions", ATOMS, LOG, sql="SELECT n, strftime(coalesce(executed_at, t), '%Y-%m-%dT%H:%M:%SZ') AS executed FROM atoms LEFT JOIN (SELECT ref, min(ts) AS t FROM log WHERE action = 'atom_updated' GROUP BY ref) ON n = ref WHERE type = 'procedure' AND coalesce(executed_at, t) IS NOT NULL")
def l12(spark, sf):
    """Procedures stamped when they first ran; a stamp stays."""
    first = tb.log(spark, sf).where("action = 'atom_updated'").groupBy(F.col("ref").alias("n")).agg(F.min("ts").alias("t"))
    a = tb.atoms(spark, sf).where("type = 'procedure'").select("n", "executed_at").join(first, "n", "left").withColumn("at", F.coalesce("executed_at", "t"))
    return a.where("at is not null").select("n", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("executed"))


_SECTIONS = {"constraint": "Constraints", "decision": "Decisions", "procedure": "Procedures", "fact": "Facts", "open_question": "Open questions"}
_FIRST = "left(trim(string_split(body, chr(10))[1]), 80)"


@query("L26_context_lines", ATOMS, VIS, CAND, sql="SELECT section, place, line FROM (SELECT CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTIONS.items()) + f" END AS section, row_number() OVER (PARTITION BY type ORDER BY updated_at DESC, n) AS place, '- ' || {_FIRST} || ' (' || atom_id || ')' AS line, sum(ceil((length({_FIRST}) + length(atom_id) + 5) / 4)) OVER (PARTITION BY type ORDER BY updated_at DESC, n) AS used FROM cand WHERE status = 'active') WHERE section IS NOT NULL AND used <= 800")
def l26(spark, sf):
    """A context document as line rows: for each section its newest active atoms, up to the section's tokens."""
    a = fl.candidates(tb.atoms(spark, sf), types=tuple(_SECTIONS), statuses=("active",))
    section = F.element_at(F.create_map(*[F.lit(x) for kv in _SECTIONS.items() for x in kv]), F.col("type"))
    first = F.substring(F.trim(F.split("body", "\n")[0]), 1, 80)
    w = Window.partitionBy("section").orderBy(F.desc("updated_at"), "n")
    # a line takes two tokens or more, so 400 of a section are all that can count
    rows = a.select("n", "updated_at", section.alias("section"), F.concat(F.lit("- "), first, F.lit(" ("), "atom_id", F.lit(")")).alias("line"))
    rows = rows.withColumn("place", F.row_number().over(w)).where("place <= 400")
    used = F.sum(F.ceil(F.length("line") / 4)).over(Window.partitionBy("section").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where("used <= 800").select("section", "place", "line")
