"""Scalar functions, small joins and reports that the larger queries are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import ranking as rk
from ..operators import topk as tk
from ..operators.orders import numbered
from ..sources import tables as tb
from ..sources.tables import AS_OF, ATOMS, EDGES, EPISODES, LOG, TRIPLES
from .recall_plans import BOOST, CHAIN, FTS, RANKED, SCORES, _recursive, ranked_of, scores_of, signals_of
from .registry import query
from .store_plans import CAND, GRAPH, VIS, age, graph_edges, graph_nodes, title



def count():
    return F.count(F.lit(1))


@query("J1_hits_to_atoms", *CHAIN, sql="SELECT query_id, n, type FROM sig JOIN vis USING (n)")
def j1(spark, sf):
    return signals_of(spark, sf).join(tb.atoms(spark, sf).where(fl.visible()), "n").select("query_id", "n", "type")


@query("J2_vectors_to_atoms", ATOMS, VIS, sql="SELECT n, type, len(embedding) AS dims FROM embeddings JOIN vis ON n = vec_id")
def j2(spark, sf):
    e = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.size("embedding").alias("dims"))
    return tb.atoms(spark, sf).where(fl.visible()).join(e, "n").select("n", "type", "dims")


@query("J3_typed_edges", ATOMS, EDGES, VIS, GRAPH, sql="SELECT src, tgt, a.type AS src_type, b.type AS tgt_type FROM links JOIN nodes a ON a.n = src JOIN nodes b ON b.n = tgt")
def j3(spark, sf):
    ids = graph_nodes(spark, sf).select("n", "type")
    a, b = ids.select(F.col("n").alias("src"), F.col("type").alias("src_type")), ids.select(F.col("n").alias("tgt"), F.col("type").alias("tgt_type"))
    return graph_edges(spark, sf).join(a, "src").join(b, "tgt").select("src", "tgt", "src_type", "tgt_type")


@query("U2_own_and_shared", ATOMS, sql="SELECT n FROM atoms WHERE n % 5 = 0 UNION SELECT n FROM atoms WHERE classification = 'PUBLIC'")
def u2(spark, sf):
    a = tb.atoms(spark, sf)
    own = a.where("n % 5 = 0").select("n")
    return own.unionByName(a.where("classification = 'PUBLIC'").select("n").join(own, "n", "left_anti"))


@query("U3_anchor_set", *CHAIN, sql="SELECT query_id, n FROM sig UNION SELECT 'q1', vec_id FROM embeddings WHERE label = 1")
def u3(spark, sf):
    near = tb.table(spark, sf, "embeddings").where("label = 1").select(F.lit("q1").alias("query_id"), F.col("vec_id").alias("n"))
    return signals_of(spark, sf).select("query_id", "n").union(near).distinct()


@query("U5_known_ids", ATOMS, sql="SELECT DISTINCT atom_id FROM (SELECT atom_id FROM atoms WHERE type <> 'conflict' UNION ALL SELECT atom_id FROM atoms WHERE type = 'conflict' UNION ALL SELECT atom_id FROM atoms WHERE status = 'archived')")
def u5(spark, sf):
    a = tb.atoms(spark, sf).select("atom_id", "type", "status")
    parts = [a.where(c).select("atom_id") for c in ("type <> 'conflict'", "type = 'conflict'", "status = 'archived'")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


_WORDS = "list_filter(regexp_split_to_array(trim(regexp_replace(lower(body), '[^\\p{L}\\p{N}\\s]', '', 'g')), '\\s+'), lambda x: x <> '')"


def _grams(body="body"):
    w = F.filter(F.split(F.regexp_replace(F.lower(body), "[^\\p{L}\\p{N}\\s]", ""), "\\s+"), lambda x: x != "")
    return w


@query("X5_trigrams", ATOMS, f"w AS (SELECT n, {_WORDS} AS w FROM atoms)", sql="SELECT n, len(list_distinct(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3]))) AS trigrams FROM w WHERE len(w) >= 3")
def x5(spark, sf):
    a = tb.atoms(spark, sf).select("n", _grams().alias("w")).where("size(w) >= 3")
    return a.select("n", F.expr("size(array_distinct(transform(sequence(0, size(w) - 3), i -> concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)))))").alias("trigrams"))


@query("X7_tag_jaccard", ATOMS, EDGES, sql="SELECT src, tgt, round(len(list_intersect(a.tags, b.tags)) / len(list_distinct(a.tags || b.tags)), 6) AS jaccard FROM edges JOIN atoms a ON a.n = src JOIN atoms b ON b.n = tgt")
def x7(spark, sf):
    t = tb.atoms(spark, sf)
    a, b = t.select(F.col("n").alias("src"), F.col("tags").alias("a")), t.select(F.col("n").alias("tgt"), F.col("tags").alias("b"))
    j = F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1))
    return tb.edges(spark, sf).join(a, "src").join(b, "tgt").select("src", "tgt", F.round(j, 6).alias("jaccard"))


@query("X9_cosine", sql="SELECT a.vec_id AS v, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x9(spark, sf):
    e = tb.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return e.join(b, "vec_id").select(F.col("vec_id").alias("v"), F.round(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")), 6).alias("cosine"))


@query("X11_first_line", ATOMS, sql="SELECT n, CASE WHEN length(l) > 80 THEN l[1:80] || '...' ELSE l END AS line FROM (SELECT n, replace(replace(string_split(body, chr(10))[1], '[', '\\['), ']', '\\]') AS l FROM atoms)")
def x11(spark, sf):
    a = tb.atoms(spark, sf).select("n", F.replace(F.replace(F.split("body", "\n")[0], F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]")).alias("l"))
    return a.select("n", F.when(F.length("l") > 80, F.concat(F.substring("l", 1, 80), F.lit("..."))).otherwise(F.col("l")).alias("line"))


@query("X12_normalised_tags", ATOMS, sql="SELECT n, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(array_to_string(tags, ' , ') || ', ,zz', ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS tags FROM atoms")
def x12(spark, sf):
    parts = F.transform(F.split(F.concat(F.array_join("tags", " , "), F.lit(", ,zz")), ","), lambda x: F.trim(x))
    return tb.atoms(spark, sf).select("n", F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), "|").alias("tags"))


@query("X13_whole_seconds", sql="SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events")
def x13(spark, sf):
    return tb.table(spark, sf, "events").select("event_id", F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))


@query("X17_sanitised_query", ATOMS, sql="SELECT n, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(body, '[\"''*(){}:^~.,;!?\\[\\]/-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('AND', 'OR', 'NOT', 'NEAR')), ' OR ') AS q FROM atoms")
def x17(spark, sf):
    clean = F.trim(F.regexp_replace(F.regexp_replace("body", "[\"'*(){}:^~.,;!?\\[\\]/-]", " "), "\\s+", " "))
    return tb.atoms(spark, sf).select("n", F.array_join(F.filter(F.split(clean, " "), lambda x: ~x.isin("", "AND", "OR", "NOT", "NEAR")), " OR ").alias("q"))


@query("X27_id_match", ATOMS, sql="SELECT n FROM atoms WHERE atom_id = 'FACT-2024' OR starts_with(atom_id, 'FACT-2024' || '-') OR starts_with('FACT-2024', atom_id || '-')")
def x27(spark, sf):
    e, i = F.lit("FACT-2024"), F.col("atom_id")
    return tb.atoms(spark, sf).where((i == e) | i.startswith(F.concat(e, F.lit("-"))) | e.startswith(F.concat(i, F.lit("-")))).select("n")


@query("X30_canonical_relations", EDGES, sql="SELECT src, CASE rel WHEN 'caused_by' THEN 'extends' WHEN 'applied_to' THEN 'supports' ELSE rel END AS rel FROM edges WHERE tgt % 11 <> 0")
def x30(spark, sf):
    rel = F.when(F.col("rel") == "caused_by", "extends").when(F.col("rel") == "applied_to", "supports").otherwise(F.col("rel"))
    return tb.edges(spark, sf).where("tgt % 11 <> 0").select("src", rel.alias("rel"))


@query("X32_embedding_text", ATOMS, sql="SELECT n, md5('[' || type || ']' || chr(10) || array_to_string(tags, ', ') || chr(10) || body) AS h FROM atoms")
def x32(spark, sf):
    return tb.atoms(spark, sf).select("n", F.md5(F.concat_ws("\n", F.concat(F.lit("["), "type", F.lit("]")), F.array_join("tags", ", "), "body")).alias("h"))


@query("X33_model_output", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS k FROM events")
def x33(spark, sf):
    raw = F.concat(F.lit("```json\n[{\"k\": "), F.get_json_object("props", "$.k"), F.lit("}, {\"k\": "), F.get_json_object("props", "$.k"), F.lit("}]\n```"))
    parsed = F.from_json(F.regexp_extract(raw, "(?s)(\\[.*\\])", 1), "array<struct<k: bigint>>")
    return tb.table(spark, sf, "events").select("event_id", F.aggregate(parsed, F.lit(0).cast("long"), lambda a, x: a + x["k"]).alias("k"))


@query("X34_versions", ATOMS, sql="SELECT n, list_transform(string_split('1.' || n || '.3', '.'), lambda x: x::INT) > [1, 50, 2] AS newer FROM atoms")
def x34(spark, sf):
    v = F.split(F.concat(F.lit("1."), F.col("n").cast("string"), F.lit(".3")), "\\.").cast("array<int>")
    return tb.atoms(spark, sf).select("n", (v > F.array(F.lit(1), F.lit(50), F.lit(2))).alias("newer"))


PASS1 = """, quota(type, quota) AS (VALUES ('decision', 600), ('constraint', 300), ('conflict', 300)),
mine AS (SELECT r.*, quota, row_number() OVER (PARTITION BY query_id, r.type ORDER BY rank) AS k FROM ranked r JOIN quota USING (type)),
one(query_id, type, k, n, used, taken) AS (
  SELECT DISTINCT query_id, type, 0::BIGINT, NULL::BIGINT, 0::BIGINT, false FROM mine UNION ALL
  SELECT o.query_id, o.type, m.k, m.n, CASE WHEN o.used + m.tokens <= m.quota THEN o.used + m.tokens ELSE o.used END, o.used + m.tokens <= m.quota
  FROM one o JOIN mine m ON m.query_id = o.query_id AND m.type = o.type AND m.k = o.k + 1),
own AS (SELECT query_id, n FROM one WHERE taken),
gap AS (SELECT q.query_id, 4000 - coalesce(sum(tokens) FILTER (o.n IS NOT NULL), 0)::BIGINT AS gap FROM ranked q LEFT JOIN own o USING (query_id, n) GROUP BY q.query_id),
rest AS (SELECT r.query_id, r.n, r.tokens, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS k FROM ranked r ANTI JOIN own o USING (query_id, n)),
two(query_id, k, n, gap, taken) AS (
  SELECT query_id, 0::BIGINT, NULL::BIGINT, gap, false FROM gap UNION ALL
  SELECT t.query_id, r.k, r.n, CASE WHEN r.tokens <= t.gap THEN t.gap - r.tokens ELSE t.gap END, r.tokens <= t.gap FROM two t JOIN rest r ON r.query_id = t.query_id AND r.k = t.k + 1)
SELECT query_id, n, true AS own FROM own UNION ALL SELECT query_id, n, false FROM two WHERE taken"""


@query("R13_reservations", sql=_recursive((*CHAIN, EDGES, SCORES, BOOST, RANKED), PASS1))
def r13(spark, sf):
    """Each reserved type fills its quota in rank order, then the others what is left; rows too large are skipped."""
    return rk.reserved_fill(ranked_of(spark, sf).select("query_id", "n", "type", "rank", "tokens"), 4000)


@query("R17_episode_scores", EPISODES, sql="SELECT episode, round((len(list_intersect(list_distinct(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+')), ['the', 'thea', 'erin'])) / 3.0) * 0.8 + pow(0.5, greatest(366 - hours / 24.0, 0) / 30) * 0.2, 6) AS score FROM (SELECT * FROM episodes ORDER BY hours DESC, episode LIMIT 20)")
def r17(spark, sf):
    e = tb.episodes(spark, sf).orderBy(F.desc("hours"), "episode").limit(20)
    found = F.size(F.array_intersect(rk.tokens(F.col("summary")), F.array(F.lit("the"), F.lit("thea"), F.lit("erin")))) / 3.0
    return e.select("episode", F.round(found * 0.8 + F.pow(F.lit(0.5), F.greatest(366 - F.col("hours") / 24.0, F.lit(0)) / 30) * 0.2, 6).alias("score"))


@query("R16_recency_recall")
def r16(spark, sf):
    """Recall without a task: by status and creation, then by diversity, then the budget with reservations by last update."""
    a = fl.candidates(tb.atoms(spark, sf))
    ranked = numbered(a.select("n", fl.priority().alias("p"), "created_at"), ["p", F.desc("created_at"), "n"])
    scored = ranked.select(F.lit("all").alias("query_id"), "n", (-F.col("rank")).cast("double").alias("score"))
    rows = scored.join(a.select("n", _grams().alias("words")), "n")
    order = rk.mmr(rows.select("query_id", "n", "score", "words")).join(a.select("n", "type", "updated_at", F.ceil(F.length("body") / 4).alias("tokens")), "n")
    return rk.reserved_fill(numbered(order, [F.desc("updated_at"), "position"]), 4000)


@query("R19_isolated_recall", *CHAIN, SCORES, sql="SELECT query_id, n FROM (SELECT query_id, n, sum(ceil(length(body) / 4)) OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, n) AS used FROM scores WHERE n % 3 = 0 OR n % 2 = 0) WHERE used <= 16000")
def r19(spark, sf):
    s = scores_of(spark, sf)
    own = s.where("n % 3 = 0")
    both = own.unionByName(s.where("n % 2 = 0").join(own.select("query_id", "n"), ["query_id", "n"], "left_anti").select(*own.columns))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "n").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("used", F.sum("tokens").over(w)).where("used <= 16000").select("query_id", "n")


@query("L19_retype", EDGES, sql="SELECT src, tgt, CASE WHEN src % 10 >= 7 THEN 'supports' ELSE rel END AS rel, CASE WHEN src % 10 >= 7 THEN 'accepted' ELSE 'kept' END AS outcome FROM edges WHERE rel = 'related'")
def l19(spark, sf):
    sure = F.col("src") % 10 >= 7  # the verdict's confidence
    return tb.edges(spark, sf).where("rel = 'related'").select("src", "tgt", F.when(sure, "supports").otherwise(F.col("rel")).alias("rel"), F.when(sure, "accepted").otherwise("kept").alias("outcome"))


_LINE = "trim(regexp_replace(coalesce(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '\\S'))[1], ''), '^#+\\s*', ''))"
TITLES = f"""heads AS (SELECT n, tags, {_LINE} AS title FROM atoms WHERE status = 'active'),
asked AS (SELECT q, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(title, '\\b(AND|OR|NOT|NEAR)\\b', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+'))) AS term
  FROM (SELECT title, min(n) AS q FROM heads WHERE length(title) >= 5 GROUP BY title)),
tf0 AS (SELECT n, dl, term, count(*) AS tf FROM (SELECT n, len(words) AS dl, unnest(words) AS term FROM words) GROUP BY ALL), df0 AS (SELECT term, count(*) AS df FROM tf0 GROUP BY term),
top AS (SELECT q, n FROM (SELECT q, n, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM asked JOIN tf0 USING (term) JOIN df0 USING (term) CROSS JOIN size GROUP BY q, n) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, n) <= 5)"""


@query("H4_near_duplicates", ATOMS, VIS, FTS, TITLES, sql="""SELECT DISTINCT least(x.n, y.n) AS a, greatest(x.n, y.n) AS b, round(len(list_intersect(x.tags, y.tags)) / len(list_distinct(x.tags || y.tags)), 6) AS overlap
  FROM heads x JOIN (SELECT title, min(n) AS q FROM heads WHERE length(title) >= 5 GROUP BY title) USING (title) JOIN top ON top.q = x_q.q JOIN heads y ON y.n = top.n AND y.n <> x.n WHERE len(list_intersect(x.tags, y.tags)) / len(list_distinct(x.tags || y.tags)) > 0.5""".replace("GROUP BY title) USING (title)", "GROUP BY title) x_q ON x_q.title = x.title"))
def h4(spark, sf):
    """Titles as search queries, five best each; active pairs whose tags overlap by more than half. Five rows an atom at most."""
    a = tb.atoms(spark, sf)
    return tk.near_duplicates(a, rk.documents_terms(a.where(fl.visible())))


@query("H7_composition", ATOMS, sql="SELECT count(*) >= 20 AND count(*) FILTER (type = 'belief') / count(*) > 0.8 AS skewed, count(DISTINCT type) FILTER (type IN ('decision', 'fact', 'procedure')) AS core_types FROM atoms WHERE status = 'active'")
def h7(spark, sf):
    a = tb.atoms(spark, sf).where("status = 'active'")
    share = F.count_if(F.col("type") == "belief") / count()
    return a.agg(((count() >= 20) & (share > 0.8)).alias("skewed"), F.countDistinct(F.when(F.col("type").isin("decision", "fact", "procedure"), F.col("type"))).alias("core_types"))


@query("H11_stale_sections", EDGES, sql="SELECT src FROM (SELECT src, list(rel) AS rels FROM edges GROUP BY src) WHERE NOT list_has_all(['extends', 'supports', 'related', 'supersedes'], rels)")
def h11(spark, sf):
    e = tb.edges(spark, sf).groupBy("src").agg(F.collect_set("rel").alias("rels"))
    section = F.array(*[F.lit(x) for x in ("extends", "supports", "related", "supersedes")])
    return e.where(F.size(F.array_except("rels", section)) > 0).select("src")


@query("M3_insert_triples", TRIPLES, sql="SELECT atom, 'part:' || subject AS subject, 'supplier:' || object AS object, 1.0 AS confidence FROM triples")
def m3(spark, sf):
    t = tb.triples(spark, sf)
    return t.select("atom", F.concat(F.lit("part:"), "subject").alias("subject"), F.concat(F.lit("supplier:"), "object").alias("object"), F.lit(1.0).alias("confidence"))


@query("M8_render_stats", ATOMS, VIS, CAND, sql="SELECT type AS section, count(*) AS n, count(*) >= 5 AS full FROM cand WHERE status = 'active' GROUP BY type")
def m8(spark, sf):
    """Sections of a rendered document, counted back from its lines: each line's heading is the last one before it."""
    a = fl.candidates(tb.atoms(spark, sf), statuses=("active",))
    lines = a.select("type", F.lit(1).alias("k"), F.concat(F.lit("- "), "atom_id").alias("line")).unionByName(a.select("type", F.lit(0).alias("k"), F.concat(F.lit("## "), "type").alias("line")).distinct())
    w = Window.partitionBy("type").orderBy("k", "line").rowsBetween(Window.unboundedPreceding, 0)
    headed = lines.withColumn("section", F.last(F.when(F.col("line").startswith("## "), F.substring("line", 4, 100)), ignorenulls=True).over(w))
    return headed.where("line like '- %'").groupBy("section").agg(count().alias("n"), (count() >= 5).alias("full"))


@query("M10_agents", LOG, sql="SELECT DISTINCT string_split(session_id, '-')[1] AS agent FROM log")
def m10(spark, sf):
    return tb.log(spark, sf).select(F.split("session_id", "-")[0].alias("agent")).distinct()


@query("T6_top_cited", EDGES, ATOMS, sql="SELECT n, type, c FROM atoms JOIN (SELECT tgt, count(*) AS c FROM edges GROUP BY tgt) ON tgt = n WHERE type IN ('decision', 'open_question') ORDER BY c DESC, n LIMIT 5")
def t6(spark, sf):
    c = tb.edges(spark, sf).groupBy(F.col("tgt").alias("n")).agg(count().alias("c"))
    return tb.atoms(spark, sf).where("type in ('decision', 'open_question')").join(c, "n").orderBy(F.desc("c"), "n").limit(5).select("n", "type", "c")


@query("T7_line_budget", ATOMS, sql="SELECT n, CASE WHEN len(l) > 10 THEN array_to_string(l[1:8], '|') || '|... ' || (len(l) - 8) || ' more lines' ELSE array_to_string(l, '|') END AS view FROM (SELECT n, string_split(body, chr(10)) AS l FROM atoms)")
def t7(spark, sf):
    a = tb.atoms(spark, sf).select("n", F.split("body", "\n").alias("l"))
    cut = F.concat(F.array_join(F.slice("l", 1, 8), "|"), F.lit("|... "), (F.size("l") - 8).cast("string"), F.lit(" more lines"))
    return a.select("n", F.when(F.size("l") > 10, cut).otherwise(F.array_join("l", "|")).alias("view"))
