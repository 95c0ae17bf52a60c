"""Grounding, activation, distances and arcs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance as ds
from ..operators import forest as fo
from ..operators import graph as gr
from ..sources import schema as sc
from ..sources import tables as tb
from ..sources.tables import AS_OF, ATOMS, EDGES, EVENTS_AS_OF, EXTENSIONS, LOG
from .recall_plans import weight_sql
from .registry import query
from .store_plans import GRAPH, USE, VIS, age, graph_edges, graph_nodes, usage

_HALF = weight_sql(sc.HALF_LIVES, "type", 90)
GROUND = f"""ground AS (SELECT n, type, confidence, coalesce(n_access, 0) AS n_access, coalesce(sessions, 0) AS sessions,
  least(1.0, greatest(0.01, (0.5 * CASE WHEN last_read IS NULL THEN 0 ELSE pow(2.0, -greatest(0, (epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(last_read)) / 86400.0) / ({_HALF})) END
    + 0.5 * (1 - pow(2.0, -coalesce(n_access, 0) / 5.0))) * pow(0.6, coalesce(n_conflict, 0)))) AS g
  FROM atoms LEFT JOIN use ON n = ref WHERE status = 'active' AND type <> 'conflict'),
quad AS (SELECT *, CASE WHEN confidence >= 0.6 AND round(g, 9) >= 0.5 THEN 'well-grounded' WHEN confidence >= 0.6 THEN 'review' WHEN round(g, 9) >= 0.5 THEN 'promote' ELSE 'noise' END AS quadrant FROM ground)"""


def grounding(spark, sf):
    """Each active atom's support by use: recency, frequency, conflicts, and its quadrant against confidence."""
    a = tb.atoms(spark, sf).where("status = 'active' and type <> 'conflict'").select("n", "type", "confidence")
    rows = a.join(usage(spark, sf).withColumnRenamed("ref", "n"), "n", "left")
    half = F.lit(90.0)
    for k, v in sc.HALF_LIVES.items():
        half = F.when(F.col("type") == k, float(v)).otherwise(half)
    days = F.greatest(F.lit(0), (F.unix_timestamp(tb.clock(EVENTS_AS_OF).cast("timestamp")) - F.unix_timestamp(F.col("last_read").cast("timestamp"))) / 86400.0)
    recency = F.when(F.col("last_read").isNull(), 0.0).otherwise(F.pow(F.lit(2.0), -days / half))
    n = F.coalesce("n_access", F.lit(0))
    raw = (0.5 * recency + 0.5 * (1 - F.pow(F.lit(2.0), -n / 5.0))) * F.pow(F.lit(0.6), F.coalesce("n_conflict", F.lit(0)))
    g = F.least(F.lit(1.0), F.greatest(F.lit(0.01), raw))
    high, used = F.col("confidence") >= 0.6, F.round("g", 9) >= 0.5
    quadrant = F.when(high & used, "well-grounded").when(high, "review").when(used, "promote").otherwise("noise")
    return rows.withColumn("g", g).select("n", "type", "confidence", n.alias("n_access"), F.coalesce("sessions", F.lit(0)).alias("sessions"), "g").withColumn("quadrant", quadrant)


@query("G1_grounding", ATOMS, LOG, USE, GROUND, sql="SELECT n, n_access, sessions, round(g, 4) AS grounding, quadrant FROM quad")
def g1(spark, sf):
    return grounding(spark, sf).select("n", "n_access", "sessions", F.round("g", 4).alias("grounding"), "quadrant")


@query("A7_quadrants", ATOMS, LOG, USE, GROUND, sql="SELECT quadrant, count(*) AS n FROM quad GROUP BY quadrant")
def a7(spark, sf):
    return grounding(spark, sf).groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))


@query("G2_reconcile", ATOMS, LOG, USE, GROUND, sql="""SELECT n, round(least(greatest(confidence + CASE WHEN g < confidence THEN 0.08 ELSE 0.03 END * (g - confidence), 0), 1), 4) AS new_confidence FROM quad
  WHERE quadrant IN ('review', 'promote') AND (quadrant = 'review' OR sessions >= 2) AND n % 7 <> 0 AND abs(CASE WHEN g < confidence THEN 0.08 ELSE 0.03 END * (g - confidence)) >= 0.005""")
def g2(spark, sf):
    d = F.when(F.col("g") < F.col("confidence"), 0.08).otherwise(0.03) * (F.col("g") - F.col("confidence"))
    edited = tb.atoms(spark, sf).where("n % 7 = 0").select("n")
    rows = grounding(spark, sf).where("quadrant in ('review', 'promote') and (quadrant = 'review' or sessions >= 2)").join(edited, "n", "left_anti")
    return rows.where(F.abs(d) >= 0.005).select("n", F.round(F.least(F.greatest(F.col("confidence") + d, F.lit(0)), F.lit(1)), 4).alias("new_confidence"))


_W = weight_sql(sc.RELATION_WEIGHTS, "rel", 0.3)
NEAR = f"near AS (SELECT n, m, max(w) AS w, arg_max(rel, (w, rel)) AS rel FROM (SELECT *, {_W} AS w FROM (SELECT src AS n, tgt AS m, rel FROM links UNION ALL SELECT tgt, src, rel FROM links)) GROUP BY n, m)"


@query("G4_neighbour_types", ATOMS, EDGES, VIS, GRAPH, NEAR, sql="SELECT n, m, rel, w FROM near")
def g4(spark, sf):
    return gr.neighbours(graph_edges(spark, sf))


BASE = f"""base AS (SELECT n, tags, ln(coalesce(c, 0) + 1) - 0.5 * ln(greatest((epoch(TIMESTAMP '{AS_OF}') - epoch(updated_at)) / 86400.0, 0.01)) AS base
  FROM nodes LEFT JOIN (SELECT tgt, count(*) AS c FROM links GROUP BY tgt) ON n = tgt),
seeds AS (SELECT n FROM base ORDER BY round(base, 9) DESC, n LIMIT 3)"""


def nodes_of(spark, sf):
    cited = graph_edges(spark, sf).groupBy(F.col("tgt").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    rows = graph_nodes(spark, sf).select("n", "tags", "updated_at").join(cited, "n", "left")
    return rows.select("n", "tags", gr.base_activation(age("updated_at"), F.coalesce("c", F.lit(0))).alias("base"))


def seeds_of(spark, sf):
    return nodes_of(spark, sf).orderBy(F.round("base", 9).desc(), "n").limit(3).select("n")


@query("X24_base_activation", ATOMS, EDGES, VIS, GRAPH, BASE, sql="SELECT n, round(base, 6) AS base, round(1 / sqrt(1 + exp(-base)), 6) AS boost FROM base")
def x24(spark, sf):
    return nodes_of(spark, sf).select("n", F.round("base", 6).alias("base"), F.round(1 / F.sqrt(1 + F.exp(-F.col("base"))), 6).alias("boost"))


@query("G5_seeds", ATOMS, EDGES, VIS, GRAPH, BASE, sql="SELECT n FROM seeds")
def g5(spark, sf):
    return seeds_of(spark, sf)


def _step(i: int) -> str:
    return f"""act{i} AS (SELECT * FROM (SELECT n, act FROM (SELECT b.n, round(coalesce(a.act * 0.75, 0.0) + coalesce(g.got / sqrt(1 + exp(-b.base)), 0.0), 9) AS act FROM base b
  LEFT JOIN act{i - 1} a ON a.n = b.n LEFT JOIN (SELECT n, sum(got) AS got FROM (
    SELECT t2.n, s.act * 0.5 / s.k / h.holders AS got FROM (SELECT act.n, act.act, t.tag, t.k FROM act{i - 1} act JOIN tagged t ON t.n = act.n) s JOIN holders h ON h.tag = s.tag JOIN tagged t2 ON t2.tag = s.tag AND t2.n <> s.n
    UNION ALL SELECT m, act.act * 0.5 * 2.0 * near.w / d.degree FROM act{i - 1} act JOIN near ON near.n = act.n AND near.m <> near.n JOIN degree d ON d.n = act.n) GROUP BY n) g ON g.n = b.n)
  WHERE act > 0 ORDER BY act DESC, n LIMIT 20) WHERE act >= 0.05)"""


WALK = (
    "tagged AS (SELECT n, unnest(tags) AS tag, len(tags) AS k FROM nodes), holders AS (SELECT tag, count(*) AS holders FROM tagged GROUP BY tag)",
    "degree AS (SELECT n, count(*) AS degree FROM near WHERE n <> m GROUP BY n), act0 AS (SELECT n, 1.0::DOUBLE AS act FROM seeds)",
    _step(1), _step(2), _step(3),
)


def walk(spark, sf):
    return gr.spread(nodes_of(spark, sf), graph_edges(spark, sf), seeds_of(spark, sf))


@query("G3_wander", ATOMS, EDGES, VIS, GRAPH, NEAR, BASE, *WALK, sql="SELECT n, round(act, 6) AS act FROM act3")
def g3(spark, sf):
    return walk(spark, sf).select("n", F.round("act", 6).alias("act"))


def _walk_step(i: int) -> str:
    return f"""wact{i} AS MATERIALIZED (SELECT walk, n, act FROM (SELECT walk, n, act, row_number() OVER (PARTITION BY walk ORDER BY act DESC, n) AS r FROM (
  SELECT walk, n, round(sum(act) FILTER (kind = 0) * 0.75, 9) AS kept, round(coalesce(sum(act) FILTER (kind = 0), 0) * 0.75 + coalesce(sum(act) FILTER (kind = 1), 0) / sqrt(1 + exp(-any_value(base))), 9) AS act FROM (
    SELECT walk, n, act, 0 AS kind FROM wact{i - 1} UNION ALL
    SELECT s.walk, t2.n, s.act * 0.5 / s.k / h.holders, 1 FROM (SELECT a.walk, a.n, a.act, t.tag, t.k FROM wact{i - 1} a JOIN tagged t ON t.n = a.n) s JOIN holders h ON h.tag = s.tag JOIN tagged t2 ON t2.tag = s.tag AND t2.n <> s.n UNION ALL
    SELECT a.walk, m, a.act * 0.5 * 2.0 * near.w / d.degree, 1 FROM wact{i - 1} a JOIN near ON near.n = a.n AND near.m <> near.n JOIN degree d ON d.n = a.n) JOIN base USING (n) GROUP BY walk, n)
  WHERE act > 0) WHERE r <= 20 AND act >= 0.05)"""


WALKS = ("wact0 AS (SELECT n AS walk, n, 1.0::DOUBLE AS act FROM nodes WHERE n % 100 = 0)", _walk_step(1), _walk_step(2), _walk_step(3))


@query("G3_walks", ATOMS, EDGES, VIS, GRAPH, NEAR, BASE, *WALK[:2], *WALKS, sql="SELECT walk, n, round(act, 6) AS act FROM wact3")
def g3_walks(spark, sf):
    """A walk from each hundredth atom, all at once."""
    nodes = nodes_of(spark, sf)
    return gr.walks(nodes, graph_edges(spark, sf), nodes.where("n % 100 = 0").select(F.col("n").alias("walk"), "n")).select("walk", "n", F.round("act", 6).alias("act"))


@query("G6_collisions", ATOMS, EDGES, VIS, GRAPH, NEAR, BASE, *WALK, sql="""SELECT a, b, score FROM (SELECT x.n AS a, y.n AS b, round(x.act * y.act * (1 - len(list_intersect(p.tags, q.tags)) / len(list_distinct(p.tags || q.tags))), 3) AS score,
  1 - len(list_intersect(p.tags, q.tags)) / len(list_distinct(p.tags || q.tags)) AS d FROM act3 x JOIN act3 y ON x.n < y.n JOIN nodes p ON p.n = x.n JOIN nodes q ON q.n = y.n) WHERE d > 0.7 ORDER BY score DESC, a, b LIMIT 5""")
def g6(spark, sf):
    active = walk(spark, sf).join(graph_nodes(spark, sf).select("n", "tags"), "n")  # 20 rows at most
    a, b = [active.select(F.col("n").alias(k), F.col("act").alias(f"{k}_act"), F.col("tags").alias(f"{k}_tags")) for k in "ab"]
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    d = 1 - F.size(F.array_intersect("a_tags", "b_tags")) / F.size(F.array_union("a_tags", "b_tags"))
    return pairs.where(d > 0.7).select("a", "b", F.round(F.col("a_act") * F.col("b_act") * d, 3).alias("score")).orderBy(F.desc("score"), "a", "b").limit(5)


def _hops() -> str:
    out = ["u AS (SELECT DISTINCT n, m FROM (SELECT src AS n, tgt AS m FROM edges UNION ALL SELECT tgt, src FROM edges)), h0 AS (SELECT n AS source, n, 0 AS hops FROM atoms WHERE n % 100 = 0)"]
    for i in range(1, 5):
        out.append(f"h{i} AS (SELECT * FROM h{i - 1} UNION ALL SELECT DISTINCT h.source, u.m, {i} FROM h{i - 1} h JOIN u ON u.n = h.n WHERE h.hops = {i - 1} AND NOT EXISTS (SELECT 1 FROM h{i - 1} s WHERE s.source = h.source AND s.n = u.m))")
    return ",\n".join(out)


@query("G7_hops", ATOMS, EDGES, _hops(), sql="SELECT source, n, hops FROM h4")
def g7(spark, sf):
    return gr.hops(tb.edges(spark, sf), tb.atoms(spark, sf).where("n % 100 = 0").select("n"))


_NEAREST = """nearest AS (SELECT source, n, min(hops) AS hops FROM t4 GROUP BY source, n)"""


def _tag_hops(start: str) -> str:
    """Breadth-first search from atom to tag to atom, four hops, from the atoms that `start` selects."""
    out = [f"bag AS (SELECT n, unnest(tags) AS tag FROM nodes), t0 AS (SELECT n AS source, n, 0 AS hops FROM ({start}))"]
    for i in range(1, 5):
        out.append(f"""g{i} AS (SELECT DISTINCT source, tag FROM t{i - 1} JOIN bag USING (n) WHERE hops = {i - 1}),
t{i} AS MATERIALIZED (SELECT * FROM t{i - 1} UNION ALL SELECT source, n, {i} FROM (SELECT DISTINCT g.source, b.n FROM g{i} g JOIN bag b USING (tag) WHERE (g.source, b.n) NOT IN (SELECT (source, n) FROM t{i - 1})))""")
    return ",\n".join([*out, _NEAREST])


@query("G7_tag_distance", ATOMS, EDGES, VIS, GRAPH, _tag_hops("SELECT n FROM nodes WHERE n % 100 = 0"), sql="""SELECT s.n AS source, coalesce(hops, 5) AS distance, count(*) AS atoms
  FROM (SELECT n FROM nodes WHERE n % 100 = 0) s CROSS JOIN nodes x LEFT JOIN nearest t ON t.source = s.n AND t.n = x.n GROUP BY ALL""")
def g7_tags(spark, sf):
    """How many atoms each hundredth atom has at each distance by shared tags; 5: out of reach."""
    nodes = graph_nodes(spark, sf).select("n", "tags")
    return ds.distance_counts(nodes, nodes.where("n % 100 = 0"))


@query("G7_edge_distance", ATOMS, EDGES, VIS, GRAPH, _tag_hops("SELECT DISTINCT src AS n FROM links"), sql="""SELECT src AS a, tgt AS b, coalesce(hops, 5) AS distance
  FROM links LEFT JOIN nearest t ON t.source = src AND t.n = tgt""")
def g7_edges(spark, sf):
    """How far apart by tags the ends of relations lie."""
    pairs = graph_edges(spark, sf).select(F.col("src").alias("a"), F.col("tgt").alias("b"))
    return ds.pair_distances(graph_nodes(spark, sf).select("n", "tags"), pairs)


ARC = """beliefs AS (SELECT n, created_at FROM atoms WHERE type = 'belief'),
up AS (SELECT b.n, b.created_at, p.n AS parent FROM beliefs b LEFT JOIN extensions x ON x.child = b.n LEFT JOIN beliefs p ON p.n = x.parent),
arc AS (SELECT n, n AS root, 0::BIGINT AS depth, [(created_at, n)] AS path FROM up WHERE parent IS NULL
  UNION ALL SELECT u.n, a.root, a.depth + 1, list_append(a.path, (u.created_at, u.n)) FROM up u JOIN arc a ON u.parent = a.n)"""


@query("G8_belief_arcs", sql=f"""WITH RECURSIVE {ATOMS},
{EDGES},
{EXTENSIONS},
{ARC},
walked AS (SELECT n, root, depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS position, count(*) OVER (PARTITION BY root) AS size FROM arc)
SELECT b.n, root, depth, position FROM beliefs b LEFT JOIN (SELECT * FROM walked WHERE size > 1) w ON w.n = b.n""")
def g8(spark, sf):
    """Beliefs in trees of what they extend, of any depth, in depth-first order by creation; those alone or on cycles have nulls."""
    beliefs = tb.atoms(spark, sf).where("type = 'belief'").select("n", "created_at")
    return fo.arcs(beliefs, tb.extensions(spark, sf), ["created_at", "n"])


@query("G9_edges_of_an_atom", EDGES, sql="SELECT src AS n, tgt AS other, rel, 'out' AS direction FROM edges WHERE src % 100 = 0 UNION ALL SELECT tgt, src, rel, 'in' FROM edges WHERE tgt % 100 = 0")
def g9(spark, sf):
    """The relations from and to each hundredth atom."""
    e = tb.edges(spark, sf)
    out = e.where("src % 100 = 0").select(F.col("src").alias("n"), F.col("tgt").alias("other"), "rel", F.lit("out").alias("direction"))
    return out.union(e.where("tgt % 100 = 0").select("tgt", "src", "rel", F.lit("in")))
