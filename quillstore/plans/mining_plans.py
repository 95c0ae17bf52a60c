"""References in prose: relinking, citations, orphans, and the checks that compare prose with headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining as mi
from ..sources import tables as tb
from ..sources.tables import ATOMS, DECLARED, EDGES, MINED
from .registry import query

_CASE = "CASE " + " ".join(f"WHEN regexp_matches(near, '{w}') THEN '{t}'" for w, t in mi.CONTEXT_WORDS) + " ELSE 'related' END"
REFS = f"""mentions AS (SELECT DISTINCT n, atom_id, body, unnest(regexp_extract_all(body, '{mi.ATOM_ID}')) AS ref FROM mined),
nears AS (SELECT n, ref, lower(body[greatest(instr(body, ref) - 100, 1):instr(body, ref) + 99]) AS near FROM mentions WHERE ref <> atom_id),
refs AS (SELECT x.n, b.n AS target, {_CASE} AS rel FROM nears x JOIN atoms b ON b.atom_id = x.ref)"""
PROSE = (ATOMS, EDGES, MINED, DECLARED, REFS)
# every name searched in every body by a pattern of its own
CONCEPTS = """names AS (SELECT n AS target, lower(array_to_string(string_split(atom_id, '-')[5:-2], '-')) AS concept FROM atoms),
dictionary AS (SELECT concept, count(*) AS holders FROM names GROUP BY concept),
spotted AS (SELECT n, concept, holders, len(regexp_extract_all(lower(body), '\\b' || replace(concept, '-', '[-_ ]') || '\\b')) AS count FROM mined, dictionary),
spots AS (SELECT s.n, s.concept, count, holders - (t.target IS NOT NULL)::BIGINT AS targets FROM spotted s LEFT JOIN names t ON t.target = s.n AND t.concept = s.concept WHERE count > 0)"""


def references(spark, sf):
    a = tb.mined(spark, sf)
    return mi.id_references(a.select("n", "atom_id", "body"), a.select("n", "atom_id"))


@query("X20_relation_type", *PROSE, sql="SELECT n, target, rel FROM refs")
def x20(spark, sf):
    return references(spark, sf)


@query("J13_concept_references", ATOMS, EDGES, MINED, CONCEPTS, sql="SELECT n, concept, count, targets FROM spots WHERE targets > 0")
def j13(spark, sf):
    return mi.concept_references(tb.mined(spark, sf).select("n", "atom_id", "body"))


@query("L16_relink", *PROSE, sql="SELECT n, target, rel FROM refs r WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.src = r.n AND d.tgt = r.target)")
def l16(spark, sf):
    """Relations that prose tells and headers lack."""
    known = tb.declared(spark, sf).select(F.col("src").alias("n"), F.col("tgt").alias("target"))
    return references(spark, sf).dropDuplicates(["n", "target", "rel"]).join(known, ["n", "target"], "left_anti").select("n", "target", "rel")


@query("H12_prose_references", *PROSE, sql="SELECT n, count(*) AS missing FROM refs r WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.src = r.n AND d.tgt = r.target) GROUP BY n")
def h12(spark, sf):
    return l16(spark, sf).groupBy("n").agg(F.count(F.lit(1)).alias("missing"))


@query("L17_relation_backfill", *PROSE, sql="SELECT n, target FROM (SELECT src AS n, tgt AS target FROM edges WHERE rel = 'related' UNION SELECT n, target FROM refs) EXCEPT SELECT src, tgt FROM declared")
def l17(spark, sf):
    links = tb.edges(spark, sf).where("rel = 'related'").select(F.col("src").alias("n"), F.col("tgt").alias("target"))
    found = links.unionByName(references(spark, sf).select("n", "target")).distinct()
    return found.join(tb.declared(spark, sf).select(F.col("src").alias("n"), F.col("tgt").alias("target")), ["n", "target"], "left_anti")


@query("L18_citation_index", *PROSE, CONCEPTS, sql="""SELECT 'atom_id' AS kind, b.atom_id AS cited, count(*) AS citations, count(DISTINCT r.n) AS sources FROM refs r JOIN atoms b ON b.n = r.target GROUP BY 2 UNION ALL
  SELECT 'concept_name', a.atom_id, sum(count)::BIGINT, count(DISTINCT s.n) FROM spots s JOIN names t ON t.concept = s.concept AND t.target <> s.n JOIN atoms a ON a.n = t.target GROUP BY 2""")
def l18(spark, sf):
    """How often, and by how many, each atom is cited: by its id, and by its concept's name."""
    a = tb.mined(spark, sf).select("n", "atom_id", "body")
    ids = a.select(F.col("n").alias("target"), F.col("atom_id").alias("cited"))
    by_id = references(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("n").alias("sources"))
    both = by_id.select(F.lit("atom_id").alias("kind"), "*").unionByName(mi.concept_citations(a).select(F.lit("concept_name").alias("kind"), "*"))
    return both.join(ids, "target").select("kind", "cited", "citations", "sources")


@query("H3_orphans", *PROSE, sql="SELECT n FROM atoms WHERE type NOT IN ('preference', 'entity_summary') AND n NOT IN (SELECT src FROM declared UNION ALL SELECT tgt FROM declared UNION ALL SELECT target FROM refs)")
def h3(spark, sf):
    d = tb.declared(spark, sf)
    linked = d.select(F.col("src").alias("n")).union(d.select("tgt")).union(references(spark, sf).select("target"))
    return tb.atoms(spark, sf).where("type not in ('preference', 'entity_summary')").select("n").join(linked, "n", "left_anti")


@query("S20_export_vault", *PROSE, sql=f"SELECT n, regexp_replace(body, '({mi.ATOM_ID})', '[[\\1]]', 'g') AS body, len(regexp_extract_all(body, '{mi.ATOM_ID}')) AS links FROM mined WHERE classification IS NULL OR classification NOT IN ('SECRET', 'PERSONAL')")
def s20(spark, sf):
    """Bodies of visible atoms with ids as links."""
    from ..operators import filters as fl

    found = F.regexp_extract_all("body", F.lit(mi.ATOM_ID), F.lit(0))
    return tb.mined(spark, sf).where(fl.visible()).select("n", F.regexp_replace("body", f"({mi.ATOM_ID})", "[[$1]]").alias("body"), F.size(found).cast("long").alias("links"))


@query("M11_partial_ids", ATOMS, sql="SELECT partial, min(n) AS n, count(*) AS matches FROM (SELECT DISTINCT array_to_string(string_split(atom_id, '-')[1:6], '-') AS partial FROM atoms) JOIN atoms ON atom_id = partial OR starts_with(atom_id, partial || '-') GROUP BY partial")
def m11(spark, sf):
    """Partial ids and the atoms they may mean: an equality with the prefixes of ids at dashes."""
    a = tb.atoms(spark, sf).select("n", "atom_id")
    partial = a.select(F.array_join(F.slice(F.split("atom_id", "-"), 1, 6), "-").alias("partial")).distinct()
    parts = F.split("atom_id", "-")
    prefixes = a.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))).alias("partial"))
    return prefixes.join(partial, "partial").groupBy("partial").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("matches"))


SENTINEL = "<!-- mk:relations -->"  # fixed value: begins the section of relations in a body


@query("X29_relation_sections", ATOMS, EDGES, sql="SELECT e.src, replace(e.rel, '_', '-') AS display, t.atom_id AS target, len(string_split(s.body, ' '))::BIGINT AS words FROM edges e JOIN atoms t ON t.n = e.tgt JOIN atoms s ON s.n = e.src")
def x29(spark, sf):
    """A section is rendered after the body, read back from its last sentinel, and stripped again."""
    a = tb.atoms(spark, sf)
    ids = a.select(F.col("n").alias("tgt"), F.col("atom_id").alias("target"))
    links = tb.edges(spark, sf).join(ids, "tgt").groupBy("src", "rel").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    lines = F.transform("targets", lambda x: F.concat(F.lit("- "), F.replace("rel", F.lit("_"), F.lit("-")), F.lit(" [["), x, F.lit("]]")))
    sections = links.groupBy("src").agg(F.array_join(F.flatten(F.collect_list(lines)), "\n").alias("lines"))  # an atom's own relations
    text = a.join(sections, a["n"] == sections["src"]).select("src", F.concat("body", F.lit(f"\n{SENTINEL}\n## Relations\n\n"), "lines", F.lit("\n")).alias("text"))
    tail, body = F.substring_index("text", SENTINEL, -1), F.substring_index("text", f"\n{SENTINEL}", 1)
    read = text.select("src", F.size(F.split(body, " ")).cast("long").alias("words"), F.explode(F.filter(F.split(tail, "\n"), lambda x: x.rlike(r"^-\s+\S+\s+\[\["))).alias("line"))
    return read.select("src", F.regexp_extract("line", r"^-\s+(\S+)", 1).alias("display"), F.regexp_extract("line", r"\[\[([^\]|]+)", 1).alias("target"), "words")
