"""References mined from bodies: atom ids, concept names, the kind of relation that their context tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import held, small

# The form of an atom's id, the context of a mention and the words that tell a relation, in order.
ATOM_ID = r"[A-Z]{2,8}-\d{4}-\d{2}-\d{2}-[A-Za-z0-9][A-Za-z0-9-]*"
CONTEXT = 100
CONTEXT_WORDS = (
    ("extends|builds on|elaborates|generalizes", "extends"),
    ("contradicts|conflicts with|disagrees|opposes", "contradicts"),
    ("supports|confirms|agrees with|evidence for", "supports"),
    ("caused by|because of|due to|triggered by", "caused_by"),
    ("supersedes|replaces|obsoletes", "supersedes"),
)


def id_references(atoms: DataFrame, known: DataFrame) -> DataFrame:
    """(n, target, rel): known atoms (n, atom_id) that bodies of atoms (n, atom_id, body) name, with the relation their first mention tells."""
    refs = atoms.select("n", "atom_id", "body", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(ATOM_ID), F.lit(0)))).alias("ref")).where("ref <> atom_id")
    at = F.instr("body", F.col("ref"))
    start = F.greatest(at - CONTEXT, F.lit(1))
    near = refs.select("n", "ref", F.lower(F.substr("body", start, at + CONTEXT - start)).alias("near"))
    return near.join(known.select(F.col("n").alias("target"), F.col("atom_id").alias("ref")), "ref").select("n", "target", relation("near").alias("rel"))


def relation(near: str) -> Column:
    out = F.lit("related")
    for words, name in reversed(CONTEXT_WORDS):
        out = F.when(F.col(near).rlike(words), name).otherwise(out)
    return out


def concept_names(atom_id: str = "atom_id") -> Column:
    """Names of an id's concept: its slug of two words or more and eight characters or more, and the first five words of a longer one."""
    parts = F.split(atom_id, "-")
    slug = F.slice(parts, 5, F.greatest(F.size(parts) - 5, F.lit(0)))
    full, short = F.lower(F.array_join(slug, "-")), F.lower(F.array_join(F.slice(slug, 1, 5), "-"))
    names = F.array(F.when((F.size(slug) >= 2) & (F.length(full) >= 8), full), F.when((F.size(slug) > 5) & (F.length(short) >= 10), short))
    return F.filter(F.when(F.size(parts) >= 6, names).otherwise(F.array().cast("array<string>")), lambda x: x.isNotNull())


def concept_targets(atoms: DataFrame) -> DataFrame:
    """(target, concept): the concept names of each atom (n, atom_id)."""
    return atoms.select(F.col("n").alias("target"), F.explode(concept_names()).alias("concept"))


def concept_mentions(atoms: DataFrame, names: DataFrame) -> DataFrame:
    """(n, concept, count): names (concept) that bodies of atoms (n, body) mention, in any case, joined by one of `-_ `.

    Word n-grams of a body, of just the lengths that the dictionary has, are looked up in it by equality: no scan of a body
    for each name. A look-ahead finds every n-gram, overlapping ones too, that begins and ends where a word does (`_` is
    part of a word there). Of mentions of one name that overlap, the first counts, which only a name can have that ends as
    it begins; those few are counted again by their own pattern.
    """
    names = names.select("concept").distinct().withColumn("w", F.split("concept", "-"))
    again = F.expr("exists(sequence(1, size(w)), s -> s < size(w) and slice(w, s + 1, size(w)) = slice(w, 1, size(w) - s))")
    names = held(names.select("concept", F.size("w").alias("words"), again.alias("again")), "concepts")
    sizes = sorted(r[0] for r in names.select("words").distinct().collect())  # a few small numbers
    if not sizes:
        return atoms.select("n", F.lit(None).cast("string").alias("concept"), F.lit(None).cast("long").alias("count")).where(F.lit(False))
    word = "[a-z0-9]+"
    grams = F.concat(*[F.regexp_extract_all(F.lower("body"), F.lit(f"(?<![a-z0-9_])(?=({word}(?:[-_ ]{word}){{{k - 1}}})(?![a-z0-9_]))"), F.lit(1)) for k in sizes])
    found = atoms.select("n", F.explode(grams).alias("g")).select("n", F.translate("g", "_ ", "--").alias("concept"))
    found = found.join(small(names), "concept").groupBy("n", "concept", "again").agg(F.count(F.lit(1)).alias("count"))
    if not names.where("again").limit(1).count():
        return found.select("n", "concept", "count")
    own = F.concat(F.lit("(?<![a-z0-9_])"), F.replace("concept", F.lit("-"), F.lit("[-_ ]")), F.lit("(?![a-z0-9_])"))
    found = held(found, "found")
    twice = found.where("again").join(atoms.select("n", "body"), "n").select("n", "concept", F.regexp_count(F.lower("body"), own).cast("long").alias("count"))
    return found.where("not again").select("n", "concept", "count").unionByName(twice)


def concept_references(atoms: DataFrame) -> DataFrame:
    """(n, concept, count, targets): names that a body mentions of `targets` other atoms. A name only of one's own is no reference.

    With concept_targets this is every (source, target, count), without a row for each source and target of a common name.
    """
    targets = concept_targets(atoms)
    each = targets.groupBy("concept").agg(F.count(F.lit(1)).alias("holders"))
    found = concept_mentions(atoms, targets)
    own = targets.select(F.col("target").alias("n"), "concept", F.lit(1).alias("own"))
    rows = found.join(each, "concept").join(own, ["n", "concept"], "left").withColumn("targets", F.col("holders") - F.coalesce("own", F.lit(0)))
    return rows.where("targets > 0").select("n", "concept", "count", "targets")


def concept_citations(atoms: DataFrame) -> DataFrame:
    """(target, citations, sources): how often other atoms' bodies mention an atom's concept, and how many do.

    A source that mentions an atom's full name mentions its short one too, so the shortest name has all sources.
    """
    targets = concept_targets(atoms)
    found = held(concept_mentions(atoms, targets), "mentions")
    all_ = found.groupBy("concept").agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("by"))
    own = found.select(F.col("n").alias("target"), "concept", F.col("count").alias("own"))
    rows = targets.join(all_, "concept").join(own, ["target", "concept"], "left")
    rows = rows.select("target", (F.col("all") - F.coalesce("own", F.lit(0))).alias("c"), (F.col("by") - F.when(F.col("own").isNull(), 0).otherwise(1)).alias("s")).where("s > 0")
    return rows.groupBy("target").agg(F.sum("c").alias("citations"), F.max("s").alias("sources"))
