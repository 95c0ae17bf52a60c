"""Candidate filters: predicates as columns, so that they compose and push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import HIDDEN_CLASSES, HIDDEN_STATUSES, STATUSES


def visible() -> Column:
    """Not secret or personal; an unclassified row is visible."""
    return F.col("classification").isNull() | ~F.col("classification").isin(*HIDDEN_CLASSES)


def current() -> Column:
    return ~F.col("status").isin(*HIDDEN_STATUSES)


def unvetted() -> Column:
    """A draft that a model wrote and nobody has looked at."""
    return (F.col("status") == "draft") & F.array_contains("tags", "auto-extracted")


def _path(x: Column) -> Column:
    return F.regexp_replace(x, "/$", "")


def overlap(p: Column, q: Column) -> Column:
    """One path is the other or lies below it."""
    p, q = _path(p), _path(q)
    return (p == q) | p.startswith(F.concat(q, F.lit("/"))) | q.startswith(F.concat(p, F.lit("/")))


def in_scope(paths: list[str]) -> Column:
    """Any path overlaps; unscoped rows match everything."""
    if not paths:
        return F.lit(True)
    hit = lambda p: F.exists(F.array(*[F.lit(x) for x in paths]), lambda q: overlap(p, q))
    return (F.size("paths") == 0) | F.exists("paths", hit)


def candidates(atoms: DataFrame, *, types=(), statuses=(), tags=(), paths=(), min_confidence=None, include_drafts=False) -> DataFrame:
    """Rows a query may return. Empty lists filter nothing; hidden statuses go unless statuses are named."""
    out = atoms.where(visible())
    out = out.where(F.col("status").isin(*statuses)) if statuses else out.where(current())
    if not include_drafts:
        out = out.where(~unvetted())
    if types:
        out = out.where(F.col("type").isin(*types))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    return out.where(in_scope(list(paths))) if paths else out


#: Order of statuses in results.
PRIORITY = ("active", "draft", "accepted", "resolved", "rejected", "superseded", "archived", "expired")


def priority() -> Column:
    assert set(PRIORITY) == set(STATUSES)
    return F.array_position(F.array(*[F.lit(s) for s in PRIORITY]), F.col("status"))
