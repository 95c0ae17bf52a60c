"""The data model: enumerations, default tables, and the schemas of a store's files."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations.
TYPES = ("decision", "constraint", "open_question", "belief", "fact", "procedure", "entity_summary", "preference", "conflict")
STATUSES = ("draft", "active", "accepted", "rejected", "superseded", "resolved", "archived", "expired")
CLASSES = ("PUBLIC", "TEAM", "PERSONAL", "SECRET")
RELATIONS = ("extends", "contradicts", "supports", "caused_by", "supersedes", "applied_to", "related")

# Multipliers, half-lives in days, token reservations and relation weights.
TYPE_WEIGHTS = {
    "constraint": 1.5, "decision": 1.3, "procedure": 1.2, "fact": 1.1, "preference": 1.1, "conflict": 1.1,
    "open_question": 0.9, "belief": 0.6, "entity_summary": 0.6,
}
HALF_LIVES = {
    "fact": 30, "belief": 180, "preference": 60, "decision": 90, "procedure": 365, "constraint": 180,
    "open_question": 30, "entity_summary": 90, "conflict": 30,
}
RESERVATIONS = {"decision": 800, "constraint": 400, "conflict": 400}
RELATION_WEIGHTS = {"extends": 1.5, "supports": 0.7, "caused_by": 0.8, "contradicts": 0.4, "supersedes": 0.3, "applied_to": 0.6, "related": 0.3}
CONFIDENCE_FLOOR, DECAY_HALF_LIFE, NEIGHBOUR_BOOST, LENGTH_K, COVERAGE_POWER, MMR_LAMBDA = 0.7, 30.0, 0.15, 0.5, 0.5, 0.7

HIDDEN_STATUSES = ("archived", "expired", "superseded")
HIDDEN_CLASSES = ("SECRET", "PERSONAL")

STRINGS = T.ArrayType(T.StringType())

#: One line of an event log.
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("agent_id", T.StringType()),
    T.StructField("session_id", T.StringType()), T.StructField("action", T.StringType()), T.StructField("atom_refs", STRINGS),
    T.StructField("schema_version", T.IntegerType()), T.StructField("atom_snapshot", T.StringType()),
])

#: One line of a triple sidecar.
TRIPLE = T.StructType([
    T.StructField("atom_id", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("predicate", T.StringType()),
    T.StructField("object", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("created_at", T.StringType()),
])
