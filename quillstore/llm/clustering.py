"""Centroid clustering with weighted deduplication: Lloyd's rounds over distinct quantised vectors.

A vector's components become floor(scale * x). Equal vectors are grouped first, so that a vector that a third of all rows
share is one row with a multiplicity. Rounds assign each distinct vector to its nearest centroid (ties: the smaller
number) and add up vectors times multiplicities in integers; a task sends one sum for each centroid and component, so the
driver gets k * dims sums a round, however many vectors there are. Assignments are joined back to vec_ids; vectors with
many rows are looked up by a broadcast of fewer than 1,000 of them.

Vectors that are null, of another length than `dims`, or that hold null or non-finite components are left out. Repeated
rows count each and come back each; a null vec_id is kept, and hashes as `null`. Fewer than k vectors: as many centroids.
Equal first centroids: the smaller number takes all, the other stays. Empty input: no rows. Columns besides the two named
are not read, so none clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written
from .vectors import MOST, as_long, batched, exact, finite, floors, limbs, looked_up, matrix

K, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, 1


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid, the smaller number on ties; exact."""
    v, c = exact(vectors, centroids)
    d = np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)
    best = d.argmin(axis=1)
    return best.astype(np.int64), d[np.arange(len(v)), best]


def _sums(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, place, low, high, n): for each centroid and component, the sum over the vectors nearest to it."""
    k, dims = centroids.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((k, dims), object), [0] * k
        for t in batched(batches):
            v, n = matrix(t.column(0).chunk(0)), t.column(1).to_numpy()
            of, _ = nearest(v, centroids)
            if max(int(abs(v).max()), 1) * int(n.sum()) >= 1 << 62:
                v, n = v.astype(object), n.astype(object)
            for c in np.unique(of).tolist():
                mine = of == c
                total[c] += (v[mine] * n[mine, None]).sum(axis=0).astype(object)
                rows[c] += int(n[mine].sum())
        low, high = limbs(total)
        at = [np.repeat(np.arange(k), dims), np.tile(np.arange(dims), k), np.repeat(np.array(rows, np.int64), dims)]
        some = np.flatnonzero(at[2])
        cols = [pa.array(at[0][some]), pa.array(at[1][some]), low.take(pa.array(some)), high.take(pa.array(some)), pa.array(at[2][some])]
        yield pa.RecordBatch.from_arrays(cols, ["cluster", "place", "low", "high", "n"])

    parts = distinct.select("q", "n").mapInArrow(each, "cluster long, place long, low long, high long, n long")
    return parts.groupBy("cluster", "place").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n"))


def moved(centroids: np.ndarray, distinct: DataFrame) -> np.ndarray:
    """Centroids after one round: floored means of their vectors; those without a vector stay."""
    out = centroids.astype(object)
    for r in _sums(distinct, centroids).collect():  # k * dims rows at most
        out[r.cluster, r.place] = (r.high * (1 << 32) + r.low) // r.n
    return out.astype(np.int64)


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batched(batches):
            of, d = nearest(matrix(t.column(0).chunk(0)), centroids)
            yield pa.RecordBatch.from_arrays([t.column(0).chunk(0), t.column(1).chunk(0), pa.array(of.astype(np.int32)), as_long(d)], ["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(each, "q array<long>, n long, cluster int, distance long")


def cluster(vectors: DataFrame, *, vec_id="vec_id", vector="embedding", k=K, rounds=ROUNDS, scale=SCALE, dims=DIMS, seed=SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its final components)."""
    spark = vectors.sparkSession
    v = F.col(vector)
    rows = vectors.where(finite(v) & (F.size(v) == dims)).select(F.col(vec_id).alias("vec_id"), floors(v, scale).alias("q"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = rows.select(order.alias("h"), "q").orderBy("h", "q").limit(k).collect()  # k rows
    centroids = np.array([r.q for r in first], np.int64).reshape(len(first), dims)
    if not len(centroids):
        return _none(rows)
    distinct = written(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "centroid-vectors")
    for _ in range(rounds):
        centroids = moved(centroids, distinct)
    assigned = written(_assigned(distinct, centroids), "centroid-assigned")
    weighed = F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    totals = assigned.groupBy("cluster").agg(F.sum(weighed).alias("inertia"), F.sum("n").alias("n")).collect()  # k rows at most
    whole = min(sum(int(r.inertia) for r in totals), MOST)
    of = [(r.cluster, min(int(r.inertia), MOST), whole, centroids[r.cluster].tolist()) for r in totals]
    of = F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid array<long>"))
    found = looked_up(rows, assigned, "q", "n", sum(r.n for r in totals))
    return found.select("vec_id", "cluster", "distance").join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _none(rows: DataFrame) -> DataFrame:
    kinds = (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))
    return rows.where(F.lit(False)).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in kinds])


def digest(values) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in values).encode()).hexdigest()


def _oracle() -> str:
    ctes = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS (SELECT r, i, q[i] AS x FROM (SELECT r, q, unnest(range(1, 65)) AS i FROM v))",
        "c0 AS (SELECT c, i, q[i] AS m FROM (SELECT q, c, unnest(range(1, 65)) AS i FROM (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c FROM v QUALIFY c < 16)))",
    ]
    for t in range(4):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, sum((x - m) * (x - m)) AS d FROM x JOIN c{t} USING (i) GROUP BY r, c) GROUP BY r)")
        if t < 3:  # an exact floor of a quotient: % keeps the dividend's sign
            ctes.append(f"s{t} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN x USING (r) GROUP BY c, i)")
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{t} LEFT JOIN s{t} USING (c, i))")
    ctes.append("h AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN v USING (r) JOIN h USING (c)"""


ORACLE = _oracle()
