"""Vector code compression: product codes over integer vectors, nearest entries by a vantage-point tree for each part.

Vectors become integers floor(scale * x) and are cut into equal parts. Each part position has a codebook, which begins
as that part of the first vectors by vec_id and moves to the floored means of its parts in each round. Entries lie in a
vantage-point tree: a node holds one entry and the others in two halves, by their distance to it. A search goes down it
by branch and bound: a half is passed over only if the triangle inequality, with radii rounded outwards, puts all of it
further than the best so far; halves that may hold a tie are visited. What is visited is measured in integers and decides
by (distance, index), so results are those of a full comparison.

A task sends one sum for each entry and component; the driver gets the codebooks' size a round. Totals by label are
joined back with labels of many rows broadcast, fewer than 1,000 of them, and the others shuffled.

Vectors that are null or hold null or non-finite components are left out, and so are those of another length than the
first kept one has, or not cut evenly by the parts. Repeated vec_ids: order by vector; null vec_ids last; rows count each
and come back each. Null labels are one label. Fewer than `entries` vectors: as many entries. Equal entries: the lower
index takes all. Empty input: no rows. Columns besides the three named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import written
from .vectors import as_long, batched, exact, finite, floors, limbs, long_sum, looked_up, matrix

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 16, 64, 2, 256, 6
#: Relative slack of radii and distances: far more than a few roundings of floating point.
SLACK = 1e-12


@dataclass
class Node:
    """An entry and two halves of the others: `inner` lies within `reach` of it, `outer` from `gap` on. A leaf has entries only."""

    entries: np.ndarray
    reach: float = 0.0
    gap: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


def tree(entries: np.ndarray, of: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """The vantage-point tree of a codebook's entries (a row each)."""
    of = np.arange(len(entries)) if of is None else of
    if len(of) <= leaf:
        return Node(np.sort(of))
    (own,) = exact(entries[of])
    middle = own.astype(float).mean(axis=0)
    at = int(((own.astype(float) - middle) ** 2).sum(axis=1).argmax())  # an outlying entry tells the others apart best
    others = np.delete(of, at)
    d = np.sqrt(((np.delete(own, at, axis=0) - own[at]) ** 2).sum(axis=1).astype(float))
    order = np.argsort(d, kind="stable")
    half = (len(order) + 1) // 2
    return Node(
        of[at : at + 1], float(d[order[half - 1]]) * (1 + SLACK), float(d[order[half]]) * (1 - SLACK),
        tree(entries, others[order[:half]], leaf), tree(entries, others[order[half:]], leaf),
    )


def search(root: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, the lower index on ties; exact."""
    q, e = exact(points, entries)
    best = np.full(len(q), 1 << 62, q.dtype) if q.dtype != object else np.full(len(q), 1 << 200, object)
    who = np.full(len(q), len(e), np.int64)

    def measure(rows: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Squared distances of points to entries; keeps the nearest."""
        d = ((q[rows][:, None] - e[some][None]) ** 2).sum(axis=2)
        k = d.argmin(axis=1)  # `some` ascends: the lower index
        near, i = d[np.arange(len(rows)), k], some[k]
        better = (near < best[rows]) | ((near == best[rows]) & (i < who[rows]))
        hit = rows[better.astype(bool)]
        best[hit], who[hit] = near[better.astype(bool)], i[better.astype(bool)]
        return d

    def visit(node: Node, rows: np.ndarray) -> None:
        d = measure(rows, node.entries)
        if node.inner is None:
            return
        d = np.sqrt(d[:, 0].astype(float))
        inside = d <= (node.reach + node.gap) / 2
        for mine, order in ((inside, (node.inner, node.outer)), (~inside, (node.outer, node.inner))):
            some, far = rows[mine], d[mine]
            for child in order:
                if not len(some):
                    break
                least = far * (1 - SLACK) - node.reach if child is node.inner else node.gap - far * (1 + SLACK)
                go = least <= np.sqrt(best[some].astype(float)) * (1 + SLACK)  # not strict: a tie may have a lower index
                if go.any():
                    visit(child, some[go])

    if len(q):
        visit(root, np.arange(len(q)))
    return who, best


def _nearest(vectors: np.ndarray, books: np.ndarray, trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes by part, squared distance over all parts). books: (part, entry, place)."""
    width = books.shape[2]
    found = [search(trees[p], books[p], vectors[:, p * width : (p + 1) * width]) for p in range(len(books))]
    total = sum(d.astype(object) for _, d in found)
    return np.stack([i for i, _ in found], axis=1), total


def moved(books: np.ndarray, rows: DataFrame) -> np.ndarray:
    """Codebooks after one round: each entry the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = books.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        total, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for t in batched(batches):
            v = matrix(t.column(0).chunk(0))
            for p in range(parts):
                part = v[:, p * width : (p + 1) * width]
                of, _ = search(trees[p], books[p], part)
                (part,) = exact(part)
                sums = np.zeros((entries, width), part.dtype)
                np.add.at(sums, of, part)
                total[p] += sums.astype(object)
                count[p] += np.bincount(of, minlength=entries)
        at = [x.ravel() for x in np.indices(books.shape)]
        n = np.repeat(count.ravel(), width)
        some = pa.array(np.flatnonzero(n))
        cols = [pa.array(x.astype(np.int64)).take(some) for x in at] + [x.take(some) for x in limbs(total)] + [pa.array(n).take(some)]
        yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "place", "low", "high", "n"])

    sums = rows.select("q").mapInArrow(each, "part long, entry long, place long, low long, high long, n long")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n"))
    out = books.astype(object)
    for r in sums.collect():  # as many as the codebooks have components
        out[r.part, r.entry, r.place] = (r.high * (1 << 32) + r.low) // r.n
    return out.astype(np.int64)


@dataclass
class Compressed:
    """codes: (vec_id, label, code: array of indexes by part, error). books: (part, entry, place) integers, null if no vector is kept."""

    codes: DataFrame
    books: np.ndarray | None

    def digest(self) -> str:
        """sha256 of all entries' components by part, entry, place."""
        flat = [] if self.books is None else self.books.ravel().tolist()
        return hashlib.sha256(",".join(str(v) for v in flat).encode()).hexdigest()

    def decoded(self) -> DataFrame:
        """(vec_id, vector): what the codes stand for, in integers."""
        if self.books is None:
            return self.codes.select("vec_id", F.lit(None).cast("array<long>").alias("vector"))
        books = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in self.books])
        return self.codes.select("vec_id", F.flatten(F.transform("code", lambda i, p: F.get(F.get(books, p), i))).cast("array<long>").alias("vector"))


def compress(vectors: DataFrame, *, vec_id="vec_id", vector="embedding", label="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE) -> Compressed:
    """Codes of all kept vectors, and the codebooks."""
    v = F.col(vector)
    rows = vectors.where(finite(v) & (F.size(v) > 0)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), floors(v, scale).alias("q"))
    by = [F.col("vec_id").asc_nulls_last(), "q"]
    head = rows.orderBy(*by).limit(1).collect()
    dims = len(head[0].q) if head else 0
    id_kind, label_kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    schema = f"vec_id {id_kind}, label {label_kind}, code array<int>, error long"
    if not dims or dims % parts:
        return Compressed(rows.where(F.lit(False)).select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")), None)
    rows = written(rows.where(F.size("q") == dims), "codes-vectors")
    first = rows.select("vec_id", "q").orderBy(*by).limit(entries).collect()  # as many as a codebook has entries
    books = np.array([r.q for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = moved(books, rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        for t in batched(batches):
            of, error = _nearest(matrix(t.column("q").chunk(0)), books, trees)
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, of.size + 1, parts, dtype=np.int32)), pa.array(of.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([t.column("vec_id").chunk(0), t.column("label").chunk(0), code, as_long(error)], ["vec_id", "label", "code", "error"])

    return Compressed(written(rows.mapInArrow(each, schema), "codes-assigned"), books)


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: the errors of all rows of one label, nulls together."""
    sums = written(codes.groupBy("label").agg(long_sum(F.col("error")).alias("label_error"), F.count(F.lit(1)).alias("_n")), "codes-labels")
    return looked_up(codes, sums, "label", "_n", codes.count()).drop("_n")


def hex_code(code: str) -> Column:
    """Indexes by part as two lowercase hex digits each."""
    return F.array_join(F.transform(code, lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")


def _oracle() -> str:
    ctes = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "w AS (SELECT r, p, j, q[p * (len(q) // 16) + j + 1] AS x FROM (SELECT r, q, p, unnest(range(len(q) // 16)) AS j FROM (SELECT r, q, unnest(range(16)) AS p FROM v)))",
        "b0 AS (SELECT p, e, j, x AS m FROM w JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM v QUALIFY e < 64) USING (r))",
    ]
    for t in range(3):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, sum((x - m) * (x - m)) AS d FROM w JOIN b{t} USING (p, j) GROUP BY r, p, e) GROUP BY r, p)")
        if t < 2:  # an exact floor of a quotient: % keeps the dividend's sign
            ctes.append(f"s{t} AS (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM a{t} JOIN w USING (r, p) GROUP BY p, e, j)")
            ctes.append(f"b{t + 1} AS MATERIALIZED (SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM b{t} LEFT JOIN s{t} USING (p, e, j))")
    ctes.append("c AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(m::VARCHAR, ',' ORDER BY p, e, j)) FROM b2) AS codebooks_sha256
FROM c JOIN v USING (r)"""


ORACLE = _oracle()
