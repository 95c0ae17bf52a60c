"""Integer vectors: quantising, exact sums over tasks, joins of small or skewed totals. Shared by op12 and op13.

Components become integers of at most 2**56 in size: larger ones, beyond any embedding, count as that. Arithmetic is
that of 64-bit integers while no square can leave them, else that of Python's. Distances beyond a long are its maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST, NARROW, MOST = float(1 << 56), 1 << 26, (1 << 63) - 1
#: Rows that a task handles at a time.
ROWS = 8192
#: A key is looked up by broadcast if it has over 1000 rows, and more than this share of them: so there are few such keys.
OFTEN = 1 / 1000


def finite(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def floors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * float(scale), F.lit(-LARGEST)), F.lit(LARGEST))))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays, as Python integers if a square of theirs may not fit 64 bits."""
    wide = any(a.dtype == object or (a.size and max(int(a.max()), -int(a.min())) >= NARROW) for a in arrays)
    return tuple(a.astype(object) if wide else a for a in arrays)


def batched(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Arrow batches put together to about `rows` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def as_long(values) -> pa.Array:
    """Exact integers as longs, the largest at most."""
    return pa.array(values if values.dtype != object else [min(int(v), MOST) for v in values], pa.int64())


def limbs(total: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Integers as (low, high) with value = high * 2**32 + low, so that sums of many tasks stay longs."""
    flat = [int(v) for v in total.ravel()]
    return pa.array([v & 0xFFFFFFFF for v in flat], pa.int64()), pa.array([v >> 32 for v in flat], pa.int64())


def long_sum(column: Column) -> Column:
    """The sum of longs that aren't negative, its largest value at most."""
    return F.least(F.sum(column.cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")


def looked_up(rows: DataFrame, table: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """rows joined with table on key, null equal to null. size: how many of the n rows have that key.

    Keys with many rows are broadcast: fewer than 1 / OFTEN, as sizes add up to n. No other key is large.
    """
    often = max(1000, int(n * OFTEN))
    t = table.withColumnRenamed(key, "_key")
    hot = F.broadcast(t.where(F.col(size) > often))
    same = lambda d: rows[key].eqNullSafe(d["_key"])
    few = t.where(F.col(size) <= often)
    rest = rows.join(hot, same(hot), "left_anti")
    return rows.join(hot, same(hot)).drop("_key").unionByName(rest.join(few, rest[key].eqNullSafe(few["_key"])).drop("_key"))
