"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, one word-shingle hash per shingle, majority per bit. Equal fingerprints collapse first, so groups
of exact copies cost one row. Bits are grouped into m partitions, correlated bits together; partition thresholds t_i
with sum(t_i) = limit - m + 1 keep every link: two fingerprints within `limit` bits differ by at most t_i bits in some
partition i. A dynamic programme picks m and the thresholds with the least estimated candidates and probes. The estimate
comes from a bounded sample; it decides cost only, never which links are found.

Buckets are verified by breadth-first search over their unvisited members, which yields a spanning forest and not all
pairs. A bucket of more than CHUNK members is cut into chunks, and each pair of chunks is a task's unit of its own.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null doc_id is kept and never becomes a
component's id unless it has no other. Empty input: no rows. Repeated rows are kept, in the same component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import small, written

BITS, LIMIT, CHUNK, SAMPLE = 64, 3, 2048, 4000
_PLACE = 256 * np.arange(8)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text: A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    size = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(size)
    flat, starts, stops = b" ".join(words), (ends - size).tolist(), (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    digest, n, votes = xxhash.xxh64_digest, len(stops), np.zeros((8, 256), np.int64)
    for at in range(0, n, 65536):
        raw = b"".join([digest(flat[a:b], seed) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])])
        byte = np.frombuffer(raw, np.uint8).reshape(-1, 8) + _PLACE
        votes += np.bincount(byte.ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(2 * (votes @ _BYTE_BITS).ravel() > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(2)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, text_hash long, fp long")


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal width; each grows by the bit most correlated with what it holds."""
    if len(bits) > 2:
        spread = bits.std(axis=0)
        with np.errstate(all="ignore"):
            corr = np.abs(np.nan_to_num(np.corrcoef(bits, rowvar=False)))
    else:
        spread, corr = np.ones(BITS), np.zeros((BITS, BITS))
    free, out = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [min(free, key=lambda b: (-spread[b], b))]
        free.remove(group[0])
        while len(group) < size:
            best = min(free, key=lambda b: (-corr[b, group].sum(), b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def plan_search(sample: np.ndarray, n: int, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] with the least estimated probes and candidates for n distinct fingerprints."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    other = np.roll(bits, len(bits) // 2, axis=0)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, limit + 2):
        groups, total = _groups(bits, m), limit - m + 1
        cost = []
        for g in groups:
            near = (np.abs(bits[:, g] - other[:, g]).sum(axis=1)[None, :] <= np.arange(limit + 1)[:, None]).mean(axis=1) if len(bits) else np.ones(limit + 1)
            # candidates of one fingerprint, never below what even spread gives; 4: a probe costs more than a comparison
            near = np.maximum(near * (near > 2 / max(1, len(bits))), [sum(comb(len(g), j) for j in range(t + 1)) / 2.0 ** len(g) for t in range(limit + 1)])
            probes = [sum(comb(len(g), j) for j in range(t + 1)) for t in range(limit + 1)]
            cost.append([0.0] + [4.0 * p + n * c * (1 if t == 0 else p**0.5) for t, (p, c) in enumerate(zip(probes, near))])  # at -1, 0, 1...
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:  # sums of t_i + 1
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (v, ts) in table.items():
                for t, x in enumerate(c):
                    if s + t <= total + m and (s + t not in after or v + x < after[s + t][0]):
                        after[s + t] = (v + x, [*ts, t - 1])
            table = after
        v, ts = table[total + m]
        if v < best[0]:
            best = (v, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def _variants(width: int, t: int) -> list[int]:
    """All values of `width` bits with at most t of them set."""
    out, layer = [0], [(0, -1)]
    for _ in range(t):
        layer = [(v | 1 << b, b) for v, last in layer for b in range(last + 1, width)]
        out += [v for v, _ in layer]
    return out


def _probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): a row for each partition and each variant within its threshold. key tells the partition too."""
    flips = [np.array(_variants(len(g), t), np.uint64) for g, t in plan]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, (g, _) in enumerate(plan):
                part = np.zeros(len(fp), np.uint64)
                for k, bit in enumerate(g):
                    part |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
                for at in range(0, len(flips[i]), 64):
                    some = flips[i][at : at + 64]
                    key = (part[:, None] ^ some[None, :]).ravel()
                    # one to one within a partition; two partitions that meet in a key only add candidates
                    key = (key * mix + np.uint64((i + 1) * 0xD1B54A32D192ED03 % 2**64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(fp.view(np.int64), len(some)))], ["key", "fp"])

    return fps.select("fp").mapInArrow(each, "key long, fp long")


def _forest(fp: np.ndarray, limit: int) -> tuple[list, list]:
    """Links that join all of fp that chains of links join: breadth-first over what is not yet reached."""
    a, b, left = [], [], fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= limit
            if near.any():
                new = left[near]
                a.append(np.full(len(new), x))
                b.append(new)
                queue += list(new)
                left = left[~near]
    return a, b


def _links(key: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal key."""
    edge = np.flatnonzero(np.diff(key)) + 1
    first, last = np.r_[0, edge], np.r_[edge, len(key)]
    size = last - first
    a, b = [], []
    little = np.repeat(size <= 32, size)
    room = np.repeat(last, size) - np.arange(len(key))
    for d in range(1, 32):
        i = np.flatnonzero(little & (room > d))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= limit]
        a.append(fp[i])
        b.append(fp[i + d])
    for k in np.flatnonzero(size > 32):
        x, y = _forest(np.unique(fp[first[k] : last[k]]), limit)
        a += x
        b += y
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(fps: DataFrame, plan: list[tuple[list[int], int]], limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links among the distinct fingerprints that join just what all links within `limit` bits join."""
    rows = _probes(fps, plan)
    sizes = written(rows.groupBy("key").count().where("count > 1"), "simhash-sizes")
    s = small(sizes.where(F.col("count") > chunk).select(F.col("key").alias("hot"), F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    cut = rows.join(s, rows["key"] == s["hot"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    units = F.when(F.col("hot").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.xxhash64("key", F.least(i, mine), F.greatest(i, mine)))
    )
    dealt = cut.select(F.explode(units).alias("key"), "fp")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vals = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, v):
            a, b = _links(k, v, limit)
            differ = a != b
            a, b = a[differ].view(np.int64), b[differ].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            vals = np.concatenate([vals, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            whole = np.searchsorted(keys, keys[-1], "left")  # the last key may go on in the next batch
            if whole:
                yield out(keys[:whole], vals[:whole])
                keys, vals = keys[whole:], vals[whole:]
        if len(keys):
            yield out(keys, vals)

    return dealt.mapInArrow(each, "a long, b long")


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", shingle=3, seed=42, limit=LIMIT, chunk=CHUNK) -> DataFrame:
    """(doc_id, text_hash, fp, fingerprint, root, component_id): component_id is the smallest doc_id that chains of links reach.

    root tells components apart, which share an id only where rows with different texts share a doc_id.
    """
    prints = written(fingerprints(docs, doc_id, text, shingle, seed), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    n = distinct.count()
    some = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()  # bounded by SAMPLE
    plan = plan_search(np.array([r[0] for r in some], np.int64).view(np.uint64), n, limit)
    roots = components(links(distinct, plan, limit, chunk))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = written(of, "simhash-roots")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(ids, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    of = small(written(of, "simhash-components"))
    return prints.join(of, prints["fp"] == of["_fp"]).select("doc_id", "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id")


def one_of_each(docs: DataFrame, *, doc_id="doc_id", text="text", near=near_duplicates, **options) -> DataFrame:
    """docs with one row of each component that `near` finds, that of its component_id. Further columns come along, whatever their names."""
    found = near(docs, doc_id=doc_id, text=text, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select("x.doc_id", "x.text_hash")
    keep = first.select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_hash"))
    # rows that are repeated in full: only those are compared
    copies = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_copies"))
    match = F.col("_kept").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    keep = small(written(keep.join(copies, match).select("_kept", "_hash", "_copies"), "simhash-keep"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), _text_hash(text).alias("hash"))  # so that no name of docs clashes
    rows = rows.join(keep, rows["id"].eqNullSafe(keep["_kept"]) & (rows["hash"] == keep["_hash"]))
    once = rows.where("_copies = 1").select("row.*")
    return once.unionByName(rows.where("_copies > 1").dropDuplicates(["_kept", "_hash"]).select("row.*"))
