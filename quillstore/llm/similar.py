"""Near duplicates by the exact Jaccard similarity of word shingles, candidates by MinHash.

A text is the set of its shingles' 64-bit hashes. Equal sets collapse first. 32 bands of 4 MinHashes each propose
candidates: a pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 < 1e-7, closer pairs less
often. Components of SimHash's links (simhash.near_duplicates) propose candidates too, if asked for. Buckets with the same members count once. Candidates are verified on the sets themselves, by breadth-first search
over the unvisited members of a band, which yields a spanning forest and not all pairs. A band of more than CHUNK
members is cut into chunks, and each pair of chunks is a task's unit of its own.

Nulls: a null text has no shingle and is linked with other texts without words; a null doc_id is kept and never becomes
a component's id unless it has no other. Empty input: no rows. Repeated rows are kept, in the same component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .simhash import _text_hash
from .util import small, written

SHINGLE, LEAST, BANDS, ROWS, CHUNK = 5, 0.8, 32, 4, 1024
_SALT, _MULT = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS, 1), np.uint64)
_MULT = 2 * _MULT + 1


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    size = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(size)
    flat, starts, stops = b" ".join(words), (ends - size).tolist(), (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    return np.unique(np.array([xxhash.xxh64_intdigest(flat[a:b]) for a, b in zip(starts, stops)], np.uint64))


def bands(grams: np.ndarray) -> list[int]:
    """A key for each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 2048):
        least = np.minimum(least, ((grams[None, at : at + 2048] ^ _SALT) * _MULT).min(axis=1))
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[i * 8 * ROWS : (i + 1) * 8 * ROWS], i) for i in range(BANDS)]


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _signatures(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, grams_hash, keys)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [shingles(t.as_py(), shingle) for t in b.column(2)]
            same = pa.array(_signed([xxhash.xxh64_intdigest(g.tobytes()) for g in grams]))
            keys = pa.array([_signed(bands(g)) for g in grams], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), same, keys], ["doc_id", "text_hash", "grams_hash", "keys"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, text_hash long, grams_hash long, keys array<long>")


def _near(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets that chains of pairs of at least that similarity join."""
    out, left = [], np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            some = left[np.minimum(size[left], size[x]) >= least * np.maximum(size[left], size[x]) - 1e-6]
            both = np.array([np.count_nonzero(_member(sets[i], sets[x])) for i in some], np.int64)
            new = some[both / np.maximum(1, size[some] + size[x] - both) >= least]
            out += [(x, i) for i in new]
            queue += list(new)
            left = np.setdiff1d(left, new, assume_unique=True)
    return out


def _member(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of a is in b; b is sorted."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _links(signs: DataFrame, docs: DataFrame, text: str, shingle: int, least: float, chunk: int, groups: DataFrame | None = None) -> DataFrame:
    """(a, b): links among the hashes of distinct sets. groups (text_hash, key): buckets besides the bands."""
    rows = written(signs.groupBy("grams_hash").agg(F.any_value("keys").alias("keys"), F.min("text_hash").alias("text_hash")), "similar-distinct")
    keyed = rows.select(F.explode("keys").alias("key"), "grams_hash")
    if groups is not None:
        keyed = keyed.unionByName(signs.select("text_hash", "grams_hash").distinct().join(groups, "text_hash").select("key", "grams_hash").distinct())
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.bit_xor(F.xxhash64("grams_hash")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "grams_hash")).alias("y"))
    buckets = members.where("count > 1").groupBy("count", "x", "y").agg(F.min("key").alias("key"))
    buckets = small(written(buckets.select(F.col("key").alias("of"), F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "similar-buckets"))
    mine = F.pmod(F.xxhash64("grams_hash"), F.col("chunks")).cast("int")
    units = F.when(F.col("chunks") == 1, F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.xxhash64("key", F.least(i, mine), F.greatest(i, mine)))
    )
    cut = written(keyed.join(buckets, keyed["key"] == buckets["of"]).select(F.explode(units).alias("unit"), "grams_hash"), "similar-units")
    wanted = cut.select("grams_hash").distinct().join(rows.select("grams_hash", "text_hash"), "grams_hash")
    wanted = small(written(wanted, "similar-wanted"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [shingles(t.as_py(), shingle).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary())], ["of", "grams"])

    texts = docs.select(_text_hash(text).alias("text_hash"), F.col(text).alias("text")).join(wanted, "text_hash").select("grams_hash", "text")
    sets = written(texts.dropDuplicates(["grams_hash"]).mapInArrow(pack, "of long, grams binary"), "similar-sets")
    dealt = cut.join(sets, cut["grams_hash"] == sets["of"]).select("unit", "grams_hash", "grams")
    dealt = dealt.repartition("unit").sortWithinPartitions("unit", "grams_hash")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names, grams = None, [], []

        def out():
            found = _near(grams, least)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.int64()), pa.array([names[j] for _, j in found], pa.int64())], ["a", "b"])

        for b in batches:
            for u, name, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if u != unit:
                    if len(names) > 1:
                        yield out()
                    unit, names, grams = u, [], []
                names.append(name)
                grams.append(np.frombuffer(g.as_py(), np.uint64))
        if len(names) > 1:
            yield out()

    return dealt.mapInArrow(each, "a long, b long")


def simhash_groups(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text_hash, key): the component of SimHash's links that each text is in."""
    found = simhash.near_duplicates(docs, doc_id=doc_id, text=text)
    return written(found.select("text_hash", F.xxhash64(F.lit("simhash"), "root").alias("key")).distinct(), "similar-simhash")


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", shingle=SHINGLE, least=LEAST, chunk=CHUNK, by_simhash=False) -> DataFrame:
    """(doc_id, text_hash, root, component_id): component_id is the smallest doc_id that chains of links reach.

    by_simhash: SimHash's components are candidates besides the bands; the exact check is the same for both.
    """
    signs = written(_signatures(docs, doc_id, text, shingle), "similar-signatures")
    prints = signs.select("doc_id", "text_hash", "grams_hash")
    roots = components(_links(signs, docs, text, shingle, least, chunk, simhash_groups(docs, doc_id, text) if by_simhash else None))
    distinct = prints.groupBy("grams_hash").agg(F.min("doc_id").alias("first"))
    of = written(distinct.join(roots, distinct["grams_hash"] == roots["node"], "left").select("grams_hash", "first", F.coalesce("root", "grams_hash").alias("root")), "similar-roots")
    ids = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = small(written(of.join(ids, "root").select(F.col("grams_hash").alias("_grams"), "root", "component_id"), "similar-components"))
    return prints.join(of, prints["grams_hash"] == of["_grams"]).select("doc_id", "text_hash", "root", "component_id")
