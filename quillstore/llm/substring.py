"""Suffix-array removal of byte strings of `length` bytes that start in two or more places of the corpus.

A suffix for every byte, with `length` bytes of context, would be many times the corpus in shuffled data. Here the
suffixes are sampled by content. Every window of `length` bytes has an anchor, the least of its GRAM-gram hashes
(leftmost on ties), which equal windows share. Starts with one anchor are cut, by their distance to it, into cells of
at most CELL starts. All windows of a cell have a core of at least length - CELL + 1 bytes in common, at a place given
by content alone, so equal windows lie in cells with equal cores. That decides most starts with one row per cell:

  - a cell whose core occurs once has no repeated window;
  - a cell whose whole extent, from its first start to its last window's end, occurs twice, is all repeated. An extent
    that occurs very often is looked up in a broadcast table, whose size is bounded as the occurrences add up to all;
  - the rest, at the ends of repeated stretches, is sorted: one suffix for each kind of extent, which begins at its core.
    Sampled splitters deal these by their leading bytes to range partitions of about BUCKET suffixes, whatever is equal;
    each is sorted by multikey quicksort, and suffixes of one core, now neighbours, are compared window by window. The
    first and the last core of a partition may go on beyond its boundary: their windows, one of each kind, are dealt
    in slices, as many as the core's size asks for, and compared once more across the partitions.

A suffix is its core's LEAD leading bytes, a digest of the whole core in place of the others, and the bytes after it.
So nothing grows with the square of a group of copies, and no group has to fit in a task. Equality is that of 64-bit
digests within a core, so a false match needs two digests that meet by chance at once.

Null text: no bytes. Texts shorter than `length` have no window and stay. Very long texts are hashed in blocks. Repeated
rows count as other documents, so their windows repeat. Empty input: no rows. Columns besides doc_id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written

LENGTH, GRAM, CELL, LEAD, BUCKET, SLICE = 400, 32, 128, 16, 50_000, 1000
#: Bits of the filter that spares unrepeated cells the second pass: 16 to 32 for each repeated core, 4 MB at least and
#: 32 MB at most; false hits only cost time.
FILTER_BITS = (1 << 25, 1 << 28)
#: An extent (or a core) is looked up by broadcast if it has over 1000 rows, and more than this share of them.
OFTEN = 1 / 500_000
BLOCK = 1 << 20  # bytes hashed at a time

_LUT = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` bytes (a power of two), by doubling."""
    h, n, odd = _LUT[data], 1, np.uint64(0x9E3779B97F4A7C15)
    while n < gram:
        h = (h[:-n] * odd) ^ (h[n:] + (h[:-n] >> np.uint64(29)))
        n *= 2
        odd = np.uint64(int(odd) * 0xBF58476D1CE4E5B9 % 2**64 | 1)
    return h ^ (h >> np.uint64(31))


def _anchors(raw: bytes, length: int, gram: int) -> np.ndarray:
    """For each window start, the place of its anchor."""
    data, out = np.frombuffer(raw, np.uint8), []
    span = length - gram + 1  # grams in a window
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        v = (_gram_hashes(part, gram) & ~np.uint64(0x1FFFFF)) | np.arange(len(part) - gram + 1, dtype=np.uint64)
        n = 1
        while 2 * n <= span:  # minima over n, then over span
            v = np.minimum(v[:-n], v[n:])
            n *= 2
        if n < span:
            v = np.minimum(v[: len(v) - (span - n)], v[span - n :])
        out.append((v & np.uint64(0x1FFFFF)).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cells(raw: bytes, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> tuple[np.ndarray, ...]:
    """(anchor, block, first, last) of each cell: starts first..last have anchor - start in [block*cell, block*cell+cell)."""
    a = _anchors(raw, length, gram)
    if not len(a):
        return (a,) * 4
    block = (a - np.arange(len(a))) // cell
    edge = np.flatnonzero((np.diff(a) != 0) | (np.diff(block) != 0)) + 1
    first, last = np.r_[0, edge], np.r_[edge, len(a)] - 1
    return a[first], block[first], first, last


def _core(anchor: int, block: int, length: int, cell: int) -> tuple[int, int]:
    """What all windows of the grid's cell share: from its latest start to its earliest end."""
    return anchor - block * cell, anchor - block * cell - cell + 1 + length


def _key(raw: bytes, block: int) -> int:
    """A signed 64-bit key of a core, or of a whole extent."""
    return int.from_bytes(xxhash.xxh3_64_digest(raw, seed=block), "big", signed=True)


def _cell_rows(raw: bytes, length: int, gram: int, cell: int):
    """(core key, extent key, first, last, core start, core end) of each cell."""
    for a, k, f, z in zip(*(x.tolist() for x in cells(raw, length, gram, cell))):
        lo, hi = _core(a, k, length, cell)
        yield _key(raw[lo:hi], k), _key(raw[f : z + length], (lo - f) * 4096 + z - f), f, z, lo, hi


def _text(x: pa.Scalar) -> bytes:
    return (x.as_py() or "").encode("utf-8", "surrogatepass")


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of suffixes, rows of 64-bit characters: three-way partitions by one character, the next among equals."""
    order, todo = np.arange(len(words)), [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        if hi - lo <= 24:
            order[lo:hi] = sorted(order[lo:hi], key=lambda i: words[i, depth:].tolist())
            continue
        part = order[lo:hi]
        c = words[part, depth]
        pivot = sorted((c[0], c[len(c) // 2], c[-1]))[1]
        less, more = c < pivot, c > pivot
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        i, k = lo + int(less.sum()), hi - int(more.sum())
        todo += [(lo, i, depth), (i, k, depth + 1), (k, hi, depth)]
    return order


def _characters(suffixes: list[bytes]) -> np.ndarray:
    """Suffixes as rows of big-endian 64-bit characters."""
    width = 8 * (1 + max(map(len, suffixes), default=0) // 8)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in suffixes), ">u8").reshape(len(suffixes), -1).astype(np.uint64)


def _windows(left: bytes, right: bytes, first: int, last: int, at: int) -> list[int]:
    """A key for each window: what it adds to the core on either side."""
    digest, shift = xxhash.xxh3_64_digest, at - first
    # a window that starts x bytes before the core ends length - core - x bytes after it
    room = len(right) - (last - first)  # right bytes of the first window
    return [int.from_bytes(digest(left[i:] + b"|" + right[: room + i], seed=shift - i), "big", signed=True) for i in range(last - first + 1)]


def _compare(group: list[dict], open_: bool, per_slice: int) -> tuple[list[tuple], list[tuple]]:
    """Of the suffixes of one core: (row_key, first, last) of repeated starts, and, if the group may go on elsewhere,
    (core, slice, windows, row_keys, starts, asks): one of each kind of window, which asks if it is not decided here."""
    keys = [_windows(r["left"], r["right"], r["first"], r["last"], r["at"]) for r in group]
    count: dict[int, int] = {}
    for ks in keys:
        for k in ks:
            count[k] = count.get(k, 0) + 1
    runs = [(r["row_key"], *run) for r, ks in zip(group, keys) if r["asks"] for run in _runs(r["first"], [count[k] > 1 for k in ks])]
    kinds: dict[int, tuple] = {}
    for r, ks in zip(group, keys) if open_ else ():
        for i, k in enumerate(ks):
            kinds[k] = (k, r["row_key"], r["first"] + i, r["asks"] and count[k] == 1)
    slices: dict[int, list[tuple]] = {}
    for k, kind in kinds.items():
        slices.setdefault(k % -(-group[0]["kinds"] // per_slice), []).append(kind)
    return runs, [(group[0]["core"], k, *zip(*some)) for k, some in slices.items()]


def _sorted_bucket(rows: pa.Table, per_slice: int = SLICE) -> tuple[list[tuple], list[tuple]]:
    """What _compare finds in one range partition, after sorting it."""
    got = rows.to_pylist()
    order = multikey_quicksort(_characters([r["lead"] + (r["core"] + 2**63).to_bytes(8, "big") + r["right"] for r in got]))
    groups: list[list[dict]] = []
    for i in order.tolist():
        if not groups or groups[-1][0]["core"] != got[i]["core"]:
            groups.append([])
        groups[-1].append(got[i])
    runs, windows = [], []
    for n, group in enumerate(groups):
        edge = n in (0, len(groups) - 1)
        if edge or len(group) > 1:
            more, kinds = _compare(group, edge, per_slice)
            runs += more
            windows += kinds
    return runs, windows


def repeated_starts(docs: DataFrame, length: int, gram: int, cell: int, bucket: int) -> DataFrame:
    """(row_key, first, last): runs of starts whose windows start elsewhere too. docs: (row_key binary, text)."""
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, int] = {}
            for t in b.column(0):
                for core, *_ in _cell_rows(_text(t), length, gram, cell):
                    seen[core] = seen.get(core, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["core", "n"])

    cores = docs.select("text").mapInArrow(counted, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where("n > 1")
    cores = written(cores.select("core"), "substring-cores")
    bits = min(max(1 << (16 * cores.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    # the filter of the repeated cores: words of a bitmap
    slot = F.pmod(F.col("core"), F.lit(bits))
    slices = (
        cores.select(slot.alias("slot")).distinct()
        .groupBy(F.expr("slot div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[slices.column("word").to_numpy()] = slices.column("bits").to_numpy()
    bitmap = spark.sparkContext.broadcast(words)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for b in batches:
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1)):
                raw = _text(t)
                for core, extent, f, z, lo, hi in _cell_rows(raw, length, gram, cell):
                    s = core % bits
                    if int(held[s >> 6]) >> (s & 63) & 1:
                        rows.append((i, core, extent, f, z, lo, raw[lo : lo + LEAD], raw[f:lo], raw[hi : z + length]))
            c = list(zip(*rows)) or [()] * 9
            names = ["row_key", "core", "extent", "first", "last", "at", "lead", "left", "right"]
            ints = [pa.array(x, pa.int64()) for x in c[1:6]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), *ints, *[pa.array(x, pa.binary()) for x in c[6:]]], names)

    found = docs.select("row_key", "text").mapInArrow(candidates, "row_key binary, core long, extent long, first long, last long, at long, lead binary, left binary, right binary")
    found = written(found, "substring-cells")
    # how often each core and each extent occurs; false hits of the filter go here
    extents = found.groupBy("core", "extent").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("row_key", "first")).alias("one"))
    extents = written(extents, "substring-extents")
    totals = extents.groupBy("core").agg(F.sum("same").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    sums = written(_looked_up(extents, totals, ["core"], "kinds", extents.count()), "substring-sums")
    places = found.select("core", "extent", "row_key", "first", "last")
    whole = _looked_up(places, sums.where("same > 1").select("core", "extent", "same"), ["core", "extent"], "same", found.count()).select("row_key", "first", "last")
    # one row of each kind of extent goes on; more than one of a kind means repeated by itself, and one serves others
    mixed = sums.where("kinds > 1").select("core", "extent", "one.row_key", "one.first", "kinds", F.expr("same = 1").alias("asks"))
    rows = found.join(mixed, ["core", "extent", "row_key", "first"]).dropDuplicates(["core", "extent"])  # so a hot extent is one row here
    rows = written(rows.select("core", "extent", "row_key", "first", "last", "at", "lead", "left", "right", "kinds", "asks"), "substring-open")

    per_slice = SLICE
    edges = "core long, slice long, windows array<long>, row_keys array<binary>, starts array<long>, asks array<boolean>"

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        runs, windows = _sorted_bucket(pa.Table.from_batches(held), per_slice) if held else ([], [])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int64(), pa.int64()]
        rows = [(*[None] * 6, *x) for x in runs] + [(*x, None, None, None) for x in windows]
        for at in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[at : at + 1000]), kinds)], ["core", "slice", "windows", "row_keys", "starts", "asks", "row_key", "first", "last"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices in order: windows of one core that are in two partitions repeat."""
        now, parts = None, []

        def out():
            count: dict[int, int] = {}
            for r in parts if len(parts) > 1 else ():
                for k in r["windows"]:
                    count[k] = count.get(k, 0) + 1
            hits = [(key, start, start) for r in parts if len(parts) > 1 for k, key, start, asks in zip(r["windows"], r["row_keys"], r["starts"], r["asks"]) if asks and count[k] > 1]
            c = list(zip(*hits)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.binary(), pa.int64(), pa.int64()))], ["row_key", "first", "last"])

        for b in batches:
            for r in b.to_pylist():
                if (r["core"], r["slice"]) != now:
                    yield out()
                    now, parts = (r["core"], r["slice"]), []
                parts.append(r)
        yield out()

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(shuffles, -(-rows.count() // bucket))
    dealt = rows.repartitionByRange(n, "lead", "core", "right", "extent")
    got = written(dealt.mapInArrow(bucketed, f"{edges}, row_key binary, first long, last long"), "substring-runs")
    edge = got.where("core is not null").select("core", "slice", "windows", "row_keys", "starts", "asks")
    edge = edge.repartition(shuffles, "core", "slice").sortWithinPartitions("core", "slice").mapInArrow(across, "row_key binary, first long, last long")
    return whole.unionByName(got.where("core is null").select("row_key", "first", "last")).unionByName(edge)


def _looked_up(rows: DataFrame, table: DataFrame, key: list[str], size: str, n: int) -> DataFrame:
    """rows joined with table on key. size: how many of the n rows have that key; where they are many, it is broadcast."""
    often = max(1000, int(n * OFTEN))
    hot = F.broadcast(table.where(F.col(size) > often))  # fewer than 1 / OFTEN rows, as sizes add up to n at most
    rest = rows.join(hot.select(*key), key, "left_anti").join(table.where(F.col(size) <= often), key)
    return rows.join(hot, key).unionByName(rest)


def _runs(first: int, flags: list[bool]) -> list[tuple[int, int]]:
    """(first, last) of the stretches that are true."""
    out = []
    for i, x in enumerate(flags):
        if x and out and out[-1][1] == first + i - 1:
            out[-1] = (out[-1][0], first + i)
        elif x:
            out.append((first + i, first + i))
    return out


def remove(raw: bytes, runs: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """What is left of raw without the windows that start in runs, and the number of stretches removed."""
    left, at, spans = [], 0, 0
    for first, last in sorted(runs):
        if first > at or not spans:
            left.append(raw[at:first])
            spans += 1
        at = max(at, last + length)
    left.append(raw[at:])
    return b"".join(left), spans


def deduplicate(docs: DataFrame, *, doc_id="doc_id", text="text", length=LENGTH, gram=GRAM, cell=CELL, bucket=BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = keyed.withColumn("row_key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))))
    runs = repeated_starts(keyed.select("row_key", "text"), length, gram, cell, bucket)
    runs = runs.groupBy(F.col("row_key").alias("_key")).agg(F.collect_set(F.struct("first", "last")).alias("runs"))  # one document's
    runs = written(runs, "substring-found").hint("shuffle_hash")
    rows = keyed.join(runs, keyed["row_key"] == runs["_key"], "left").select("doc_id", "text", "runs.first", "runs.last")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, first, last in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw = _text(t)
                kept, spans = remove(raw, list(zip(first or (), last or ())), length)
                out.append((len(raw), len(raw) - len(kept), spans, kept))
            c = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(each, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
