"""Benchmark decontamination by training suffix arrays: every test suffix is binary-searched in every shard.

Words are `[0-9a-z]` and all beyond ASCII, A-Z lower-cased. An item's windows are its runs of `window` words; an item of
fewer words is one window. A shard is the documents of an Arrow batch, as numbers of the benchmark's words (0 for all
others, and between documents). Its suffix array holds, in order of their leading `window` words, the starts whose leading
words begin some test window: no other can match one. Each test suffix's window is looked up by binary search, which
gives all of its places in the shard. Those places are then ordered to full depth, and each test suffix found is searched
there once more: its longest verbatim match is with a neighbour. Longest matches reduce to one for each item.

The benchmark is cut into blocks of at most BLOCK words, each broadcast for one pass over the documents, so a benchmark of
any size is searched; one of the usual size is one block. Items longer than SEGMENT words are cut into segments that
overlap by a window, so no window is lost; a longest match is one within a segment.

Null texts have no words; items without words have no window. Items are told apart by item_id: rows that share one are
one item, and a null item_id is the item `null`. Texts of any length are split in pieces. Documents that are equal in
doc_id and text come back each. No documents: no rows. Only the named columns are read; `decontaminate` keeps all others.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written

WINDOW, BLOCK, SEGMENT = 10, 500_000, 8192
SLOTS = 22  # bits of the table of leading words
CANDIDATES = 500_000  # starts sorted at a time
DEEP = 1 << 25  # bytes of suffixes sorted at a time
PIECE = 1 << 22  # bytes of a text split at a time

#: Bytes of words as they are, A-Z in lower case, all others white space.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, in pieces."""
    raw, at = raw or b"", 0
    while at < len(raw):
        to = min(at + PIECE, len(raw))
        part = raw[at:to].translate(_WORDS)
        if to < len(raw) and (cut := part.rfind(b" ")) >= 0:
            part, to = part[:cut], at + cut + 1
        elif to < len(raw):  # one word goes beyond the piece: it is taken whole
            more = raw[to:].translate(_WORDS).find(b" ")
            to = len(raw) if more < 0 else to + more
            part = raw[at:to].translate(_WORDS)
        yield part.split()
        at = to


@dataclass
class Index:
    """A block of test suffixes."""

    names: list[str]  # items
    ids: dict[bytes, int]  # words, from 1
    text: np.ndarray  # numbers of the words of all segments, 0 after each
    item: np.ndarray  # of each window
    at: np.ndarray  # in its item, of each window's first word
    place: np.ndarray  # in text, of each window
    end: np.ndarray  # in text, of each window's segment
    width: np.ndarray  # of each distinct window
    low: np.ndarray  # least and greatest key that begin with a distinct window
    high: np.ndarray
    first: np.ndarray  # windows by distinct window: those of i are order[first[i]:first[i + 1]]
    order: np.ndarray
    lead: int  # words by which starts are picked
    slots: np.ndarray  # which leading words begin a window
    window: int


def _keys(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The `window` words from each place as bytes that sort as the numbers do. text goes on for `window` words after the last."""
    rows = text[at[:, None] + np.arange(window)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * window}").ravel()


def _slot(text: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
    code = np.zeros(len(at), np.uint64)
    for k in range(lead):
        code = (code ^ text[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return (code >> np.uint64(64 - SLOTS)).astype(np.int64)


def build(segments: list[tuple[str, int, list[bytes]]], window: int) -> Index | None:
    """The index of segments (item, number of the first word in the item, words)."""
    ids: dict[bytes, int] = {}
    text, names, rows = [], {}, []
    for name, begins, ws in segments:
        if not ws:
            continue
        width, start = min(window, len(ws)), len(text)
        item = names.setdefault(name, len(names))
        text += [ids.setdefault(w, len(ids) + 1) for w in ws] + [0]
        rows += [(item, begins + i, start + i, start + len(ws), width) for i in range(len(ws) - width + 1)]
    if not rows:
        return None
    item, at, place, end, width = (np.array(x, np.int64) for x in zip(*rows))
    text = np.array(text + [0] * window, np.int32)
    full = text[place[:, None] + np.arange(window)].astype(">u4")
    beyond = np.arange(window)[None, :] >= width[:, None]
    key = lambda fill: np.ascontiguousarray(np.where(beyond, np.uint32(fill), full).astype(">u4")).view(f"S{4 * window}").ravel()
    low, high = key(0), key(0xFFFFFFFF)
    _, one, of = np.unique(low, return_index=True, return_inverse=True)  # a short window holds a 0, a full one none: no two are equal
    lead = int(min(3, width.min()))
    slots = np.zeros(1 << SLOTS, bool)
    slots[_slot(text, place, lead)] = True
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(one)))])
    return Index(list(names), ids, text, item, at, place, end, width[one], low[one], high[one], first, np.argsort(of, kind="stable"), lead, slots, window)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0]-1, first[1]..last[1]-1, and so on."""
    size = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def places(text: np.ndarray, index: Index, most: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """(place, distinct window) of every occurrence in a shard's text, by its suffix array."""
    known = np.flatnonzero(text)
    known = known[index.slots[_slot(text, known, index.lead)]]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(known), most):
        array = known[i : i + most]
        keys = _keys(text, array, index.window)
        order = np.argsort(keys, kind="stable")
        array, keys = array[order], keys[order]
        low, high = np.searchsorted(keys, index.low, "left"), np.searchsorted(keys, index.high, "right")
        out.append((array[_ranges(low, high)], np.repeat(np.arange(len(low)), high - low)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def longest(text: np.ndarray, found: np.ndarray, windows: np.ndarray, index: Index) -> dict[int, tuple[int, int, int]]:
    """item: (words, place in the item, place in the text) of its longest match. found, windows: as `places` gives them."""
    best: dict[int, tuple[int, int, int]] = {}
    kinds = np.unique(windows)
    tests = index.order[_ranges(index.first[kinds], index.first[kinds + 1])]
    starts = np.unique(found)
    depth = int((index.end[tests] - index.place[tests]).max())
    raw, test = np.concatenate([text, np.zeros(depth, text.dtype)]).astype(">u4").tobytes(), index.text.astype(">u4").tobytes()
    per = max(1, DEEP // (4 * depth))
    for i in range(0, len(starts), per):
        array = sorted(starts[i : i + per].tolist(), key=lambda p: raw[4 * p : 4 * (p + depth)])
        for t in tests.tolist():
            a, n = int(index.place[t]), int(index.end[t] - index.place[t])
            at = bisect.bisect_left(array, test[4 * a : 4 * (a + n)], key=lambda p: raw[4 * p : 4 * (p + n)])
            for p in array[max(at - 1, 0) : at + 1]:
                differ = np.flatnonzero(text[p : p + n] != index.text[a : a + min(n, len(text) - p)])
                size = int(differ[0]) if len(differ) else min(n, len(text) - p)
                item = int(index.item[t])
                if size >= min(index.window, n) and (item not in best or (-size, index.at[t], p) < (-best[item][0], *best[item][1:])):
                    best[item] = (size, int(index.at[t]), p)
    return best


_SCHEMA = "row_key binary, doc_id {}, n_words long, runs array<struct<first:long,last:long>>, items array<string>, matches array<struct<item:string,words:long,item_at:long,doc_at:long>>"


def _pass(docs: DataFrame, index: Index, kind: str) -> DataFrame:
    """A row for each document: its words, and what of the block it holds. matches: those of items whose longest in the shard is here."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        get, window = index.ids.get, index.window
        for b in batches:
            parts, starts, counts, n = [], [], [], 0
            for t in b.column(2):
                starts.append(n)
                for ws in words(t.as_py()):
                    parts.append(np.array([get(w, 0) for w in ws], np.int32))
                    n += len(ws)
                counts.append(n - starts[-1])
                parts.append(np.zeros(1, np.int32))
                n += 1
            text = np.concatenate([*parts, np.zeros(window, np.int32)])
            starts = np.array(starts, np.int64)
            found, windows = places(text, index)
            runs: dict[int, list] = {}
            items: dict[int, set] = {}
            matches: dict[int, list] = {}
            if len(found):
                edge = np.zeros(len(text) + window + 1, np.int64)
                np.add.at(edge, found, 1)
                np.add.at(edge, found + index.width[windows], -1)
                hit = np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)
                turn = np.diff(hit)
                first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
                doc = np.searchsorted(starts, first, "right") - 1
                for d, f, z in zip(doc.tolist(), (first - starts[doc]).tolist(), (last - starts[doc]).tolist()):
                    runs.setdefault(d, []).append({"first": f, "last": z})
                pairs = np.unique(np.stack([np.searchsorted(starts, found, "right") - 1, windows], axis=1), axis=0)
                for d, w in pairs.tolist():
                    items.setdefault(d, set()).update(index.item[index.order[index.first[w] : index.first[w + 1]]].tolist())
                for i, (size, at, p) in longest(text, found, windows, index).items():
                    d = int(np.searchsorted(starts, p, "right")) - 1
                    matches.setdefault(d, []).append({"item": index.names[i], "words": size, "item_at": at, "doc_at": p - int(starts[d])})
            each_doc = range(b.num_rows)
            span, text_list = pa.struct([("first", pa.int64()), ("last", pa.int64())]), pa.list_(pa.string())
            match = pa.struct([("item", pa.string()), ("words", pa.int64()), ("item_at", pa.int64()), ("doc_at", pa.int64())])
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array([runs.get(d) for d in each_doc], pa.list_(span)),
                pa.array([[index.names[i] for i in items[d]] if d in items else None for d in each_doc], text_list),
                pa.array([matches.get(d) for d in each_doc], pa.list_(match)),
            ], ["row_key", "doc_id", "n_words", "runs", "items", "matches"])

    return docs.mapInArrow(each, _SCHEMA.format(kind))


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block: int, segment: int) -> Iterator[list[tuple]]:
    """The benchmark's segments, in blocks of at most `block` words (or of one segment)."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, t in zip(b.column(0), b.column(1)):
                ws, at = [w for part in words(t.as_py()) for w in part], 0
                while ws:
                    some = ws[at : at + segment]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([at], pa.int64()), pa.array([len(some)], pa.int64()), pa.array([some], pa.list_(pa.binary()))], ["item", "at", "n", "words"])
                    if at + segment >= len(ws):
                        break
                    at += segment - window + 1

    segments = written(rows.mapInArrow(each, "item string, at long, n long, words array<binary>"), "leaks-items")
    total = segments.agg(F.sum("n")).collect()[0][0] or 0
    blocks, most = -(-total // block), block + 1
    while blocks and most > max(block, segment):  # dealt by hash: more blocks until the largest is small enough
        of = F.pmod(F.xxhash64("item", "at", "words"), F.lit(blocks))
        most = segments.groupBy(of).agg(F.sum("n").alias("n")).agg(F.max("n")).collect()[0][0]
        blocks *= 1 if most <= max(block, segment) else 2
    for i in range(blocks):
        yield [(r["item"], r["at"], r["words"]) for r in segments.where(of == i).orderBy("item", "at", "words").toArrow().to_pylist()]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))))
    return docs.select(key.alias("row_key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))


def passes(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW, block=BLOCK, segment=SEGMENT) -> list[DataFrame]:
    """A written table for each block of the benchmark, of a row for each document; of blocks after the first, only those with matches."""
    keyed, kind, out = _keyed(docs, doc_id, text), docs.schema[doc_id].dataType.simpleString(), []
    for segments in _blocks(benchmark, item_id, item_text, window, block, max(segment, window)):
        index = build([(i, at, ws) for i, at, ws in segments], window)
        if index is not None:
            found = _pass(keyed, index, kind)
            out.append(written(found.where("runs is not null") if out else found, "leaks-found"))
    if not out:  # a benchmark without words
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("runs", "array<struct<first:long,last:long>>"), ("items", "array<string>"), ("matches", "array<struct<item:string,words:long,item_at:long,doc_at:long>>"))]
        plain = F.regexp_count(F.lower(F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        out.append(keyed.select("row_key", "doc_id", F.coalesce(plain, F.lit(0)).cast("long").alias("n_words"), *nothing))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), runs of hit words, contaminated, row_key."""
    found = passes(docs, benchmark, **options)
    rows = found[0].select("row_key", "doc_id", "n_words", "runs", "items")
    if len(found) > 1:  # what all passes found of a document; copies have found the same
        each = [f.where("runs is not null").groupBy("row_key").agg(F.first("runs").alias("runs"), F.first("items").alias("items")) for f in found]
        merged = reduce(DataFrame.unionByName, each).groupBy("row_key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
        merged = written(merged, "leaks-merged")
        rows = rows.select("row_key", "doc_id", "n_words").join(merged, "row_key", "left")
    none = F.array().cast("array<string>")
    items = F.array_sort(F.array_distinct(F.coalesce("items", none)))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["last"] - F.greatest(x["first"], a["to"] + 1) + 1)).alias("n"), F.greatest(a["to"], x["last"]).alias("to")
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to"))
    runs = F.array_sort(F.coalesce("runs", F.array().cast("array<struct<first:long,last:long>>")))
    hit = F.aggregate(runs, start, step)["n"]
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), runs.alias("runs"), (hit > 0).alias("contaminated"), "row_key")


def longest_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(item, words, item_at, doc_id, doc_at): each item's longest verbatim match in all documents; ties: the first in item, doc_id, document."""
    found = reduce(DataFrame.unionByName, passes(docs, benchmark, **options))
    rows = found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    best = F.min(F.struct((-F.col("words")).alias("less"), "item_at", "doc_id", "doc_at"))
    return rows.groupBy("item").agg(best.alias("b")).select("item", (-F.col("b.less")).alias("words"), "b.item_at", "b.doc_id", "b.doc_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """docs without the contaminated ones, with all their columns."""
    bad = scan(docs, benchmark, doc_id=doc_id, text=text, **options).where("contaminated").select("row_key").distinct()
    bad = written(bad, "leaks-bad")
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(bad, rows["key"] == bad["row_key"], "left_anti").select("row.*")


ORACLE = r"""WITH low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
starts AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, sizes WHERE len(w) >= k)),
found AS (SELECT r, i, k, item FROM starts JOIN wins USING (k, win)),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""
