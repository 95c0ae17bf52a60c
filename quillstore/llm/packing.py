"""Hierarchical multi-length packing of documents into token sequences.

A document's tokens (and an end id) are cut at multiples of the window. The tail of a document longer than the window,
which is cut anyway, is cut further at the tiers' sizes, largest first; a document that fits into a window stays whole.
Each piece is routed to the shortest tier that holds it, and the tiers are packed from the longest down, each to its own
context: a piece opens a sequence, the longest pieces that fit, of its own tier or shorter ones, fill its gap. What ends
exactly full stays in its tier's context. A sequence of a short tier that does not is a block, and blocks are packed into
whole windows like pieces, so that all padding is in whole windows and little. Step groups hold the same number of tokens
whatever their tier, and sequences are dealt to them in snake order by length.

Texts are tokenised once, on the map side, where the checksum of each piece is taken too; only the pieces' few numbers
are shuffled. Null text: an empty document, of the end id alone. Very long texts: cut like others, a text's ids at a time
in memory. Ties in length keep the order of the rows' hash. Empty input: no rows. Repeated rows are packed each.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, TIERS, BATCH, STEP = 1024, (1024, 512, 256, 128), 40_000, 64
# Fixed value: where byte-level BPE of this kind cuts a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

def _byte_names() -> dict[str, int]:
    """Byte-level BPE's names of bytes: printable ones are themselves, the others take the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, by the vocabulary of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        names = _byte_names()
        ranks = {bytes(names[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.encode = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One tokenizer for each worker process."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, tokenizer: str, *, doc_id="doc_id", text="text", window=WINDOW, tiers=TIERS, end_id=0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's windows and its tail, cut at the tiers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = tokens(tokenizer), int(end_id).to_bytes(4, "little")
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                raw = ids_of(t.as_py() or "") + end
                at = 0
                for n in cuts(len(raw) // 4, window, tiers):
                    part = raw[4 * at : 4 * (at + n)]
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    at += n
                    crc.append(zlib.crc32(part))
                    total.append(len(raw) // 4)
            long = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *long], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def cuts(total: int, window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[int]:
    """Lengths of the pieces of a document of `total` tokens: whole windows, then its tail at the tiers' sizes."""
    out = [window] * (total // window)
    left = total - window * len(out)
    for size in sorted(tiers, reverse=True) if out else ():
        while left >= size:
            out.append(size)
            left -= size
    return out + [left] * bool(left)


class _Stacks:
    """Indices by size; the largest size up to a limit is found by the bits of a number."""

    def __init__(self) -> None:
        self.of: dict[int, list] = {}
        self.have = 0

    def put(self, size: int, what) -> None:
        self.of.setdefault(size, []).append(what)
        self.have |= 1 << size

    def take(self, most: int, least: int = 0):
        """(size, what) of the largest size in least..most, or None."""
        size = (self.have & ((1 << (most + 1)) - 1)).bit_length() - 1
        if size < max(least, 0):
            return None
        what = self.of[size].pop()
        if not self.of[size]:
            self.have ^= 1 << size
        return size, what


def fill(lengths: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[int]]]:
    """(context, indices) of each sequence. Contexts are the window and those of the tiers that are powers of two."""
    left, blocks, out = _Stacks(), _Stacks(), []
    for i in reversed(range(len(lengths))):
        left.put(lengths[i], i)
    sizes = sorted({window, *(t for t in tiers if t < window and t & (t - 1) == 0)}, reverse=True)

    def fit(gap: int, seq: list[int]) -> int:
        while got := left.take(gap, 1):
            seq.append(got[1])
            gap -= got[0]
        return gap

    # a tier's pieces are longer than the next tier's context; the last tier takes all that is left
    for size, below in zip(sizes, [*sizes[1:], 0]):
        while got := left.take(size, below + 1):
            seq = [got[1]]
            gap = fit(size - got[0], seq)
            if size == window or not gap:
                out.append((size, seq, gap))
            else:
                blocks.put(size - gap, seq)
    # blocks fill what is left open, the fullest windows first; then they share windows of their own
    out.sort(key=lambda x: x[2])
    for k, (size, seq, gap) in enumerate(out):
        while gap and (got := blocks.take(gap, 1)):
            seq += got[1]
            gap -= got[0]
        out[k] = (size, seq, gap)
    while got := blocks.take(window, 1):
        seq, gap = list(got[1]), window - got[0]
        while got := blocks.take(gap, 1):
            seq += got[1]
            gap -= got[0]
        out.append((window, seq, gap))
    return [(context(size - gap, window), seq) for size, seq, gap in out]


def context(total: int, window: int = WINDOW) -> int:
    """Tokens a sequence takes: itself if a power of two, else the window."""
    return total if total & (total - 1) == 0 else window


def pack(parts: DataFrame, *, window=WINDOW, tiers=TIERS, batch=BATCH, step=STEP) -> DataFrame:
    """parts with sequence_id, offset, context, tier (of the piece) and step_group.

    Pieces are dealt to the shuffle partitions by hash and packed in batches of `batch`, so memory is bounded. Within a
    partition they come in the order of a second hash, so that every batch holds all lengths, however many there are,
    and a task that runs again gives the same sequences.
    """

    def packed(rows: pa.Table, base: int) -> tuple[pa.RecordBatch, int]:
        lengths = rows.column("length").to_pylist()
        found = fill(lengths, window, tiers)
        contexts, seqs = np.array([c for c, _ in found], np.int64), [s for _, s in found]
        size = np.array([sum(lengths[i] for i in s) for s in seqs])
        group, groups = np.empty(len(seqs), np.int64), 0
        for c in np.unique(contexts)[::-1]:  # a step holds as many tokens of short contexts as of long ones
            own = np.flatnonzero(contexts == c)
            n = max(1, -(-len(own) * int(c) // (step * window)))
            turn = np.arange(len(own)) % (2 * n)
            group[own[np.argsort(-size[own], kind="stable")]] = groups + np.where(turn < n, turn, 2 * n - 1 - turn)
            groups += n
        order = [i for s in seqs for i in s]
        n = np.array([len(s) for s in seqs])
        of = np.repeat(np.arange(len(seqs)), n)
        own = np.array(lengths, np.int64)[order]
        before = np.cumsum(own) - own
        offset = before - np.repeat(before[np.cumsum(n) - n], n)
        ends = np.array(sorted({*tiers, window}))
        tier = ends[np.searchsorted(ends, own)]
        rows = rows.take(pa.array(order))
        more = {"sequence_id": base + of, "offset": offset, "context": contexts[of], "tier": tier, "step_group": base + group[of]}
        for k, v in more.items():
            rows = rows.append_column(k, pa.array(v.astype(np.int64)))
        return rows.combine_chunks().to_batches()[0], base + len(seqs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, n = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, batch - n))
                n += held[-1].num_rows
                b = b.slice(held[-1].num_rows)
                if n == batch:
                    out, base = packed(pa.Table.from_batches(held), base)
                    held, n = [], 0
                    yield out
        if n:
            yield packed(pa.Table.from_batches(held), base)[0]

    more = "sequence_id long, offset long, context long, tier long, step_group long"
    spark = parts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "start", "doc_tokens", "ids_crc32"]
    dealt = parts.repartition(n, *keys).sortWithinPartitions(F.xxhash64(F.lit(1), *keys), *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.mapInArrow(each, f"{schema}, {more}")


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id="doc_id", text="text", window=WINDOW, tiers=TIERS, end_id=0, **options) -> DataFrame:
    """One row per piece: where its ids lie in its document and in its sequence."""
    return pack(pieces(docs, tokenizer, doc_id=doc_id, text=text, window=window, tiers=tiers, end_id=end_id), window=window, tiers=tiers, **options)
