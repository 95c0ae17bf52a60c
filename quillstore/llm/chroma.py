"""Chroma audio fingerprints: integral-image filters over pitch-class frames, packed integers, offset histograms.

A recording becomes frames of 12 pitch-class energies. Over the image of frames, FILTERS compare sums of rectangles,
read from an integral image; each gives two bits in Gray code, and the 16 of a place are one 32-bit integer. Recordings
of one length are computed together. Two recordings are aligned where their integers agree in the same three of four
bytes at two places, 2 to 12 frames (APART) from each other: a join on those pairs of places votes for offsets, every
offset with MIN_VOTES or more is verified by the share of differing bits over the overlap, and of those that pass the
one with the least share is the pair's. One place alone agrees by chance so often that its votes outgrow the input;
places close together share their frames, so that errors that spare one spare the other. The queries' keys are broadcast
if they are few; else both sides shuffle, and a key that occurs very often is dealt to several tasks by its counted
frequency. Links near MAX_BER can lack such a pair of places: brute force on 51,282 recordings, of which 513 ask, has
4,240 links without offset, and 4,201 of them get a vote.

Recordings with equal fingerprints form one class, so a recording that was stored very often is matched once. Results
are pairs of classes, and the membership of every recording. Integers within a class are distinct rows; nothing is cut.

Null or short recordings (fewer than WIDTH frames) have no integers: they are members of the empty class and match
nothing. Long recordings are one row each. Null ids are kept as members; a class's id is its smallest member. Offsets
that tie: the longer overlap, then the one nearest to 0, then the smaller. Empty input: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util
from .util import written

PITCHES, WIDTH = 12, 16
MAX_BER, MIN_OVERLAP, MIN_VOTES = 0.1, 24, 1
#: Frames between the two places of a vote.
APART = (2, 4, 6, 8, 10, 12)
MASKS = (0xFFFFFF00, 0xFFFF00FF, 0xFF00FFFF, 0x00FFFFFF)
#: Recordings a task makes keys of, until there are 20,000 tasks.
TASK_ROWS = 4096
#: A key's members are dealt out in parts of 2000, or of this share of all members if that is more.
OFTEN = 1 / 100_000
QUANTISE = (-0.12, 0.0, 0.12)  # limits between a filter's four values


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch, pitches, frames) of the 16 filters, by rule: all six kinds, heights and widths that spread."""
    return [(i % 6, (5 * i) % 9, 3 + i % 2, (4, 8, 16, 6)[i % 4]) for i in range(16)]


def _integral(images: np.ndarray) -> np.ndarray:
    return np.pad(images.cumsum(axis=1).cumsum(axis=2), ((0, 0), (1, 0), (1, 0)))


def codes(frames: np.ndarray) -> np.ndarray:
    """The packed integers of frames (n, 12) or of several recordings' (m, n, 12), one for each place with WIDTH frames after it."""
    if frames.ndim == 2:
        return codes(frames[None])[0]
    n = frames.shape[1] - WIDTH + 1
    if n <= 0:
        return np.zeros((len(frames), 0), np.int64)
    total, out = _integral(frames), np.zeros((len(frames), n), np.int64)

    def area(y0, y1, x0, x1):
        late, early = total[:, x1 : x1 + n], total[:, x0 : x0 + n]
        return late[:, :, y1] - early[:, :, y1] - late[:, :, y0] + early[:, :, y0]

    for kind, y, h, w in filters():
        y1, x1, ym, xm = y + h, w, y + h // 2, w // 2
        y3, x3 = max(1, h // 3), max(1, w // 3)
        a = area(y, y1, 0, x1)
        if kind == 1:
            a, b = area(ym, y1, 0, x1), area(y, ym, 0, x1)  # upper against lower
        elif kind == 2:
            a, b = area(y, y1, xm, x1), area(y, y1, 0, xm)  # later against earlier
        elif kind == 3:
            a, b = area(ym, y1, xm, x1) + area(y, ym, 0, xm), area(y, ym, xm, x1) + area(ym, y1, 0, xm)  # diagonals
        elif kind == 4:
            b = area(y + y3, y1 - y3, 0, x1)  # the middle pitches
            a = a - b
        elif kind == 5:
            b = area(y, y1, x3, x1 - x3)  # the middle frames
            a = a - b
        else:
            b = area(0, PITCHES, 0, x1) * h / PITCHES  # against the mean
        value = np.digitize(np.log((1 + a) / (1 + b)), QUANTISE)
        out = out << 2 | (value ^ value >> 1)
    return out


def frames_of_pcm(samples: np.ndarray, rate: int = 11025, size: int = 4096, hop: int = 1365) -> np.ndarray:
    """Pitch-class frames of mono samples: windowed spectra, energies by pitch class from 28 to 3520 Hz, unit length."""
    n = 1 + (len(samples) - size) // hop
    if n <= 0:
        return np.zeros((0, PITCHES))
    at = np.arange(size)[None, :] + hop * np.arange(n)[:, None]
    power = np.abs(np.fft.rfft(samples[at] * np.hamming(size))) ** 2
    hz = np.fft.rfftfreq(size, 1 / rate)
    use = (hz >= 28) & (hz <= 3520)
    pitch = np.round(12 * np.log2(hz[use] / 440)).astype(int) % PITCHES
    out = np.zeros((n, PITCHES))
    np.add.at(out.T, pitch, power[:, use].T)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def frames_of_vector(vector: np.ndarray) -> np.ndarray:
    """Pitch-class frames of a vector (or of rows of vectors) read as a score: frame t holds the next 12 components' strengths, unit length."""
    if vector.shape[-1] < PITCHES:
        return np.zeros((*vector.shape[:-1], 0, PITCHES))
    v = np.abs(np.lib.stride_tricks.sliding_window_view(np.nan_to_num(vector), PITCHES, axis=-1)).astype(float)
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def fingerprints(rows: DataFrame, *, rec_id: str, media: str, pcm: bool = False) -> DataFrame:
    """(rec_id, codes) of a media column: 16-bit mono samples as binary (pcm), or arrays of numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, by_size = [[]] * b.num_rows, {}
            for i, x in enumerate(b.column(1).to_pylist()):
                if x is not None and pcm:
                    out[i] = codes(frames_of_pcm(np.frombuffer(x, "<i2") / 32768)).tolist()
                elif x is not None:
                    by_size.setdefault(len(x), []).append((i, x))
            for same in by_size.values():
                for at in range(0, len(same), 100):
                    some = same[at : at + 100]
                    for (i, _), c in zip(some, codes(frames_of_vector(np.array([x for _, x in some], float))).tolist()):
                        out[i] = c
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["rec_id", "codes"])

    kind = rows.schema[rec_id].dataType.simpleString()
    return rows.select(F.col(rec_id).alias("rec_id"), F.col(media).alias("media")).mapInArrow(each, f"rec_id {kind}, codes array<bigint>")


def _votes(reps: DataFrame, p: str) -> DataFrame:
    """A row for each pair of places and mask: the bytes kept of both, and in the bytes left out the mask and the distance."""
    places = reps.select(F.col("class_id").alias(f"{p}_id"), "codes", F.posexplode("codes").alias(f"{p}_at", "code"))
    places = places.select(f"{p}_id", f"{p}_at", "code", *[F.get("codes", F.col(f"{p}_at") + d).alias(f"_{d}") for d in APART])
    keys = []
    for k, mask in enumerate(MASKS):
        for i, d in enumerate(APART):
            early = F.col("code").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(k << 8 * k))
            late = F.col(f"_{d}").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(i << 8 * k))
            keys.append(F.shiftleft(early, 32).bitwiseOR(late))
    return places.select(f"{p}_id", f"{p}_at", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def _dealt(asked: DataFrame, held: DataFrame, reps: DataFrame) -> DataFrame:
    """The join of two large sides, with a frequent key's held rows dealt to several tasks."""
    n = reps.agg(F.sum(F.size("codes"))).first()[0] or 0
    chunk = max(2000, int(len(MASKS) * len(APART) * n * OFTEN))
    hot = held.groupBy("key").count().where(F.col("count") > chunk)
    hot = written(hot.select("key", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "chroma-hot")  # fewer than 1 / OFTEN rows
    hot, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    asked = asked.join(hot, "key", "left").select("q_id", "q_at", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    held = held.join(hot, "key", "left").select("m_id", "m_at", "key", F.pmod(F.xxhash64("m_id", "m_at"), parts).cast("int").alias("part"))
    return asked.join(held, ["key", "part"])


def match(prints: DataFrame, is_query: str, *, max_ber=MAX_BER, min_overlap=MIN_OVERLAP, min_votes=MIN_VOTES) -> DataFrame:
    """Rows of two kinds. member: every recording (rec_id) with its class_id. match: a class that holds a query with
    another class (other_id), their offset in frames, its votes, overlap and share of differing bits (ber).

    is_query: SQL on rec_id that is true for the recordings to search with.
    """
    prints = written(prints.withColumn("key", F.xxhash64("codes")), "chroma-prints")
    classes = prints.groupBy("key").agg(F.min("rec_id").alias("class_id"), F.max(F.expr(f"coalesce({is_query}, false)")).alias("asks"), F.count(F.lit(1)).alias("n"))
    reps = prints.join(classes.select(F.col("key").alias("_k"), "class_id", "asks"), F.expr("key = _k and rec_id = class_id")).dropDuplicates(["class_id"])
    tasks = min(20_000, max(1, math.ceil(prints.count() / TASK_ROWS)))
    reps = written(reps.select("class_id", "asks", "codes").repartition(tasks, "class_id"), "chroma-classes")
    asked, held = written(_votes(reps.where("asks"), "q"), "chroma-asked"), _votes(reps, "m")
    if asked.count() <= util.BROADCAST_ROWS:
        hits = held.join(F.broadcast(asked), "key")
    else:
        hits = _dealt(asked, held, reps)
    hits = hits.where("q_id <> m_id")
    best = hits.groupBy("q_id", "m_id", F.expr("m_at - q_at").alias("offset")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= min_votes)
    q = reps.select(F.col("class_id").alias("q_id"), F.col("codes").alias("q"))
    m = reps.select(F.col("class_id").alias("m_id"), F.col("codes").alias("m"))
    pairs = best.join(q, "q_id").join(m, "m_id")
    # the stretch of q that lies over m
    pairs = pairs.withColumn("from", F.greatest(F.lit(0), -F.col("offset"))).withColumn("overlap", F.least(F.size("q"), F.size("m") - F.col("offset")) - F.col("from"))
    bits = F.expr("aggregate(zip_with(slice(q, `from` + 1, greatest(overlap, 0)), slice(m, `from` + offset + 1, greatest(overlap, 0)), (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)")
    pairs = pairs.withColumn("ber", bits / (32.0 * F.greatest(F.col("overlap"), F.lit(1)))).where((F.col("overlap") >= min_overlap) & (F.col("ber") <= max_ber))
    rank = F.struct(-F.col("ber"), "overlap", -F.abs("offset"), -F.col("offset"))
    pairs = pairs.groupBy("q_id", "m_id").agg(F.max_by(F.struct("offset", "votes", "overlap", "ber"), rank).alias("x")).select("q_id", "m_id", "x.*")
    found = pairs.select(
        F.lit("match").alias("kind"), F.lit(None).cast(prints.schema["rec_id"].dataType).alias("rec_id"), F.col("q_id").alias("class_id"), F.col("m_id").alias("other_id"),
        F.col("offset").cast("long"), "votes", F.col("overlap").cast("long"), "ber",
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("offset", "long"), ("votes", "long"), ("overlap", "long"), ("ber", "double"))]
    c = classes.select(F.col("key").alias("_k"), "class_id")
    members = prints.join(c, prints["key"] == c["_k"]).select(F.lit("member").alias("kind"), "rec_id", "class_id", F.lit(None).cast(prints.schema["rec_id"].dataType).alias("other_id"), *none)
    return members.unionByName(found)
