"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text, and perplexity limits by language.

Words (A-Z lower-cased) are the VOCABULARY most frequent ones of the trusted text that occur there twice or more; others
are classes by their shape, and a class word is also spelled, by a Kneser-Ney model of LETTERS letter classes, trigrams,
of the words without a number of their own. A bigram is two 16-bit numbers, so the statistics of histories and of
continuations are arrays of a proven size, which the driver holds and broadcasts, as is the table of letter trigrams. The
bigrams' counts grow with the corpus. They never leave their shards: grid x grid of them, by history and by word, so that
a frequent history is spread over grid shards. The grid grows with the trusted text, a shard for SHARD_WORDS words of it.

  - counting: tasks count their trusted texts' bigrams, pack them by shard, and a shard adds up what it gets;
  - scoring: a text's bigrams are packed by shard, each distinct one of a document once with its number, and meet the
    shard's counts. The shard returns one sum for each document. What backing off gives is added where the text is.

Packed are sorted numbers' differences in byte planes, compressed: some four bytes a word instead of a row.

A model finds the texts it was trained on likelier than others like them. So one trusted text in HELD, by its hash, is
held out of the training, and limits come from those: a document's perplexity is drawn towards the mean of its language's
by PRIOR words, as very short texts say little, and is accepted up to their quantile QUANTILE, times SLACK. Languages
without a held-out document, or none named, use the quantile over all.

Null or empty text: perplexity null, rejected. Nothing held out: everything with text is accepted. Very long texts count
and are scored whole. Words that tie for the vocabulary's last places: the least by bytes. Repeated label rows count
once; a document is trusted if any of its rows says so. Repeated rows of documents count and are scored each. Input
columns of any name are left alone. Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import small, written

SYMBOLS, CLASSES, BLOCK_WORDS = 1 << 16, 256, 500_000
SHARD_WORDS, GRIDS = 1 << 18, (8, 256)  # words of trusted text for a shard, and the least and greatest grid
VOCABULARY = SYMBOLS - CLASSES
START = 0  # no word has this class: it stands before the first word
QUANTILE, SLACK, PRIOR, HELD, SEED = 0.995, 1.25, 20, 10, 11
LETTERS = 38  # 0 between words, 1 to 26 letters, 27 digits, 28 to 35 other bytes, 36 sentence marks, 37 other marks

_DIGITS, _ASCII = b"0123456789", bytes(range(97, 123))
_HIGH = bytes(range(128, 256))
_LETTER = np.array([0 if i == 10 else i - 96 if 97 <= i < 123 else 27 if 48 <= i < 58 else 28 + i % 8 if i > 127 else 36 if chr(i) in ".,;:!?'\"()-" else 37 for i in range(256)])


def shape(word: bytes) -> int:
    """The class of a word: its length up to 15, and whether it has digits, marks, other letters, a byte three times running."""
    out = min(len(word), 15)
    if word.isalpha():
        return out
    rest = word.translate(None, _ASCII)
    marks = rest.translate(None, _DIGITS + _HIGH)
    thrice = any(word[i] == word[i - 1] == word[i - 2] for i in range(2, min(len(word), 64)))
    return out | (len(rest) - len(rest.translate(None, _DIGITS)) > 0) << 4 | bool(marks) << 5 | (not word.isascii()) << 6 | thrice << 7


class Vocabulary(dict):
    """Numbers of words; a word that is none of them has its class's."""

    def __missing__(self, word: bytes) -> int:
        return shape(word)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only


def trigrams(words: list[bytes]) -> np.ndarray:
    """Numbers of the words' letter trigrams, one for each letter and the end of each word."""
    s = _LETTER[np.frombuffer(b"\n\n" + b"\n\n".join(words) + b"\n", np.uint8)]
    codes = (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]
    return codes[(s[1:-1] > 0) | (s[2:] > 0)]


def bigrams(numbers: np.ndarray) -> np.ndarray:
    """history * SYMBOLS + word, one for each word."""
    return np.concatenate([[START], numbers[:-1]])[: len(numbers)] * SYMBOLS + numbers


def grid_for(words: int) -> int:
    """A power of two, so that grid x grid shards have some SHARD_WORDS words each."""
    grid, most = GRIDS
    while grid < most and grid * grid * SHARD_WORDS < words:
        grid *= 2
    return grid


def _split(grams: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, number within the shard) of bigrams."""
    h, w = grams // SYMBOLS, grams % SYMBOLS
    return h % grid * grid + w % grid, h // grid * (SYMBOLS // grid) + w // grid


def _joined(shard: int, inner: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """(history, word) of numbers within a shard."""
    n = SYMBOLS // grid
    return inner // n * grid + shard // grid, inner % n * grid + shard % grid


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = pa.Codec("zstd").decompress(raw[4:], 4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[x.split() for x in schema.split(", ")])
    c = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(c, types)], names)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of a column of texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0):
                for w in words_of(t.as_py()):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > 300_000:
                yield out()
                seen.clear()
        yield out()

    return texts.mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shards(table: DataFrame, grid: int, *order: str) -> DataFrame:
    n = max(grid * grid, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return table.repartition(n, "shard").sortWithinPartitions("shard", *order)


COUNTS = "shard int, grams binary, counts binary, histories binary, continuations binary, kinds binary"


def count_bigrams(texts: DataFrame, vocabulary, grid: int) -> DataFrame:
    """A row for each shard: its bigrams in order with their counts, and its part of the statistics."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held = vocabulary.value, []

        def out():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            shard, inner = _split(grams, grid)
            order = np.lexsort((inner, shard))
            at = np.searchsorted(shard[order], np.arange(grid * grid + 1))
            parts = [(k, order[at[k] : at[k + 1]]) for k in range(grid * grid)]
            return _rows("shard int, grams binary, counts binary", [(k, _packed(np.diff(inner[i], prepend=0)), _packed(n[i])) for k, i in parts if len(i)])

        for b in batches:
            for t in b.column(0):
                held.append(bigrams(v.numbers(words_of(t.as_py()))))
                if len(held) % 1000 == 0 and sum(map(len, held)) > 4 * BLOCK_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams, counts = None, [], []

        def out():
            g, n = _sums(np.concatenate(grams), np.concatenate(counts))
            h, w = (x // grid for x in _joined(now, g, grid))
            size, few = SYMBOLS // grid, [np.bincount(h[n == k] if k < 3 else h[n >= 3], minlength=SYMBOLS // grid) for k in (1, 2, 3)]
            histories = np.stack([np.bincount(h, weights=n, minlength=size), *few]).astype("<i8").tobytes()
            kinds = np.array([(n == k).sum() for k in (1, 2, 3, 4)], "<i8").tobytes()
            return _rows(COUNTS, [(now, _packed(np.diff(g, prepend=0)), _packed(n), histories, np.bincount(w, minlength=size).astype("<i8").tobytes(), kinds)])

        for b in batches:
            for shard, g, n in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now and grams:
                    yield out()
                    grams, counts = [], []
                now = shard
                grams.append(np.cumsum(_unpacked(g)))
                counts.append(_unpacked(n))
                if len(grams) > 64:  # what has come so far is added up
                    grams, counts = ([x] for x in _sums(np.concatenate(grams), np.concatenate(counts)))
        if grams:
            yield out()

    return _shards(texts.mapInArrow(each, "shard int, grams binary, counts binary"), grid).mapInArrow(added, COUNTS)


def _added_up(rows: DataFrame) -> list:
    """(k, v) with the arrays v (longs, as binary) of each k of rows (k, v) added up."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(*(c.to_pylist() for c in b.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, "<i8")
        yield _rows("k int, v binary", [(k, v.astype("<i8").tobytes()) for k, v in sums.items()])

    return [(r["k"], np.frombuffer(r["v"], "<i8")) for r in rows.repartition("k").mapInArrow(each, "k int, v binary").collect()]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of 0, 1, 2 and more, at least a tenth."""
    n = [max(1, int(x)) for x in (n1, n2, n3, n4)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) for k in (1, 2, 3))])


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the last letter given those before, for a dense array of counts."""
    p, orders = np.full(counts.shape[-1], 1.0 / counts.shape[-1]), [counts]
    while orders[-1].ndim > 1:  # continuation counts: how many letters come before
        orders.append((orders[-1] > 0).sum(axis=0))
    for c in reversed(orders):
        off = discounts(*[(c == k).sum() for k in (1, 2, 3, 4)])[np.minimum(c, 3)]
        total = c.sum(axis=-1, keepdims=True)
        with np.errstate(all="ignore"):
            p = np.where(total > 0, (c - off) / total + off.sum(axis=-1, keepdims=True) / total * p, p)
    return p


class Model:
    """All of the model but the bigrams' counts: arrays of a size that is known beforehand."""

    def __init__(self, grid: int, histories_: list, continuations_: list, kinds: np.ndarray, letters: np.ndarray):
        self.grid = grid
        histories, continuations = np.zeros((4, SYMBOLS)), np.zeros(SYMBOLS, np.int64)
        for a, v in histories_:
            histories[:, a::grid] = v.reshape(4, -1)
        for b, v in continuations_:
            continuations[b::grid] = v
        self.total = histories[0]
        self.off = discounts(*kinds)
        with np.errstate(all="ignore"):
            spare = np.where(self.total > 0, self.off[1:] @ histories[1:] / self.total, 1.0)
        self.log_spare, self.log_word = np.log(spare), np.log(kneser_ney(continuations))
        self.log_letter = np.log(kneser_ney(letters.reshape((LETTERS,) * 3))).ravel()

    def backed_off(self, numbers: np.ndarray, words: list[bytes]) -> float:
        """The log probability of a text if no bigram of it had been counted."""
        before = np.concatenate([[START], numbers[:-1]])[: len(numbers)]
        spelled = [words[i] for i in np.flatnonzero(numbers < CLASSES).tolist()]
        return float((self.log_spare[before] + self.log_word[numbers]).sum() + (self.log_letter[trigrams(spelled)].sum() if spelled else 0.0))

    def gains(self, h: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a bigram's count n > 0 adds to that."""
        return np.log1p((n - self.off[np.minimum(n, 3)]) / self.total[h] * np.exp(-self.log_spare[h] - self.log_word[w]))


def train(trusted: DataFrame, text: str = "text"):
    """(model, vocabulary, counts): the first two are broadcast, the third is a table of the shards."""
    context = trusted.sparkSession.sparkContext
    texts = trusted.select(F.col(text).alias("text"))
    words = written(count_words(texts), "lm-words")
    top = words.where("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()  # bounded by VOCABULARY
    vocabulary = context.broadcast(Vocabulary({bytes(r["word"]): CLASSES + i for i, r in enumerate(top)}))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = np.zeros(LETTERS**3, np.int64), vocabulary.value
        for b in batches:
            if rest := [w for w in b.column(0).to_pylist() if w not in known]:
                n += np.bincount(trigrams(rest), minlength=len(n))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["gram", "n"])

    found = words.select("word").mapInArrow(spelled, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most LETTERS ** 3
    letters = np.zeros(LETTERS**3, np.int64)
    letters[[r["gram"] for r in found]] = [r["n"] for r in found]
    grid = grid_for(words.agg(F.sum("n")).first()[0] or 0)
    counts = written(count_bigrams(texts, vocabulary, grid), "lm-counts")
    part = lambda k, v: _added_up(counts.select(k.cast("int").alias("k"), F.col(v).alias("v")))  # noqa: E731  SYMBOLS numbers or so, whatever the grid
    kinds = sum((v for _, v in part(F.lit(0), "kinds")), np.zeros(4, np.int64))
    model = Model(grid, part(F.expr(f"shard div {grid}"), "histories"), part(F.col("shard") % grid, "continuations"), kinds, letters)
    return context.broadcast(model), vocabulary, counts.select("shard", "grams", "counts")


def score(docs: DataFrame, model, vocabulary, counts: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, log_prob) of every document."""
    grid = model.value.grid
    asked_of = "shard int, kind int, block long, grams binary, docs binary, counts binary"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of documents, its bigrams by shard (kind 1), and what is known of the documents (kind 2)."""
        v, m, block = vocabulary.value, model.value, TaskContext.get().partitionId() << 32
        for b in batches:
            texts, at = b.column(2), 0
            while at < b.num_rows:
                numbers, base, total = [], [], 0
                while at + len(numbers) < b.num_rows and total < BLOCK_WORDS and len(numbers) < 65_536:
                    words = words_of(texts[at + len(numbers)].as_py())
                    numbers.append(v.numbers(words))
                    base.append(m.backed_off(numbers[-1], words))
                    total += len(words)
                size = [len(x) for x in numbers]
                shard, inner = _split(np.concatenate([bigrams(x) for x in numbers]), grid)
                key, n = np.unique((shard << 42) + (inner << 16) + np.repeat(np.arange(len(size)), size), return_counts=True)
                cut = np.searchsorted(key >> 42, np.arange(grid * grid + 1))
                rows = []
                for k in range(grid * grid):
                    own = key[cut[k] : cut[k + 1]] - (k << 42)
                    if len(own):
                        rows.append((k, 1, block, _packed(np.diff(own >> 16, prepend=0)), _packed(own & 0xFFFF), _packed(n[cut[k] : cut[k + 1]])))
                known = [*(x.slice(at, len(size)) for x in b.columns[:2]), pa.array(size, pa.int64()), pa.array(base, pa.float64())]
                known = pa.RecordBatch.from_arrays(known, ["doc_id", "lang", "n_words", "log_prob"])
                with pa.ipc.new_stream(sink := pa.BufferOutputStream(), known.schema) as w:
                    w.write_batch(known)
                rows.append((-1 - block % 1021, 2, block, sink.getvalue().to_pybytes(), None, None))
                yield _rows(asked_of, rows)
                at += len(size)
                block += 1

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shard's counts come first (kind 0), then the blocks' bigrams."""
        m, now, have, n = model.value, None, None, None
        for b in batches:
            rows = []
            for shard, kind, block, grams, docs_, counts_ in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 2:
                    rows.append((block, kind, shard, grams))
                elif kind == 0:
                    now, have, n = shard, np.cumsum(_unpacked(grams)), _unpacked(counts_)
                elif shard == now:
                    g = np.cumsum(_unpacked(grams))
                    at = np.minimum(np.searchsorted(have, g), len(have) - 1)
                    hit = np.flatnonzero(have[at] == g)
                    gain = m.gains(*_joined(shard, g[hit], grid), n[at[hit]]) * _unpacked(counts_)[hit]
                    rows.append((block, kind, shard, np.bincount(_unpacked(docs_)[hit], weights=gain).astype("<f4").tobytes()))
            yield _rows("block long, kind int, shard int, data binary", rows)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's documents come first, then the shards' sums."""
        known = total = None

        def out():
            return pa.RecordBatch.from_arrays([*known.columns[:3], pa.array(known.column(3).to_numpy() + total)], known.schema.names)

        for b in batches:
            for _, kind, _, data in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 2:
                    if known is not None:
                        yield out()
                    known = pa.ipc.open_stream(data).read_next_batch()
                    total = np.zeros(known.num_rows)
                else:
                    gain = np.frombuffer(data, "<f4")
                    total[: len(gain)] += gain
        if known is not None:
            yield out()

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    none = F.lit(None).cast("binary")
    counted = counts.select("shard", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "grams", none.alias("docs"), "counts")
    sums = _shards(counted.unionByName(rows.mapInArrow(asked, asked_of)), grid, "kind", "block").mapInArrow(met, "block long, kind int, shard int, data binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = sums.repartition(n, "block").sortWithinPartitions("block", F.desc("kind"), "shard")
    return blocks.mapInArrow(summed, f"doc_id {kind}, lang string, n_words long, log_prob double")


def classify(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", lang="lang", quantile=QUANTILE, slack=SLACK, prior=PRIOR) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, accepted) for every row of docs.

    labels: (doc_id, quality); quality 1 is trusted.
    """
    trusted = small(written(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct(), "lm-trusted"))
    held_out = F.pmod(F.xxhash64(F.lit(SEED), docs[text]), F.lit(HELD)) == 0  # copies of a text go the same way
    chosen = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), held_out.alias("held")).join(trusted, F.col("doc_id") == trusted["_id"], "left_semi")
    held = small(written(chosen.where("held").select(F.col("doc_id").alias("_held")).distinct(), "lm-held"))
    scores = written(score(docs, *train(chosen.where("not held")), doc_id=doc_id, text=text, lang=lang), "lm-scores")
    marked = scores.join(held, scores["doc_id"] == held["_held"], "left_semi").where("n_words > 0")
    means = marked.where("lang is not null").groupBy("lang").agg((F.sum("log_prob") / F.sum("n_words")).alias("m"))
    all_ = marked.agg((F.sum("log_prob") / F.sum("n_words")).alias("mean")).first()["mean"]
    mean = float(all_) if all_ is not None else 0.0
    drawn = lambda m: F.when(F.col("n_words") > 0, F.exp(-(F.col("log_prob") + prior * m) / (F.col("n_words") + prior)))
    means = written(means.select(F.col("lang").alias("_lang"), F.col("m").alias("_mean")), "lm-means")
    with_mean = lambda rows: rows.join(small(means), rows["lang"] == means["_lang"], "left").withColumn("perplexity", drawn(F.coalesce("_mean", F.lit(mean))))
    own = with_mean(marked)
    limits = written(own.where("_lang is not null").groupBy("_lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("_limit")), "lm-limits")
    rest = own.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    limits = small(limits.withColumnRenamed("_lang", "_of"))
    judged = with_mean(scores).join(limits, F.col("_lang") == F.col("_of"), "left")
    threshold = F.coalesce(F.col("_limit"), F.lit(float(rest) if rest is not None else float("inf"))) * slack
    return judged.withColumn("threshold", threshold).select(
        "doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("accepted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", **options) -> DataFrame:
    """The rows of docs that are accepted. Rows under one doc_id are kept if any of them is."""
    found = classify(docs, labels, doc_id=doc_id, **options)
    good = small(written(found.where("accepted").select(F.col("doc_id").alias("_good")).distinct(), "lm-good"))
    return docs.join(good, docs[doc_id].eqNullSafe(good["_good"]), "left_semi")
