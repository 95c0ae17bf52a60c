"""A full-text index in segments: postings bucketed by term, later segments that supersede documents, merges.

    <path>/postings/segment=<s>/bucket=<b>   (term, block, ns, dls, tfs): a term's postings in a block of documents, as lists
    <path>/postings/segment=<s>/bucket=-1    the same of no term: the documents of each block
    <path>/docs/segment=<s>                  (n, dl), a null dl for a deleted document
    <path>/commits/segment=<s>               (n_docs, length: what the segment adds to the corpus, whole: it replaces all before)

A batch of upserts and deletes writes a segment and then its commit, so readers see all of it or nothing, and a batch that
is tried again under its number overwrites what the failed try left. A posting counts unless a later segment names its
document. Only documents of later segments are read for that, not the first one's. A search reads its terms' buckets.

A batch's documents are read once: a task writes the blocks of its documents where it counts them. A merge takes apart the
blocks that hold a document which a later segment names, and moves the others whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import held, small

BUCKETS = 32

#: Words of a block's documents; a longer document is a block of its own. And the bucket of rows that are of no term.
BLOCK_WORDS, NO_TERM = 1_000_000, -1


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def term_counts(words: DataFrame) -> DataFrame:
    """(n, dl, term, tf) of documents (n, words). Terms are counted where the document is: no shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):  # a document's terms are no more than its words; some hundred documents at once
                some = b.slice(at, 200)
                counts = [Counter(w) for w in some.column(1).to_pylist()]
                of = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
                dl = np.array([c.total() for c in counts], np.int32)[of]
                terms, tf = pa.array([t for c in counts for t in c], pa.string()), pa.array([k for c in counts for k in c.values()], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), pa.array(dl), terms, tf], ["n", "dl", "term", "tf"])

    kind = words.schema["n"].dataType.simpleString()
    return words.where(F.size("words") > 0).select("n", "words").mapInArrow(each, f"n {kind}, dl int, term string, tf int")


def term_blocks(words: DataFrame) -> DataFrame:
    """(term, block, ns, dls, tfs) of documents (n, words): the postings of each block by term, and of no term all its documents."""

    def blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dls = pc.list_value_length(b.column(1)).cast(pa.int32())
        of = np.cumsum(dls.fill_null(0).to_numpy()) // BLOCK_WORDS
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:]):
            if i < j:
                yield block(b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), dls.slice(i, j - i))

    def block(ns: pa.Array, lists: pa.Array, dls: pa.Array) -> pa.RecordBatch:
        found = lists.flatten().dictionary_encode()
        key = found.indices.to_numpy().astype(np.int64) * len(ns) + pc.list_parent_indices(lists).to_numpy()
        key, tf = np.unique(key, return_counts=True)  # by term, then by document
        first = np.searchsorted(key, np.arange(len(found.dictionary)) * len(ns))
        at = pa.array(np.r_[np.arange(len(ns)), key % len(ns)])  # the row of no term comes first
        tf = np.r_[np.zeros(len(ns), np.int64), tf].astype(np.int32)
        ends = pa.array(np.r_[0, len(ns) + first, len(at)].astype(np.int32))
        names = pa.concat_arrays([pa.nulls(1, pa.string()), found.dictionary.cast(pa.string())])
        block = pa.array(np.full(len(names), uuid4().int >> 65))
        packed = [pa.ListArray.from_arrays(ends, x) for x in (ns.take(at), dls.take(at), pa.array(tf))]
        return pa.RecordBatch.from_arrays([names, block, *packed], ["term", "block", "ns", "dls", "tfs"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from blocks(b)

    kind = words.schema["n"].dataType.simpleString()
    return words.select("n", "words").mapInArrow(each, f"term string, block long, ns array<{kind}>, dls array<int>, tfs array<int>")


def _spelled(rows: DataFrame) -> DataFrame:
    """Rows of blocks with a row for each posting: n, dl and tf in place of the lists."""
    rest = [c for c in rows.columns if c not in ("ns", "dls", "tfs")]
    each = rows.select(*rest, F.explode(F.arrays_zip("ns", "dls", "tfs")).alias("p"))
    return each.select(*rest, F.col("p.ns").alias("n"), F.col("p.dls").alias("dl"), F.col("p.tfs").alias("tf"))


def _named_last(rows: DataFrame, later: DataFrame) -> DataFrame:
    """Rows (n, segment) whose document no segment after theirs names."""
    return rows.join(later, "n", "left").where(F.col("last").isNull() | (F.col("last") <= F.col("segment"))).drop("last")


class SegmentedIndex:
    """An index at `path`. Documents come as (n, words)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _commits(self) -> list:
        """Committed segments from the last whole one on; as many as there are batches since a merge."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return []
        rows = self.spark.read.parquet(f"{self.path}/commits").orderBy("segment").collect()
        start = max(i for i, r in enumerate(rows) if r.whole)
        return rows[start:]

    def _docs(self, commits: list) -> DataFrame:
        """(n, segment, dl): each document as its last segment has it."""
        own = self.spark.read.parquet(f"{self.path}/docs").where(F.col("segment").isin(*[c.segment for c in commits]))
        return own.groupBy("n").agg(F.max_by("dl", "segment").alias("dl"), F.max("segment").alias("segment"))

    def _write_postings(self, segment: int, blocks: DataFrame) -> None:
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")

    def _bucketed(self, blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("bucket", F.when(F.col("term").isNull(), NO_TERM).otherwise(_bucket("term", self.buckets)))

    def _write_docs(self, segment: int, docs: DataFrame) -> DataFrame:
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/segment={segment}")
        return self.spark.read.schema(docs.schema).parquet(f"{self.path}/docs/segment={segment}")

    def _commit(self, segment: int, n_docs: int, length: int, whole: bool) -> None:
        self.spark.createDataFrame([(n_docs, length, whole)], "n_docs long, length long, whole boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/segment={segment}")

    def apply(self, documents: DataFrame, deleted: DataFrame | None = None, batch: int | None = None) -> int:
        """Write documents (n, words), which replace those of the same n, and drop `deleted` (n). Returns the segment's number.

        batch: a number for the batch, larger than earlier ones; a batch that was committed under it is not applied again.
        """
        commits = self._commits()
        segment = batch if batch is not None else commits[-1].segment + 1 if commits else 0
        if commits and segment <= commits[-1].segment:
            return segment
        self._write_postings(segment, self._bucketed(term_blocks(documents)))
        docs = _spelled(self._rows([segment]).where(F.col("bucket") == NO_TERM)).select("n", F.col("dl").cast("long").alias("dl"))
        if deleted is not None:
            docs = docs.unionByName(deleted.select("n").distinct().join(docs.select("n"), "n", "left_anti").select("n", F.lit(None).cast("long").alias("dl")))
        docs = self._write_docs(segment, docs)
        new = docs.agg(F.count("dl").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        n_docs, length = new.n, new.length
        if commits:  # what the batch takes out of the corpus: its documents as they were
            old = self._docs(commits).join(docs.select("n"), "n", "left_semi").agg(F.count("dl").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            n_docs, length = n_docs - old.n, length - old.length
        self._commit(segment, n_docs, length, not commits)
        return segment

    def merge(self) -> int:
        """Write all that is live as one segment, which replaces all before it."""
        commits = self._commits()
        segment = commits[-1].segment + 1
        rows, numbers = self._rows([c.segment for c in commits]), [c.segment for c in commits]
        if len(numbers) > 1:
            later = held(self._later(numbers), "later")
            members = _spelled(rows.where(F.col("bucket") == NO_TERM).select("segment", "block", "ns", "dls", "tfs"))
            torn = small(held(members.join(small(later), "n").where("last > segment").select("segment", "block").distinct(), "torn-blocks"))
            whole = rows.join(torn, ["segment", "block"], "left_anti")
            left = _named_last(_spelled(rows.join(torn, ["segment", "block"])), small(later))
            lists = left.groupBy("segment", "bucket", "term", "block").agg(F.collect_list(F.struct("n", "dl", "tf")).alias("p"))
            rows = whole.unionByName(lists.select("segment", "bucket", "term", "block", F.col("p.n").alias("ns"), F.col("p.dl").alias("dls"), F.col("p.tf").alias("tfs")), allowMissingColumns=True)
        self._write_postings(segment, rows.drop("segment"))  # where they are read: whole blocks are not shuffled
        self._write_docs(segment, self._docs(commits).where("dl is not null").select("n", "dl"))
        self._commit(segment, sum(c.n_docs for c in commits), sum(c.length for c in commits), True)
        return segment

    def _rows(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("segment").isin(*numbers))

    def _later(self, numbers: list[int]) -> DataFrame:
        """(n, last): the documents that segments after the first name, and the last one that does."""
        docs = self.spark.read.parquet(f"{self.path}/docs").where(F.col("segment").isin(*numbers[1:]))
        return docs.groupBy("n").agg(F.max("segment").alias("last"))

    def _live(self, terms: list[str], commits: list) -> DataFrame:
        """(segment, bucket, term, block, n, dl, tf) of terms, but for postings that a later segment names."""
        numbers = [c.segment for c in commits]
        of = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket("term", self.buckets)).distinct().collect()
        rows = _spelled(self._rows(numbers).where(F.col("bucket").isin(*[r[0] for r in of]) & F.col("term").isin(*terms)))
        return rows if len(numbers) == 1 else _named_last(rows, self._later(numbers))

    def postings(self, terms: list[str]) -> DataFrame:
        """(n, dl, term, tf) of a search's terms, in live documents. Reads only those terms' buckets."""
        return self._live(terms, self._commits()).select("n", "dl", "term", "tf")

    def size(self) -> tuple[int, float]:
        """(documents, their mean length), from the commits alone."""
        commits = self._commits()
        n = sum(c.n_docs for c in commits)
        return n, sum(c.length for c in commits) / n if n else 0.0
