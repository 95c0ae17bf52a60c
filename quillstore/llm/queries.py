"""The queries of this package, each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, chroma, clustering, codebooks, decontam, license_scan, mixing, packing, pii, quality_lm, rules, simhash, substring
from .util import ship

#: The key of the pseudonyms. A deployment passes its own.
KEY = b"quillstore-demonstration-key"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    return chat_format.render(_table(spark, sf_dir, "conversations"))


def op3_quality_classifier(spark, sf_dir):
    return quality_lm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_mixing(spark, sf_dir):
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard")


def op6_chroma(spark, sf_dir):
    prints = chroma.fingerprints(_table(spark, sf_dir, "embeddings"), rec_id="vec_id", media="embedding")
    return chroma.match(prints, "rec_id % 100 = 0")


def op7_quality_rules(spark, sf_dir):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)


def op8_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, KEY, counts=True)


def op10_substring(spark, sf_dir):
    found = substring.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_decontamination(spark, sf_dir):
    found = decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_vector_codes(spark, sf_dir):
    found = codebooks.compress(_table(spark, sf_dir, "embeddings"))
    rows = codebooks.with_label_error(found.codes)
    return rows.select("vec_id", codebooks.hex_code("code").alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op13_centroids(spark, sf_dir):
    found = clustering.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_chat_format, op3_quality_classifier, op4_simhash, op5_mixing, op6_chroma, op7_quality_rules,
    op8_packing, op9_pii, op10_substring, op11_decontamination, op12_vector_codes, op13_centroids, pipeline,
)}

ORACLE_SQL = {"op1_license_scan": license_scan.oracle(), "op2_chat_format": chat_format.ORACLE, "op7_quality_rules": rules.ORACLE} | {
    "op11_decontamination": decontam.ORACLE, "op12_vector_codes": codebooks.ORACLE, "op13_centroids": clustering.ORACLE,
}
