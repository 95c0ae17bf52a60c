"""The pipeline's stages chained by hand on the smallest tables; near duplicates against all pairs."""

from collections import Counter

import corpus_pipeline

from test_similar import _kept

from quillstore.llm import mixing, quality_lm

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, sizes = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        sizes.append(after.count())
        if name == "quality_classifier":
            good = {r.doc_id for r in quality_lm.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).where("accepted").collect()}
            assert {r.doc_id for r in after.collect()} == good
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in after.collect()) == _kept([(r.doc_id, r.text) for r in before.collect()])
        if name == "pii":
            assert sizes[-1] == sizes[-2]
        if name == "mixing":
            plan = {r.doc_id: r.taken for r in mixing.plan_mix(before).collect()}
            words = Counter()
            for r in after.collect():
                words[r.doc_id] += len(r.text.split())
            assert all(words[k] == v for k, v in plan.items())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    starts = Counter((p.doc_id) for p in pieces if p.start == 0)
    assert starts == Counter(r.doc_id for r in before.collect())
    assert docs.count() > sizes[0] > sizes[1] == sizes[2]


def test_run_is_the_chain(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
