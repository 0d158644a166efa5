import zlib

import numpy as np
from pyspark.sql import functions as F

from strandflow.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.op1_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_viterbi_equals_plain():
    rng = np.random.default_rng(0)
    for _ in range(100):
        counts = rng.integers(0, 40, 6)
        scores = rng.normal(size=(counts.sum(), 3)) * 2
        states, at = langid.viterbi(scores, counts, 2.0, 7), 0
        for n in counts:
            own, got = scores[at : at + n], states[at : at + n]
            at += n
            if n:
                best = own[0].copy()
                for row in own[1:]:
                    best = np.maximum(best, best.max() - 2.0) + row
                value = own[np.arange(n), got].sum() - 2.0 * (got[1:] != got[:-1]).sum()
                assert abs(value - best.max()) < 1e-9


def test_spans_scripts_and_odd_rows(spark, odd_docs, no_docs, documents):
    taught = spark.createDataFrame([(1000 + i, "και το σπίτι είναι εδώ με τον καιρό", "el") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.learn(documents.select("doc_id", "text", "lang").unionByName(taught))
    assert "el" in model["languages"]
    texts = {r.lang: r.text for r in documents.orderBy("doc_id").collect() if len(r.text) > 900}
    mixed = " ".join(texts["en"].split()[:60]) + " " + " ".join(texts["de"].split()[:60])
    found = langid.detect(spark.createDataFrame([(0, mixed), (1, "σπίτι και"), (2, "")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s.lang for s in found[0].spans] == ["en", "de"] and 50 <= found[0].spans[0].n_words <= 70
    assert found[1].lang_pred == "el" and found[1].score == 1.0
    out = langid.detect(odd_docs, model).collect()
    assert len(out) == odd_docs.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    for i in (2, 3, 4, 9):
        assert (by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, [])
    assert all(r.lang_pred in [*model["languages"], "und"] for r in out)
    assert langid.detect(no_docs, model).count() == 0
    kept = langid.detect(odd_docs, model, keep="lang_pred <> 'und'")
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 7").count() == 2 and kept.first().key == "clash"


def test_nothing_to_learn(no_docs, odd_docs):
    model = langid.learn(no_docs)
    assert model["languages"] == []
    assert {r.lang_pred for r in langid.detect(odd_docs, model).collect()} == {"und"}


def test_stage_rejects_what_was_not_learned(spark, documents):
    import corpus_pipeline

    strange = ["Съешь же ещё этих мягких французских булок да выпей чаю", "天地玄黄 宇宙洪荒 日月盈昃 辰宿列张", "xqzv kwjqx vvzkq qxwj zzkqv jxqk wqzxv kkvxj"]
    rows = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], documents.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, documents.unionByName(rows), "").select("doc_id").collect()}
    assert kept and not kept & {10**6 + i for i in range(len(strange))}
    without = documents.where("lang <> 'es'")
    kept = corpus_pipeline.language_id(spark, without.unionByName(documents.where("lang = 'es'").withColumn("lang", F.lit(None).cast("string"))), "")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in without.collect()}
