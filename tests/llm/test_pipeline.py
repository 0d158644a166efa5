import numpy as np
import xxhash

import corpus_pipeline
from strandflow.llm import langid, quality_rules

SF = "/root/testdata/sf0.001"


def plain_groups(texts):
    """The smallest id of each component by brute force: four bits of op10's fingerprint, or five-word sets that agree by 0.8."""
    sets, bits = {}, {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = np.array([xxhash.xxh64_intdigest(x, seed=42) for x in shingles], np.uint64)
        bits[i] = sum(int(2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes)) << b for b in range(64))
    group = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            both = sets[i] | sets[j]
            if j < i and group[i] != group[j] and ((bits[i] ^ bits[j]).bit_count() <= 4 or both and len(sets[i] & sets[j]) >= 0.8 * len(both)):
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()}
    return set(group.values())


def test_stages(spark, documents, labels):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.count() == len(kept[name])
    original = {r.doc_id: tuple(r) for r in documents.collect()}
    assert all(tuple(r) == original[r.doc_id] for r in docs.collect())
    # Each stage against the operator's own verdicts on what came before.
    model = langid.learn(documents.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2"))
    assert kept["language_id"] == {r.doc_id for r in langid.detect(documents, model).collect() if r.lang_pred != "und" and r.score >= 0.3}
    assert kept["quality_rules"] < kept["language_id"]
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    base = {r.doc_id for r in quality_rules.judged(documents, None).where("kept").collect()}
    assert len((good & base & kept["language_id"]) - kept["quality_rules"]) <= 0.02 * len(good)
    assert kept["simhash_near_duplicates"] == plain_groups({i: original[i][1] for i in kept["quality_rules"]})
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept["simhash_near_duplicates"]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()
