import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandflow.llm import labelled, quality_rules, queries, rule_ensemble

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    twice = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(twice)


def counts_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_rules_and_verdict(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op4_quality_rules(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        n, *_, repeats = want = plain_counts(docs[r.doc_id])
        assert counts_of(r) == want
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and r.kept == (not r.base_failed and r.probability >= 0.5)
    judged = [(r.kept, good[r.doc_id]) for r in out if r.doc_id in good and not r.base_failed]
    assert sum(k == bool(g) for k, g in judged) >= 0.97 * len(judged)


def test_rules_on_odd_rows(odd_docs, no_docs, labels):
    text = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    for given in (labels, labels.limit(0), labels.selectExpr("doc_id", "cast(null as int) quality")):
        found = quality_rules.judged(odd_docs, quality_rules.fit(odd_docs, given)).collect()
        assert len(found) == odd_docs.count()
        assert all(counts_of(r) == plain_counts(text[r.doc_id]) for r in found if r.doc_id is not None)
    kept = quality_rules.judged(odd_docs, None, only_kept=True)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "7", "8", "None"]
    assert quality_rules.judged(no_docs, None).count() == 0


def test_calibration():
    rng = np.random.default_rng(2)
    score = rng.normal(size=4000)
    label = (rng.random(4000) < labelled.sigmoid(2 * score - 1)).astype(float)
    a, b = labelled.platt(score, label)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.2


def test_calibration_of_scores_far_apart():
    rng = np.random.default_rng(3)
    label = (rng.random(2000) < 0.8).astype(float)
    a, b = labelled.platt(np.where(label > 0, 200.0, -200.0) + rng.normal(size=2000), label)
    assert 0 < a < 1 and labelled.sigmoid(np.array([200 * a + b]))[0] > 0.99 and labelled.sigmoid(np.array([-200 * a + b]))[0] < 0.01
    for rounds in (20, 21, 99, 100):
        assert np.allclose(labelled.platt(np.where(label > 0, 200.0, -200.0), label, rounds), labelled.platt(np.where(label > 0, 200.0, -200.0), label, 400), rtol=0.05)
    # Scores that point the wrong way give everyone the share.
    a, b = labelled.platt(-label, label)
    assert a == 0 and abs(labelled.sigmoid(np.array([b]))[0] - label.mean()) < 0.01


def test_probability_equals_plain(documents, labels):
    from xxhash import xxh64_intdigest

    model = quality_rules.fit(documents, labels)
    one = lambda x: np.array([x], np.uint64)
    mix = lambda a, b: int(quality_rules.mix(one(a), one(b))[0])

    def plain(text):
        words = [w.encode() for w in WORD.findall(text or "")]
        features = Counter()
        hashes = [xxh64_intdigest(w, 7) for w in words]
        for w, h in zip(words, hashes):
            features[h % quality_rules.FEATURES] += 1
            marked = b"\x02" + w + b"\x03"
            for n in (2, 3):
                for i in range(len(marked) - n + 1):
                    features[mix(int.from_bytes(bytes([n]) + marked[i : i + n], "big"), n) % quality_rules.FEATURES] += 1
        for a, b in zip(hashes, hashes[1:]):
            features[0 if a == b else mix(a, b) % quality_rules.FEATURES] += 1
        z = sum(float(model["weights"][f]) * c for f, c in features.items()) / max(1, len(words)) + model["bias"]
        return 1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -40, 40)))

    some = documents.where("n_chars < 1500 or text is null")
    found = {r.doc_id: r.probability for r in quality_rules.judged(some, model).collect()}
    want = {r.doc_id: plain(r.text) for r in some.collect()}
    assert len(want) > 30 and all(abs(found[i] - p) < 1e-3 for i, p in want.items())


def test_fewer_rows_are_taken_whole_where_texts_are_long(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{k}" for k in rng.integers(0, 5000, 3000)), i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").cache()
    taken = []
    monkeypatch.setattr(quality_rules, "logistic", lambda row, columns, *a, f=quality_rules.logistic, **b: taken.append((a[1], len(np.unique(columns)))) or f(row, columns, *a, **b))
    for sample_bytes in (1 << 30, 400_000):
        model = quality_rules.fit(docs, docs, sample_bytes=sample_bytes)
        right = quality_rules.judged(docs, model).join(docs, "doc_id").agg(F.avg(((F.col("probability") > 0.5) == (F.col("quality") == 1)).cast("int"))).first()[0]
        assert right > 0.98
    # All rows, then about 15 of each label; of each all features (far more than a few thousand).
    assert taken[0][0] > 120 and 8 <= taken[1][0] <= 45 and taken[1][1] > 20_000


def test_ensemble_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op7_rule_ensemble(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out) and len(out) == 10_000
    held = [(r.score, r.predicted, good[r.doc_id]) for r in out if r.held_out and r.doc_id in good]
    ones, zeros = ([s for s, _, g in held if g == v] for v in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) >= 0.98
    assert np.mean([p == g for _, p, g in held]) >= 0.98


def test_expression_equals_the_ensemble(spark, documents, labels, odd_docs):
    ensemble = rule_ensemble.fit(documents, labels)
    assert 0 < len(ensemble.rules) < 200
    for docs in (documents, odd_docs):
        found = rule_ensemble.scored(docs, ensemble).collect()
        x = np.array([[r[c] for c in rule_ensemble.STATISTICS] for r in found])
        assert np.allclose([r.score for r in found], labelled.sigmoid(ensemble.margin(x)))


def test_ensemble_without_labels(documents, labels, no_docs, odd_docs):
    assert rule_ensemble.scored(odd_docs, rule_ensemble.fit(documents, labels.limit(0))).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    only_good = rule_ensemble.fit(documents, labels.where("quality = 1"))
    assert rule_ensemble.scored(odd_docs, only_good).agg(F.min("score")).first()[0] > 0.99
    assert rule_ensemble.scored(no_docs, only_good).count() == 0


def test_thresholds_mean_the_same_when_labels_are_sampled(spark):
    # Six good to one bad, alike: the share of good is the right probability, sampled or not.
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 40)), int(i % 7 > 0)) for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").cache()
    for sample_rows in (250, 5000):
        model = quality_rules.fit(docs, docs, sample_rows=sample_rows)
        assert abs(quality_rules.judged(docs, model).agg(F.avg("probability")).first()[0] - 6 / 7) < 0.1
        # Two kinds of text only, so that rules cannot learn the sample by heart.
        kinds = docs.withColumn("text", F.expr("if(doc_id % 2 = 0, 'a b c', 'aa bb cc dd')"))
        ensemble = rule_ensemble.fit(kinds, kinds, sample_rows=sample_rows)
        assert abs(rule_ensemble.scored(kinds, ensemble).agg(F.avg("score")).first()[0] - 6 / 7) < 0.1
