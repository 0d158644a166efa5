import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from strandflow.llm import queries, simhash
from strandflow.llm.common import hot_join, word_parts
from strandflow.llm.components import components


TEXT = "the cat sat on the mat and looked at the moon for a long while before it slept"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = np.array([xxhash.xxh64_intdigest(s, seed=42) for s in shingles], np.uint64)
    return sum(int(2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes)) << b for b in range(64))


def plain_components(prints, most=4):
    """Smallest doc_id reachable, for (doc_id, fingerprint) rows."""
    distinct = np.unique(np.array([f for _, f in prints], np.uint64))
    group = {int(f): int(f) for f in distinct}
    for f in distinct:
        for other in distinct[np.bitwise_count(distinct ^ f) <= most]:
            a, b = group[int(f)], group[int(other)]
            if a != b:
                group = {k: a if v == b else v for k, v in group.items()}
    smallest = {}
    for i, f in prints:
        if i is not None:
            smallest[group[f]] = min(smallest.get(group[f], i), i)
    return [(i, f, smallest.get(group[f])) for i, f in prints]


def check(docs, found):
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(i), f"{f:016x}", str(c)) for i, f, c in plain_components(prints))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found.collect()) == want


def test_query(spark, documents):
    check(documents, queries.op10_simhash(spark, "/root/testdata/sf0.001"))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, simhash.near_duplicates(odd_docs))
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd_docs).collect() if r.doc_id is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(found.values()))
    assert simhash.one_of_each(no_docs).count() == 0


def test_one_of_each_keeps_other_texts_and_columns(spark):
    other = "quite another text about ships and harbours and the wind that carries them home again"
    rows = [(1, TEXT), (1, other), (2, TEXT), (3, other), (3, other), (None, TEXT), (None, "alone without a number in all the world of words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' _rank", "'y' _hash", "'z' fp", "map('k', 1) `a.b`", "array(1) rank", "1 n", "2 root")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(found, key=str) == sorted([(1, TEXT), (1, other), (None, rows[6][1]), (4, None)], key=str)
    assert all((r._rank, r._hash, r.fp, r["a.b"]) == ("x", "y", "z", {"k": 1}) for r in kept.collect())


def test_hot_keys_are_dealt(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(3000)], "doc_id long, fp long")
    once = rows.groupBy("fp").count().withColumn("label", F.col("fp") * 2).cache()
    found = hot_join(rows, once, "fp", "count", 3000)
    assert sorted(map(tuple, found.select("doc_id", "fp", "label").collect())) == [(i, f, 2 * f) for i, f in sorted(map(tuple, rows.collect()))]


def test_very_long_texts_in_parts(monkeypatch):
    rng = random.Random(9)
    for n in (0, 1, 3, 4, 5, 400):
        text = " ".join("w" * rng.randrange(1, 30) for _ in range(n)).encode()
        whole = [b"".join(simhash.shingle_hashes(text, w, 42)) for w in (1, 4, 5)], simhash.set_name(text)
        with monkeypatch.context() as m:
            m.setattr(simhash, "word_parts", lambda t: word_parts(t, 20))
            assert ([b"".join(simhash.shingle_hashes(text, w, 42)) for w in (1, 4, 5)], simhash.set_name(text)) == whole


def clustered(rng, n):
    out = set()
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            f = centre
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


def labels_of(edges, prints):
    group = {f: f for f in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    return {f: find(f) for f in prints}


def test_links_connect_all_within_four_bits(spark):
    rng = random.Random(1)
    prints = clustered(rng, 150)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    classes = spark.createDataFrame(signed, "fp long").repartition(4).cache()
    all_links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    want = labels_of(all_links, prints)
    two = [(list(range(32)), 2), (list(range(32, 64)), 1)]
    three = [(list(range(0, 21)), 1), (list(range(21, 42)), 1), (list(range(42, 64)), 0)]
    for groups in (None, two, three):
        for posting_rows in (4096, 5):
            edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(classes, groups=groups, posting_rows=posting_rows).collect()]
            assert all((a ^ b).bit_count() <= 4 for a, b in edges)
            assert labels_of(edges, prints) == want


def test_large_postings_are_compared_in_blocks(spark):
    # All classes share a posting and lie close together: a forest comes out, not the pairs.
    prints = [i << 40 for i in range(512)]
    classes = spark.createDataFrame([(f,) for f in prints], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(classes, posting_rows=40).collect()]
    assert len(set(labels_of(edges, prints).values())) == 1


def test_plan():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, 3000, dtype=np.uint64)
    small, large = simhash.plan(sample, 10_000), simhash.plan(sample, 10**11)
    for chosen in (small, large):
        assert sum(t + 1 for _, t in chosen) == 5
        bits = [b for own, _ in chosen for b in own]
        assert len(bits) == len(set(bits))
    assert max(t for _, t in large) > max(t for _, t in small)
    # Correlated bits come together.
    doubled = sample & np.uint64(0xFFFFFFFF)
    doubled |= doubled << np.uint64(32)
    for own in simhash.bit_groups(doubled, 4):
        assert sum((b + 32) % 64 in own for b in own) >= len(own) - 1


def test_thresholds_are_the_cheapest():
    costs = [[0, 5, 9], [0, 1, 100], [0, 2, 3]]
    assert simhash.thresholds(costs, 2) == (4.0, [-1, 0, 1])


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((0, 0), (50, 30), (60, 120)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = labels_of(edges, range(n))
        assert all(found.get(v, v) == want[v] for v in range(n))
    path = [(i, i + 1) for i in range(100)]
    rng.shuffle(path)
    assert {r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}


def five_word_sets(texts):
    split = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]


def edited_copies(rng, copies):
    """Texts of 150 words, `copies` of each with one to four words replaced, and others unlike them."""
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(8):
        words = rng.choices(vocabulary, k=150)
        for n in range(copies):
            own = list(words)
            for _ in range(n and rng.randrange(1, 5)):
                own[rng.randrange(150)] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out + [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 150))) for _ in range(60)]


def test_similar_texts_are_linked(spark):
    texts = edited_copies(random.Random(5), 7)
    sets = five_word_sets(texts)
    bits = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (bits[i] ^ bits[j]).bit_count() <= 4]
    assert sum((bits[i] ^ bits[j]).bit_count() > 4 for i, j in pairs) > 20
    want = labels_of(pairs, range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similar=0.8).collect()} == want
    assert {r.doc_id for r in simhash.one_of_each(docs, similar=0.8).collect()} == set(want.values())
    own = simhash.with_sets(docs, "doc_id", "text", 4, 42, True).cache()
    number = {b: i for i, b in enumerate(bits)}
    exact = labels_of([(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])], range(len(texts)))
    # Listed pairs; some postings, then all, by stars and in blocks.
    for paired, set_rows, stars in ((48, 1024, 3), (3, 1024, 1), (1, 4, 2)):
        edges = simhash.similar_links(own, docs, "doc_id", "text", 4, 42, 0.8, paired, set_rows, stars).collect()
        assert labels_of([(number[r.a % (1 << 64)], number[r.b % (1 << 64)]) for r in edges], range(len(texts))) == exact


def test_pipeline_stage_drops_similar_texts(spark):
    import corpus_pipeline

    texts = edited_copies(random.Random(6), 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = five_word_sets(texts)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert not [(i, j) for i in kept for j in kept if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
