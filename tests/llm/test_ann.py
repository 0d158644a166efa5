import math

import numpy as np
from pyspark.sql import functions as F

from strandflow.llm import ann, queries


def plain(ids, vectors, k=10):
    out = {}
    for i, q in zip(ids, vectors):
        if i % 100 == 0:
            apart = np.sqrt(((vectors - q) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, apart)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(apart[j])) for j in order]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_measure(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want, got = plain(ids, vectors), grouped(queries.op2_permutation_ann(spark, sf).collect())
    assert set(want) == set(got)
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 10 for q in want]) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0]))
        for v, score in found:
            assert score == float(np.sqrt(((vectors[place[v]] - vectors[place[q]]) ** 2).sum()))


def test_small_blocks_give_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = grouped(queries.op2_permutation_ann(spark, sf).collect())
    monkeypatch.setattr(ann, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    assert grouped(queries.op2_permutation_ann(spark, sf).collect()) == whole


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    near = lambda: [float(x) for x in rng.normal(size=4)]
    same = near()
    rows = [(i, near()) for i in range(1, 40)] + [(100, same), *((200 + i, same) for i in range(30)), (300, [1.0, 2.0]), (301, [1.0, 3.0])]
    odd = [(400, None), (500, []), (600, [0.0] * 4), (700, [1.0, None, 2.0, 3.0]), (800, [math.nan, 1.0, 1.0, 1.0]), (900, [math.inf, 1.0, 1.0, 1.0]), (None, near()), (1, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "'x' pivot", "'x' vector", "'x' dim")
    got = grouped(ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect())
    assert set(got) == {100, 200, 300}
    # Copies: distance 0, ties to the smaller id, never the query itself.
    assert got[100] == [(200 + i, 0.0) for i in range(10)]
    assert got[200] == [(100, 0.0), *((201 + i, 0.0) for i in range(9))]
    # Only vectors of its own length: all there are.
    assert got[300] == [(301, 1.0)]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0
