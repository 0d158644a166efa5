"""Anchors: what an index keeps of all k-mers, and finding each of them again."""

import random

import numpy as np
import pytest

from strandflow.functions.kmers import anchors, pieces


def canonical(s):
    return min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))


@pytest.mark.parametrize("k", [1, 2, 14, 15, 16, 28, 33, 45, 62, 63])
@pytest.mark.parametrize("letters", ["ACGT", "ACGTN", "AAAC", "AN"])
def test_anchors_tell_exactly_which_kmers_are_there(k, letters):
    rng = random.Random(k)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for most in (17, 64, 1 << 17):
        target = text(rng.randrange(300))
        read = text(40) + "".join(x if rng.random() < 0.5 else x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in (target[a : a + k + 9] for a in (3, 50, 100)))
        table = {}
        for _, piece in pieces(target.encode(), k, most):
            for key, *beside in zip(*(x.tolist() for x in anchors(piece, k)), strict=True):
                table.setdefault(key, []).append(beside)
        for step in (1, 3):
            found = []
            for begin, piece in pieces(read.encode(), k, most):
                for key, before, behind, n_before, n_behind in zip(*(x.tolist() for x in anchors(piece, k, step, begin)), strict=True):
                    fits = lambda own, n, asked, n_asked: n >= n_asked and own & ((1 << 2 * n_asked) - 1) == asked
                    found.append(any(fits(b, nb, before, n_before) and fits(e, ne, behind, n_behind) for b, e, nb, ne in table.get(key, [])))
            there = {canonical(target[i : i + k]) for i in range(len(target) - k + 1)}
            want = [canonical(read[i : i + k]) in there for i in range(0, len(read) - k + 1, step)]
            assert sorted(found) == sorted(want)


def test_anchors_are_a_fraction_of_all_kmers():
    seq = np.random.default_rng(3).choice(np.frombuffer(b"ACGT", np.uint8), 100_000).tobytes()
    assert len(anchors(seq, 28)[0]) < 0.15 * len(seq)


def test_candidates_of_a_few_reads_shuffle_no_bank(spark, monkeypatch):
    from strandflow.operators import bloom

    monkeypatch.setattr(bloom, "BLOCK_BITS", 1 << 10)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ACGTN") if rng.random() < 0.01 else rng.choice("ACGT") for _ in range(n))
    seqs = [text(600) for _ in range(30)]
    targets = spark.createDataFrame([(i % 3, s) for i, s in enumerate(seqs)] + [(0, None), (1, "")], "part int, seq string")
    reads = spark.createDataFrame([(i, s[40:90]) for i, s in enumerate(seqs)] + [(50 + i, text(60)) for i in range(40)], "read_id long, seq string")
    blocks = bloom.n_blocks(targets, 20, 4)
    want = {tuple(r) for r in bloom.probe(bloom.build(targets, 20, blocks, 3), reads, 20, 2, blocks, 3).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(bloom, "build", lambda *a: pytest.fail("a whole bank is built"))
        assert {tuple(r) for r in bloom.candidates(targets, reads, 20, 2, blocks, 3).collect()} == want
    monkeypatch.setattr(bloom, "BROADCAST_KMERS", 0)
    assert {tuple(r) for r in bloom.candidates(targets, reads, 20, 2, blocks, 3).collect()} == want


@pytest.mark.parametrize("n", [0, 1, 100, 30_000])
def test_places_of_bits_are_packed_and_unpacked(n):
    from strandflow.operators.bloom import packed, unpacked

    size = 1 << 20
    places = np.unique(np.random.default_rng(n).integers(0, size, n))
    own = packed(places, size)
    assert np.flatnonzero(np.unpackbits(unpacked(own, size), bitorder="little")).tolist() == places.tolist() and len(own) <= size // 8
