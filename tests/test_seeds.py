"""Seeds at some places of the targets with the bases around them, and dispatch by minimisers."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import rows
from strandflow.config import AlignConfig
from strandflow.functions.kmers import COMPLEMENT, PIECE, kmer_keys, minimiser_pieces, mixed
from strandflow.operators import align, dispatch
from strandflow.plans import pipeline


def keys(seq, k, window, most=PIECE):
    return set(np.concatenate([np.zeros(0, np.uint64), *minimiser_pieces(seq, k, window, most)]).tolist())


@settings(max_examples=200, deadline=None)
@given(st.text("ACGTN", max_size=60), st.text("ACGT", min_size=50, max_size=90), st.text("acgtN", max_size=60), st.booleans(), st.sampled_from([(28, 43), (45, 50), (5, 9), (31, 31)]), st.sampled_from([3, PIECE]))
def test_texts_that_share_a_window_share_a_minimiser(left, shared, right, turned, lengths, most):
    k, alen = lengths
    one = (left + shared).encode()
    other = (shared + right).encode()
    if turned:
        other = other.upper().translate(COMPLEMENT)[::-1]
    assert keys(one, k, alen - k + 1, most) & keys(other, k, alen - k + 1)
    # Each is the mixed key of a k-mer of the text, and pieces change nothing.
    assert keys(one, k, alen - k + 1, most) == keys(one, k, alen - k + 1) <= set(mixed(kmer_keys(one, k)).tolist())


def test_minimisers_are_a_fraction_of_all_kmers():
    seq = "".join(random.Random(1).choices("ACGT", k=200_000)).encode()
    assert len(keys(seq, 28, 16)) < 0.13 * len(set(kmer_keys(seq, 28).tolist()))
    assert not keys(b"", 28, 16) and not keys(b"ACGT" * 10, 28, 16) and not keys(b"N" * 90, 28, 16)


def plain_matches(reads, targets, alen):
    """Maximal runs by walking every diagonal."""
    found = []
    for read_id, _, read in reads:
        for strand in (0, 1):
            own = read.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1] if strand else read.upper()
            for target_id, part, seq in targets:
                there = seq.upper()
                for diagonal in range(-len(own), len(there)):
                    length = 0
                    for at in range(max(0, diagonal), min(len(there), len(own) + diagonal) + 1):
                        inside = at < len(there) and at - diagonal < len(own)
                        if inside and there[at] == own[at - diagonal] and there[at] in "ACGT":
                            length += 1
                            continue
                        if length >= alen:
                            found.append((read_id, part, target_id, strand, at - diagonal - length, at - length, length))
                        length = 0
    return sorted(found)


@pytest.mark.parametrize(("k", "alen"), [(4, 4), (4, 6), (4, 7), (3, 12), (31, 31), (40, 45)])
@pytest.mark.parametrize("small", [True, False])
def test_runs_equal_those_of_a_walk_over_all_diagonals(spark, monkeypatch, k, alen, small):
    rng = random.Random(100 * k + alen)
    word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    base = [word(120), word(90, "AC"), "A" * 50 + word(20) + "A" * 40, word(60, "ACGTN"), word(70).lower(), "", "ACG", "N" * 40]
    targets = [(i, 0, s) for i, s in enumerate(base)] + [(100, 0, base[0])]
    cut = lambda s, n: (a := rng.randrange(max(1, len(s) - n)), s[a : a + n])[1]
    turn = lambda s: s.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1]
    raw = [word(5) + cut(s, 50) + word(5) for s in base[:5]] + [turn(cut(base[0], 60)), base[2][:60], "A" * 30, cut(base[0], 20) + "N" + cut(base[0], 50), "", "AC", "x" + base[4]]
    reads = [(i, 0, s) for i, s in enumerate(raw)]
    if not small:
        monkeypatch.setattr(align, "BROADCAST_KMERS", 0)
    found = align.matches(
        spark.createDataFrame(reads, "read_id long, part int, seq string"), spark.createDataFrame([*((t, p, s) for t, p, s in targets), (7000, 0, None)], "target_id long, part int, seq string"), k, alen=alen
    )
    got = sorted(tuple(r) for r in found.select("read_id", "part", "target_id", "strand", "read_at", "target_at", "length").collect())
    assert got == plain_matches(reads, targets, alen) and got


def test_matches_over_the_ends_of_pieces(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(2 * PIECE + 500))
    spots = [PIECE - 100 + 7 * i for i in range(25)] + [2 * PIECE - 60 + 5 * i for i in range(20)]
    reads = spark.createDataFrame([(i, 0, text[a : a + 43]) for i, a in enumerate(spots)] + [(99, 0, text)], "read_id long, part int, seq string")
    found = align.matches(reads, spark.createDataFrame([(5, 0, text)], "target_id long, part int, seq string"), 28, alen=43).where("strand = 0").collect()
    assert sorted((r.read_id, r.read_at, r.target_at, r.length) for r in found) == [(i, 0, a, 43) for i, a in enumerate(spots)] + [(99, 0, 0, len(text))]


@pytest.mark.parametrize("mode", ["best", "ord"])
def test_dispatch_by_minimisers_gives_the_same_lines(spark, tmp_path, monkeypatch, mode):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [word(rng.randrange(60, 400)) for _ in range(30)]
    turn = lambda s: s.translate(COMPLEMENT.decode("latin-1"))[::-1]
    raw = [word(4) + seqs[i % 30][a : a + n] + word(4) for i, (a, n) in enumerate([(rng.randrange(40), rng.randrange(15, 60)) for _ in range(60)])]
    raw += [turn(s) for s in raw[:10]] + ["", word(50), raw[0][:12] + "N" + raw[0][13:]]
    targets = spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "target_id long, name string, seq string")
    reads = spark.createDataFrame([*((i, f"q{i}", s) for i, s in enumerate(raw)), (999, "null", None)], "read_id long, name string, seq string")
    exact = AlignConfig(partitions=3, alen=24, bmer=15, merge_mode=mode, paired=False)
    config = AlignConfig(partitions=3, alen=24, bmer=15, merge_mode=mode, paired=False, dispatch="minimiser")
    want = rows(pipeline.run(reads, targets, exact))
    assert rows(pipeline.run(reads, targets, config)) == want
    all_keys = pipeline.indexed(targets, exact, str(tmp_path / "a")).keys.count()
    own = pipeline.indexed(targets, config, str(tmp_path / "b"))
    assert own.keys.count() < 0.3 * all_keys and own.places.count() < 0.15 * all_keys
    assert rows(pipeline.run(reads, None, config, index=own)) == want
    monkeypatch.setattr(dispatch, "BROADCAST_KMERS", 0)
    assert rows(pipeline.run(reads, targets, config)) == rows(pipeline.run(reads, None, config, index=own)) == want
