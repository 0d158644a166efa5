"""Array code over many sequences at once: the same k-mers and seeds as of each sequence, and no work on those that nobody wants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from strandflow.functions import kmers
from strandflow.functions.kmers import Wanted, bundles, core_length, kmer_keys, wanted_keys
from strandflow.functions.sequences import ALPHABET, AS_BASES, dna
from strandflow.operators import align


def words(seed, letters="ACGT"):
    rng = random.Random(seed)
    return lambda n: "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("k", [1, 14, 28, 31, 32, 45, 46])
@pytest.mark.parametrize("letters", ["ACGT", "ACGTNacgt", "AAAC", "AN"])
@pytest.mark.parametrize("most", [20, 1 << 17])
def test_wanted_keys_of_a_bundle_are_those_of_each_sequence(k, letters, most):
    word = words(k, letters)
    seqs = [word(n).encode() for n in (0, 3, k, 200, 90, 0, 70, k - 1)]
    turned = lambda s: s.upper().translate(kmers.NORMAL).translate(kmers.COMPLEMENT)[::-1]
    reads = [turned(seqs[3][20:120]), seqs[4], word(60).encode(), seqs[6][: k + 3]]
    wanted = np.concatenate([kmer_keys(r, k) for r in reads])
    core = core_length(k)
    cores = np.concatenate([kmer_keys(r[(k - core) // 2 :], core) for r in reads])
    found = set()
    for bundle in bundles(seqs, k, most=most):
        keys, piece = wanted_keys(bundle, k, Wanted(wanted), Wanted(cores))
        found |= set(zip(bundle.own[piece].tolist(), keys.tolist(), strict=True))
    assert found == {(i, x) for i, s in enumerate(seqs) for x in set(kmer_keys(s, k).tolist()) & set(wanted.tolist())}


def test_long_kmers_that_nobody_wants_are_not_hashed(monkeypatch):
    word = words(1)
    seqs = [word(2000).encode() for _ in range(20)]
    read = seqs[3][100:160]
    hashed = []
    monkeypatch.setattr(kmers, "hashed_keys", lambda text, k, at, f=kmers.hashed_keys: hashed.append(len(at)) or f(text, k, at))
    got = [wanted_keys(b, 45, Wanted(kmer_keys(read, 45)), Wanted(kmer_keys(read[7:], 31))) for b in bundles(seqs, 45)]
    # The read's own k-mers, made once for the test and once found.
    assert sum(len(keys) for keys, _ in got) == 16 and sum(hashed) <= 3 * 16


def test_seeds_that_are_not_wanted_do_not_leave_the_kernel(spark):
    word = words(2, "ACGTN")
    seqs = [(i, word(n)) for i, n in enumerate((0, 5, 300, 400, 250, 31, 90))] + [(50, None)]
    targets = spark.createDataFrame(seqs, "target_id long, seq string")
    every = align.positioned(targets, ["target_id"], 9, 4, False)
    wanted = every.where("code % 3 = 0").select("code")
    assert rows(align.positioned(targets, ["target_id"], 9, 4, False, wanted)) == rows(every.where("code % 3 = 0")) != []
    assert rows(align.positioned(targets, ["target_id"], 9, 4, False, wanted.where("false"))) == []


def test_letters_as_bases_as_by_expressions(spark):
    texts = ["", None, "Hello, World 12", "straße ÄÖÜ ıİ ﬁ K", "\x00a\nb\tc", ALPHABET + ALPHABET.lower(), "日本語 abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), ALPHABET, AS_BASES)
    assert [tuple(r) for r in df.select("i", dna(F.col("text")).alias("s")).orderBy("i").collect()] == [tuple(r) for r in df.select("i", plain.alias("s")).orderBy("i").collect()]
