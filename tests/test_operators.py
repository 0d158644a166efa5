import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from strandflow.config import AlignConfig
from strandflow.functions import kmers, names
from strandflow.operators import align, bloom, compare, dispatch, graph, header, merge, packing, stats
from strandflow.plans import pipeline
from strandflow.storage import numbered, written

#: Known hashes.
VECTORS = [("ACGT", 0, "cdbde0904526b99c"), ("ACGTACGT", 1, "47595a06b69dfe76"), ("ACGTACGTACGTACG", 2, "872b944dcc5309bf"), ("A" * 28, 0, "0699a5507c5c3275")]


def test_murmur():
    for key, seed, want in VECTORS:
        assert f"{kmers.murmur64a(np.frombuffer(key.encode(), np.uint8)[None], seed)[0]:016x}" == want


def plain_canonical(seq, k, step=1):
    seq = "".join(c if c in "ACGT" else "N" for c in seq.upper())
    found = [seq[i : i + k] for i in range(0, len(seq) - k + 1, step)]
    return [min(x, x.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for x in found]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTNacgtR", max_size=60), st.integers(1, 12), st.integers(1, 4))
def test_canonical_kmers(seq, k, step):
    want = plain_canonical(seq, k, step)
    got = [bytes(r).decode() for r in kmers.canonical_rows(seq.encode(), k, step)]
    assert got == want
    # Keys are equal exactly where the canonical forms are.
    keys = kmers.kmer_keys(seq.encode(), k, step)
    assert len(set(keys.tolist())) == len(set(want)) and len(keys) == len(want)
    assert sorted(np.concatenate([keys[:0], *kmers.key_pieces(seq.encode(), k, step, 7)]).tolist()) == sorted(keys.tolist())
    codes = {int(v) for v in keys if not int(v) >> 63}
    assert {bytes(x).decode() for x in kmers.letters(np.array(sorted(codes), np.uint64), k)} == {w for w in want if "N" not in w}


def test_long_kmers_have_keys():
    seq = "ACGT" * 20
    assert len(kmers.kmer_keys(seq.encode(), 40)) == 41
    with pytest.raises(ValueError):
        kmers.codes(seq.encode(), 40)


@pytest.mark.parametrize(("lengths", "parts", "want"), [([1000, 900, 800, 100, 50, 50], 2, [0, 0, 1, 1, 0, 1]), ([10, 10, 10], 2, [0, 1, 0]), ([600, 600, 600], 2, [0, 0, 1]), ([10, 10, 10, 10], 3, [0, 2, 1, 0])])
def test_best_fit_examples(lengths, parts, want):
    assert packing.pack_lengths(lengths, parts) == want


def test_best_fit_with_largest_bin_as_fallback():
    assert packing.pack_lengths([10, 10, 10, 10], 3, "max") == [0, 1, 2, 0]


def test_targets_longer_than_a_bin(spark):
    df = spark.createDataFrame([(1, 100_000), (2, 1)], "id long, len long")
    with pytest.raises(Exception, match="longer than a partition"):
        packing.pack_targets(df, 4).collect()


def test_components_stay_together_and_long_ones_split(spark):
    vertices = spark.createDataFrame([(i, 300) for i in range(10)] + [(10, 0)], "id long, len long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    parts = {r.id: r.part for r in packing.pack_components(vertices, edges, 2).collect()}
    # Ids 0 to 8 are 2700 long, a bin holds 3000 // 2 + 2 + 500 = 2002: six in the first, three in the second.
    assert [parts[i] for i in range(9)] == [0] * 6 + [1] * 3 and parts[9] in (0, 1) and parts[10] is None


def plain_components(vertices, edges):
    live = {v for v, n in vertices if n}
    out = {v: [] for v in live}
    for a, b in edges:
        if a in live and b in live:
            out[a].append(b)
    comp = {}
    for v in sorted(live):
        stack = [v] if v not in comp else []
        while stack:
            u = stack.pop()
            if u not in comp:
                comp[u] = v
                stack += [w for w in out[u] if w not in comp]
    return comp


def test_components_follow_edges_only_forwards(spark):
    rng = random.Random(3)
    for _ in range(3):
        vertices = [(i, rng.choice([0, 5, 5, 5])) for i in range(40)]
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(35)]
        found = graph.reach_components(spark.createDataFrame(vertices, "id long, len long"), spark.createDataFrame(edges, "src long, dst long"))
        assert {r.id: r.comp_id for r in found.collect()} == plain_components(vertices, edges)


def test_contracted_components(spark, monkeypatch):
    """Paths, rings, trees, both directions."""
    rng = random.Random(1)
    for kind in range(3):
        n = 40
        vertices = [(i, rng.choice([0, 5, 5, 5, 5])) for i in range(n)]
        edges = [(i, (i * i + 3) % n) for i in range(n)] if kind == 2 else [(rng.randrange(n), rng.randrange(n)) for _ in range(50)]
        edges += [(b, a) for a, b in edges[:25]] if kind == 1 else []
        found = graph.reach_components(spark.createDataFrame(vertices, "id long, len long"), spark.createDataFrame(edges, "src long, dst long"))
        assert {r.id: r.comp_id for r in found.collect()} == plain_components(vertices, edges)
    order = list(range(2000))
    rng.shuffle(order)
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, tag: rounds.append(tag) or written(df, tag))
    found = graph.reach_components(spark.range(2000).selectExpr("id", "1L len"), spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long"))
    least = np.minimum.accumulate(order)
    assert {r.id: r.comp_id for r in found.collect()} == dict(zip(order, least.tolist())) and len(rounds) < 50


@pytest.mark.parametrize("kind", ["ladder", "ladder of mixed ids", "random", "long and decoys"])
def test_components_end_in_few_rounds(spark, monkeypatch, kind):
    n, rng = 10_000, random.Random(kind)
    if kind == "random":
        edges = [(a, b) if rng.random() < 0.98 else (b, a) for a, b in (sorted((rng.randrange(n), rng.randrange(n))) for _ in range(2 * n))]
    elif kind == "long and decoys":
        # Each vertex of a path also has an edge from a vertex of a smaller label than those before it, but not than the path's first.
        edges = [(i, i + 1) for i in range(n // 2)] + [(n - 1 - i, i) for i in range(1, n // 2 - 1)]
        edges = [(a if a == 0 else n - a, n - b) for a, b in edges]
    else:
        edges = [(i, i + k) for i in range(n) for k in (1, 2) if i + k < n]
        if kind == "ladder of mixed ids":
            ids = list(range(n))
            rng.shuffle(ids)
            edges = [(ids[a], ids[b]) for a, b in edges]
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, tag: tables.append(tag) or written(df, tag))
    found = graph.reach_components(spark.range(n).selectExpr("id", "1L len"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: r.comp_id for r in found.collect()} == plain_components([(i, 1) for i in range(n)], edges)
    assert len(tables) < 60


def test_components_of_nothing(spark):
    assert graph.reach_components(spark.createDataFrame([], "id long, len long"), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_numbered_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "v long, g int").repartition(5)
    assert [r.v for r in numbered(df, "v").orderBy("ordinal").collect()] == sorted(i * 7919 % 1000 for i in range(1000))
    own = numbered(df, "v", within="g").collect()
    for g in range(3):
        part = sorted((r.ordinal, r.v) for r in own if r.g == g)
        assert [n for n, _ in part] == list(range(len(part))) and [v for _, v in part] == sorted(v for _, v in part)


SAM = "read_id long, part int, ord long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, raw string"


def record(read_id, part, ord_, flag, mapq, cigar):
    rname = "*" if flag == 4 else f"t{part}"
    raw = "\t".join(map(str, (f"r{read_id}", flag, rname, 7, mapq, cigar, "=", 3, 9, "AC", "II", f"XT:{ord_}")))
    return (read_id, part, ord_, f"r{read_id}", flag, rname, 7, mapq, cigar, "=", 3, 9, "AC", "II", raw)


@pytest.fixture(scope="module")
def sam(spark):
    return spark.createDataFrame(
        [
            record(0, 0, 0, 0, 9, "5S20M"),
            record(0, 1, 0, 0, 8, "30M"),
            record(1, 0, 1, 0, 9, "20M5S"),
            record(1, 1, 1, 16, 8, "5S20M"),
            record(2, 0, 2, 4, 0, "*"),
            record(2, 1, 2, 4, 0, "*"),
            record(3, 1, 3, 0, 5, "10M"),
            record(3, 1, 4, 0, 6, "12M"),
            record(3, 0, 3, 4, 0, "*"),
            record(5, 0, 4, 0, 3, "*"),
        ],
        SAM,
    )


@pytest.fixture(scope="module")
def all_reads(spark):
    return spark.createDataFrame([(i, f"r{i} comment") for i in range(6)], "read_id long, name string")


def lines(df):
    return [(r.read_id, r.line) for r in df.orderBy("read_id", "place").collect()]


def test_fast_interleaves(sam):
    out = [r.line.split("\t")[0] + r.line.split("\t")[2] for r in merge.fast(sam).orderBy("ordinal").collect()]
    assert out == ["r0t0", "r0t1", "r1t0", "r1t1", "r2*", "r2*", "r3*", "r3t1", "r5t0", "r3t1"]


def test_mem_keeps_the_first_mapped(sam, all_reads):
    out = lines(merge.mem(sam, all_reads, 1))
    assert [i for i, _ in out] == list(range(6))
    assert out[0][1] == "r0\t0\tt0\t7\t9\t5S20M\t*\t0\t0\t*\t*"
    assert out[3][1].split("\t")[5] == "10M"
    for i in (2, 4):
        assert out[i][1] == f"r{i}\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"
    assert len(lines(merge.mem(sam, all_reads, 5))) == 9


def test_ord_keeps_all_mapped(sam, all_reads):
    out = lines(merge.in_order(sam, all_reads))
    assert [i for i, _ in out] == [0, 0, 1, 1, 2, 3, 3, 4, 5]
    assert out[0][1].endswith("XT:0") and out[4][1].startswith("r2\t4")


def test_best(sam, all_reads):
    out = dict(lines(merge.best(sam, all_reads)))
    assert out[0].split("\t")[5] == "30M" and out[0].endswith("XT:0")
    # Two of equal length: the first, without mapq and tags.
    assert out[1] == "r1\t0\tt0\t7\t0\t20M5S\t=\t3\t9\tAC\tII"
    assert out[2].split("\t")[1] == "4" and out[2].endswith("XT:2")
    assert out[3].split("\t")[5] == "12M"
    assert out[4] == "r4\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"
    # Mapped without a matched length is still mapped.
    assert out[5].split("\t")[4] == "3"
    assert dict(lines(merge.best(sam, all_reads, paired=True)))[4].startswith("r4/1\t4")


def test_streamed_and_rate(sam, all_reads):
    out = dict(lines(merge.streamed(sam)))
    assert out[0] == "r0\t0\tt1\t7\t8\t30M\t*\t0\t0\t*\t*" and out[2].split("\t")[4] == "0" and 4 not in out
    row = merge.alignment_rate(sam, all_reads).first()
    assert (row.n_reads, row.n_aligned, row.percent) == (6, 3, 50.0)


def test_merge_of_nothing(spark, all_reads):
    empty = spark.createDataFrame([], SAM)
    for mode in ("mem", "ord", "best"):
        assert merge.merged(empty, all_reads, mode).count() == 6
    assert merge.merged(empty, all_reads, "fast").count() == 0
    with pytest.raises(ValueError):
        merge.merged(empty, all_reads, "other")


def test_differences(spark):
    def side(*entries):
        return spark.createDataFrame([(i, f"r{i}", f, "t", 1, q, c, "*", 0, 0, "*", "*") for i, f, q, c in entries], "read_id long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string")

    a = side((0, 0, 9, "5M"), (1, 0, 0, "5M"), (2, 0, 9, "5M"), (3, 0, 9, "5M"), (4, 0, 9, "5M"), (5, 0, 0, "5M"), (6, 0, 9, "5M"))
    b = side((0, 0, 9, "5M"), (1, 0, 9, "5M"), (2, 0, 0, "5M"), (3, 0, 9, "6M"), (4, 16, 9, "5M"), (5, 4, 0, "*"), (6, 0, 8, "5M"))
    assert {r.kind: r.n for r in compare.differences(a, b).collect()} == dict.fromkeys(("mapq_not_zero", "mapq_zero", "diff_read_frags", "diff_dir", "bloom_filter_miss", "unclassified"), 1)


def test_round_robin_and_rendering(spark):
    reads = spark.createDataFrame([(i, f"n{i} x", "ACGT", "IIII") for i in (5, 2, 9, 7)], "read_id long, name string, seq string, qual string")
    assert {r.read_id: r.part for r in dispatch.round_robin(reads, 2).collect()} == {2: 2, 5: 1, 7: 2, 9: 1}
    sent = spark.createDataFrame([(2, 1), (2, 3)], "read_id long, part int")
    assert {r.record for r in dispatch.rendered(reads, sent).collect()} == {">2:n2 x\nACGT"}
    assert {r.record for r in dispatch.rendered(reads, sent, True).collect()} == {"@2:n2 x\nACGT\n+\nIIII"}
    assert dispatch.undispatched(reads, sent).count() == 3


def test_header(spark):
    targets = spark.createDataFrame([(1, "b", 5), (0, "a", 3)], "place long, name string, len long")
    assert [r.line for r in header.header(targets).orderBy("ord").collect()][2:] == ["@SQ\tSN:a\tLN:3", "@SQ\tSN:b\tLN:5"]
    assert header.header(targets, only_sequences=True).count() == 2


def test_metadata_of_nothing_is_an_error(spark):
    with pytest.raises(Exception, match="at least one"):
        stats.run_metadata(spark.createDataFrame([], "a int"), spark.createDataFrame([(1,)], "a int")).collect()


def test_config():
    c = AlignConfig()
    assert (c.bmer, c.step) == (15, 6)
    for bad in ({"alen": 1}, {"alen": 20, "bmer": 28}, {"merge_mode": "none"}, {"partitions": 0}, {"fallback": "x"}):
        with pytest.raises(ValueError):
            AlignConfig(**bad)
    with pytest.warns(UserWarning):
        AlignConfig(step=50)


def test_names():
    assert names.partition_name("/x/ref.fasta", 3) == "ref-3.fasta" and names.partition_name("ref", 1) == "ref-1.fa"
    assert names.split_name(".hidden") == (".hidden", "")


def test_names_as_columns(spark):
    paths = ["/a/b/ref.fa", "ref", ".hidden", "x.tar.gz", "a.b/c", "", "a/", "x.", "a/.b.c"]
    df = spark.createDataFrame([(p, i) for p in paths for i in (1, 12)], "path string, number int")
    for r in df.withColumn("name", names.partition_names(F.col("path"), F.col("number"))).collect():
        assert r.name == names.partition_name(r.path, r.number)


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(5)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    seqs = [base(rng.randrange(60, 400)) for _ in range(30)]
    seqs[7] = seqs[3]
    reads = []
    for i in range(60):
        s = rng.choice(seqs)
        n = rng.randrange(20, 50)
        at = rng.randrange(0, len(s) - n)
        piece = s[at : at + n]
        reads.append((i, f"q{i}", (base(rng.randrange(4)) + (rc(piece) if i % 2 else piece) + base(rng.randrange(4)))))
    reads += [(60, "short", "ACG"), (61, "none", base(40)), (62, "empty", ""), (63, "n", seqs[0][:10] + "N" + seqs[0][11:40])]
    targets = spark.createDataFrame(list(enumerate(seqs)), "target_id long, seq string").selectExpr("target_id", "cast(target_id as string) name", "seq")
    return targets, spark.createDataFrame(reads, "read_id long, name string, seq string"), seqs, reads


def longest(seqs, read):
    rc = read.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    best = 0
    for s in seqs:
        for r in (read, rc):
            for i in range(len(r)):
                while i + best + 1 <= len(r) and r[i : i + best + 1] in s:
                    best += 1
    return best


def test_long_and_unknown_sequences():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for seq in (b"N" * 10_000_000, b"ACGTTGCAAC" * 5_000_000):
        n = sum(len(x) for x in kmers.key_pieces(seq, 28))
        assert n == len(seq) - 27
    assert sum(len(x) for x in kmers.key_pieces(b"N" * 1_000_000, 45)) == 1_000_000 - 44
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def plain_bins(lengths, total, parts, fallback, left):
    """Best fit length by length."""
    out = []
    for n in lengths:
        fits = [(c - n, i) for i, c in enumerate(left) if 0 < c - n < total]
        if fits:
            at = min(fits)[1]
        elif fallback == "max":
            at = max(range(parts), key=lambda i: (left[i], -i))
        else:
            at = max((i for i, c in enumerate(left) if c > left[0]), default=0)
        left[at] -= n
        out.append(at)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=40), st.integers(1, 6), st.sampled_from(["last", "max"]), st.integers(1, 700))
def test_runs_of_equal_lengths_go_where_each_alone_goes(lengths, parts, fallback, most):
    lengths = sorted((n % most for n in lengths), reverse=True)
    want = plain_bins(lengths, sum(lengths), parts, fallback, [packing.capacity(sum(lengths), parts)] * parts)
    bins, got = packing.Bins(sum(lengths), parts, fallback), []
    for n in sorted(set(lengths), reverse=True):
        for part, run in bins.put(n, lengths.count(n)):
            got += [part] * run
    assert got == want


def test_packing_deals_rows_by_rank(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 7)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 3, 3, 3, 900, 40, rng.randrange(1000)])) for i in range(400)]
    found = packing.pack_targets(spark.createDataFrame(rows, "id long, len long"), 5)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    total = sum(n for _, n in rows)
    want = plain_bins([n for _, n in order], total, 5, "last", [packing.capacity(total, 5)] * 5)
    assert {r.id: r.part for r in found.collect()} == {i: p for (i, _), p in zip(order, want)}
    # Only distinct lengths, written before, and the counts of tasks pass through one task.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "REPARTITION_BY_NUM" not in plan


@pytest.mark.parametrize("block", [1, 5, 64, 4096])
def test_long_components_split_as_if_row_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "LEAST_BLOCK", block)
    rng = random.Random(block)
    lengths = [rng.choice([1, 5, 60, rng.randrange(1, 400)]) for _ in range(150)]
    bins, plain = packing.Bins(0, 4, left=[1500, 1000, 2500, 450]), packing.Bins(0, 4, left=[1500, 1000, 2500, 450])
    found = packing.split_in_order(spark.createDataFrame([(i + 100, n, i) for i, n in enumerate(lengths)], "id long, len long, ordinal long"), bins)
    want = {i + 100: plain.put_first(n)[0][0] for i, n in enumerate(lengths)}
    assert {r.id: r.part for r in found.collect()} == want and bins.left == plain.left and None in want.values()


@pytest.mark.parametrize(("alen", "bmer"), [(60, 0), (45, 40)])
def test_kmers_longer_than_a_code(spark, alen, bmer):
    rng = random.Random(8)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [base(300) for _ in range(6)]
    raw = [(i, f"q{i}", base(5) + seqs[i % 6][i : i + 40 + 3 * i] + base(5)) for i in range(20)]
    targets = spark.createDataFrame(list(enumerate(seqs)), "target_id long, seq string").selectExpr("target_id", "cast(target_id as string) name", "seq")
    reads = spark.createDataFrame(raw, "read_id long, name string, seq string")
    config = AlignConfig(partitions=2, alen=alen, bmer=bmer, paired=False)
    out = {r.read_id: r.line.split("\t")[5] for r in pipeline.run(reads, targets, config).collect()}
    for i, _, s in raw:
        n, found = longest(seqs, s), sum(int(x[:-1]) for x in __import__("re").findall(r"\d+M", out[i]))
        assert found == (n if n >= alen else 0)


def test_dispatch_misses_no_match_and_partitions_do_not_matter(spark, genome):
    targets, reads, seqs, raw = genome
    want = {i: longest(seqs, s) for i, _, s in raw}
    for parts in (1, 3):
        config = AlignConfig(partitions=parts, alen=20, paired=False)
        out = {r.read_id: r.line.split("\t") for r in pipeline.run(reads, targets, config).collect()}
        assert set(out) == set(want)
        for i, n in want.items():
            found = sum(int(x[:-1]) for x in __import__("re").findall(r"\d+M", out[i][5]))
            assert found == (n if n >= 20 else 0), (parts, i)


@pytest.mark.parametrize("k", [15, 33])
def test_bloom_holds_the_exact(spark, genome, monkeypatch, k):
    monkeypatch.setattr(bloom, "BLOCK_BITS", 1 << 10)  # some blocks for these few k-mers
    targets, reads, _, _ = genome
    own = targets.selectExpr("cast(target_id % 3 as int) part", "seq")
    blocks = bloom.n_blocks(own, k, 8)
    assert blocks > 10
    found = bloom.probe(bloom.build(own, k, blocks, 5), reads, k, 2, blocks, 5)
    exact = {tuple(r) for r in dispatch.exact(own, reads, k, 2).select("read_id", "part").collect()}
    assert exact <= {tuple(r) for r in found.select("read_id", "part").collect()}
    assert {tuple(r) for r in bloom.verified(own, reads, found, k, 2).select("read_id", "part").collect()} == exact
    monkeypatch.setattr(bloom, "BROADCAST_KMERS", 0)
    assert {tuple(r) for r in bloom.verified(own, reads, found, k, 2).select("read_id", "part").collect()} == exact


def test_false_positives_are_as_many_as_theory_says(spark):
    """Of k-mers that are in no target, about (1 - e^(-nhash / ibits))^nhash are said to be."""
    rng = np.random.default_rng(4)
    seq = lambda n: bytes(rng.choice(np.frombuffer(b"ACGT", np.uint8), n)).decode()
    own = spark.createDataFrame([(0, seq(150_000)), (1, seq(150_000))], "part int, seq string")
    reads = spark.createDataFrame([(i, seq(28)) for i in range(20_000)], "read_id long, seq string")
    for ibits, nhash in ((8, 5), (4, 3)):
        blocks = bloom.n_blocks(own, 28, ibits)
        n = bloom.probe(bloom.build(own, 28, blocks, nhash), reads, 28, 1, blocks, nhash).count()
        # Filters are filled up to whole blocks: so many bits a k-mer.
        bits = blocks * bloom.BLOCK_BITS / (150_000 - 27)
        want = 40_000 * (1 - np.exp(-nhash / bits)) ** nhash
        assert abs(n - want) < 5 * np.sqrt(want) + 0.05 * want


def test_shuffled_dispatch_equals_broadcast(spark, genome, monkeypatch):
    targets, reads, _, _ = genome
    own = targets.selectExpr("cast(target_id % 3 as int) part", "seq")
    want = rows(dispatch.exact(own, reads, 15, 6))
    monkeypatch.setattr(dispatch, "BROADCAST_KMERS", 0)
    assert rows(dispatch.exact(own, reads, 15, 6)) == want


def test_program_outside(spark, tmp_path):
    script = tmp_path / "aligner.py"
    script.write_text("import sys\nprint('@HD')\nfor x in open(sys.argv[1]):\n  if x[0] == '>':\n    print(x[1:].strip() + '\\t4\\t*')\n")
    reads = spark.createDataFrame([(0, 0, "a", "AC"), (1, 0, "b", "GT"), (1, 1, "b", "GT")], "read_id long, part int, name string, seq string")
    targets = spark.createDataFrame([(0, 5, "t", "ACGT"), (1, 6, "u", "GT")], "part int, target_id long, name string, seq string")
    out = align.run_program(reads, targets, ["python", str(script), "{reads}", "{targets}"])
    assert sorted(r.value for r in out.collect()) == ["0:a\t4\t*", "1:b\t4\t*", "1:b\t4\t*"]
    align.adapter("all-unmapped", ["python", str(script), "{reads}", "{targets}"])
    found = align.align("all-unmapped", reads, targets, k=2, alen=2).collect()
    assert sorted((r.read_id, r.part, r.qname, r.flag) for r in found) == [(0, 0, "a", 4), (1, 0, "b", 4), (1, 1, "b", 4)]
    with pytest.raises(Exception, match="failed on partition"):
        align.run_program(reads, targets, ["false"]).collect()
    with pytest.raises(ValueError, match="no aligner"):
        align.align("other", reads, targets)
