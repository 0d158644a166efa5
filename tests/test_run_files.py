"""A run as files: few reads look through the targets, many go by an index of them; what is kept on disk."""

import os
import random
from dataclasses import replace

import pytest

from helpers import rows
from strandflow.config import AlignConfig
from strandflow.operators import align, bloom, dispatch, index, packing
from strandflow.plans import pipeline

CONFIG = AlignConfig(partitions=3, alen=24, bmer=15, paired=False)


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [word(4000) for _ in range(30)]
    seqs[3] = seqs[3][:50] + "N" + seqs[3][51:]
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    raw = [(i, f"q{i}", word(3) + seqs[i][i : i + 40] + word(3)) for i in range(20)] + [(20 + i, f"t{i}", turn(seqs[i][60:110])) for i in range(5)]
    raw += [(30, "n", seqs[3][30:80]), (31, "short", seqs[0][:18]), (32, "none", word(40)), (33, "empty", ""), (34, "null", None)]
    targets = spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "target_id long, name string, seq string")
    return targets, spark.createDataFrame(raw, "read_id long, name string, seq string")


def size(folder):
    return sum(os.path.getsize(f"{top}/{name}") for top, _, names in os.walk(folder) for name in names)


def sent(spark, folder):
    return rows(spark.read.text(f"{folder}/dispatched"))


@pytest.mark.parametrize("how", ["bloom", "exact", "minimiser"])
def test_few_reads_leave_no_tables_larger_than_the_targets(spark, genome, tmp_path, monkeypatch, how):
    targets, reads = genome
    config, folder = replace(CONFIG, dispatch=how), str(tmp_path / "run")
    pipeline.run_to_files(reads, targets, config, folder)
    lines = rows(spark.read.text(f"{folder}/result").where("value not like '@%'"))
    assert lines == rows(pipeline.run(reads, targets, config).select("line"))
    if how == "minimiser":
        return
    # The targets with their parts, and what belongs to the reads.
    assert not os.path.exists(f"{folder}/index") and size(f"{folder}/stages") < 30 * 4000
    with monkeypatch.context() as patch:
        for module, name in ((pipeline, "partitioned"), (pipeline, "sent_to"), (pipeline, "aligned")):
            patch.setattr(module, name, lambda *a: pytest.fail("a finished stage is made again"))
        pipeline.run_to_files(reads, targets, config, folder)
    with monkeypatch.context() as patch:
        patch.setattr(pipeline, "partitioned", lambda *a: pytest.fail("the same targets are partitioned again"))
        pipeline.run_to_files(reads.where("read_id < 10"), targets, config, folder)
    assert spark.read.text(f"{folder}/result").where("value not like '@%'").count() == 10
    pipeline.run_to_files(reads, targets.where("target_id > 0"), config, folder)
    assert spark.read.text(f"{folder}/result").where("value like '@SQ%'").count() == 29


@pytest.mark.parametrize("how", ["bloom", "exact"])
def test_many_reads_go_by_an_index_and_few_use_it_once_it_is_there(spark, genome, tmp_path, monkeypatch, how):
    targets, reads = genome
    config, few, many = replace(CONFIG, dispatch=how), str(tmp_path / "few"), str(tmp_path / "many")
    pipeline.run_to_files(reads, targets, config, few)
    with monkeypatch.context() as patch:
        for module in (pipeline, align, bloom, dispatch, index):
            patch.setattr(module, "BROADCAST_KMERS", 0)
        pipeline.run_to_files(reads, targets, config, many)
    assert os.path.exists(f"{many}/index/keys") and os.path.exists(f"{many}/index/bank") == (how == "bloom")
    assert sent(spark, many) == sent(spark, few) and rows(spark.read.text(f"{many}/result")) == rows(spark.read.text(f"{few}/result"))
    with monkeypatch.context() as patch:
        patch.setattr(pipeline, "partitioned", lambda *a: pytest.fail("an index that is there is not used"))
        pipeline.run_to_files(reads.where("read_id < 10"), targets, config, many)
    pipeline.run_to_files(reads.where("read_id < 10"), targets, config, few)
    assert sent(spark, many) == sent(spark, few) and rows(spark.read.text(f"{many}/result")) == rows(spark.read.text(f"{few}/result"))


@pytest.mark.parametrize(("partitions", "nhash", "most", "want"), [(3, 5, 18, True), (3, 5, 17, False), (1, 5, 15, True), (1, 5, 14, False)])
def test_how_many_reads_are_few(spark, monkeypatch, partitions, nhash, most, want):
    monkeypatch.setattr(pipeline, "BROADCAST_KMERS", most)
    reads = spark.createDataFrame([(0, "A" * 16), (1, "C" * 15), (2, "A" * 14), (3, None)], "read_id long, seq string")
    assert pipeline.few(reads, replace(CONFIG, partitions=partitions, nhash=nhash)) == want
    assert pipeline.few(reads.where("read_id < 0"), CONFIG)


@pytest.mark.parametrize("most", [250_000, 0])
@pytest.mark.parametrize("fallback", ["last", "max"])
def test_targets_get_their_parts_as_best_fit_has_them(spark, monkeypatch, most, fallback):
    monkeypatch.setattr(packing, "BROADCAST_RANGES", most)
    rng = random.Random(8)
    # Lengths that begin in several bins, that nearly all targets have, that none other has, and none at all; ids far apart.
    lengths = [400] * 60 + [37] * 40 + [rng.randrange(1, 900) for _ in range(50)] + [0] * 5
    ids = rng.sample(range(-1000, 1 << 40), len(lengths))
    targets = spark.createDataFrame([(i, str(i), "A" * n) for i, n in zip(ids, lengths, strict=True)], "target_id long, name string, seq string").repartition(7)
    for parts in (1, 3, 7):
        want = {r.id: r.part for r in packing.pack_targets(targets.selectExpr("target_id id", "length(seq) len"), parts, fallback).collect()}
        found = packing.with_parts(targets, parts, fallback)
        got = found.collect()
        assert {r.target_id: r.part for r in got} == want and len(got) == len(lengths) and len(set(want.values())) == parts
        assert found.columns == ["target_id", "name", "seq", "part"] or not most
        assert all(len(r.seq) == lengths[ids.index(r.target_id)] and r.name == str(r.target_id) for r in got)


def test_the_targets_text_is_not_shuffled_to_find_its_part(spark):
    targets = spark.range(3000).selectExpr("id target_id", "cast(id as string) name", "repeat('ACGT', cast(id % 50 + 1 as int)) seq")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pipeline.partitioned(targets, CONFIG)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
