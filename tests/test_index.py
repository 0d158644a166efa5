"""The index of targets: kept, found again, joined without a shuffle of the targets; runs that go on where one stopped."""

import random
import re

import pytest

from helpers import rows
from strandflow.config import AlignConfig
from strandflow.operators import align, dispatch, index
from strandflow.plans import pipeline
from strandflow.streaming.stream import merge_batch, run_stream


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(7)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [base(rng.randrange(60, 300)) for _ in range(20)]
    raw = [(i, f"q{i}", base(3) + seqs[i % 20][i : i + 40] + base(3)) for i in range(20)] + [(20, "n", seqs[0][:10] + "N" + seqs[0][11:50]), (21, "none", base(40)), (22, "empty", ""), (23, "null", None)]
    targets = spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "target_id long, name string, seq string")
    return targets, spark.createDataFrame(raw, "read_id long, name string, seq string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("config", [AlignConfig(partitions=3, alen=20, paired=False), AlignConfig(partitions=3, alen=20, paired=False, dispatch="bloom"), AlignConfig(partitions=2, alen=36, bmer=33, paired=False)])
def test_runs_with_an_index_equal_runs_without(spark, genome, tmp_path, config):
    targets, reads = genome
    want = rows(pipeline.run(reads, targets, config))
    folder = str(tmp_path / "i")
    assert index.opened(spark, folder, config) is None
    made = pipeline.indexed(targets, config, folder)
    found = index.opened(spark, folder, config, made.digest)
    for own in (made, found):
        assert rows(pipeline.run(reads, None, config, index=own)) == want


def test_an_index_of_other_targets_or_settings_is_not_used(spark, genome, tmp_path):
    targets, _ = genome
    folder, config = str(tmp_path / "i"), AlignConfig(partitions=2, alen=20)
    made = pipeline.indexed(targets, config, folder)
    assert index.opened(spark, folder, AlignConfig(partitions=2, alen=21)) is None and index.opened(spark, folder, config, "other") is None
    other = pipeline.indexed(targets.where("target_id > 0"), config, folder)
    assert other.digest != made.digest and other.names.count() == 19
    (tmp_path / "i" / "manifest" / "_SUCCESS").unlink()
    assert index.opened(spark, folder, config) is None


def test_the_targets_side_is_neither_shuffled_nor_read_as_text(spark, genome, tmp_path, monkeypatch):
    targets, reads = genome
    config = AlignConfig(partitions=2, alen=20, paired=False)
    own = pipeline.indexed(targets, config, str(tmp_path / "i"))
    monkeypatch.setattr(dispatch, "BROADCAST_KMERS", 0)
    monkeypatch.setattr(align, "BROADCAST_KMERS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = dispatch.exact(own.targets, reads, config.bmer, config.step, own.keys)
        found = align.matches(reads.join(hits, "read_id"), own.targets, config.bmer, own.places)
        for df, table in ((hits, "keys"), (found, "places")):
            plan = plan_of(df)
            scan = re.search(rf"\n([ :+\-*()0-9]*)FileScan parquet \S*strandflow_{table}_[^\n]*", plan)
            assert "Bucketed: true" in scan.group() and "MapInArrow" not in plan
            # Up to the join, nothing stands over the scan but a filter, a projection and a sort.
            above = [line for line in plan[: scan.start() + 1].splitlines() if "SortMergeJoin" in line or "Exchange" in line]
            assert "SortMergeJoin" in above[-1] or "Exchange" in above[-1] and above[-1].index("Exchange") >= scan.group().index("FileScan") - 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines, lost = merge_batch(reads, own)
    assert "seq" not in "".join(re.findall(r"ReadSchema: struct<[^>]*target_id[^>]*>", plan_of(lines)))
    assert lost == 3 and lines.count() == 24


def test_micro_batches_give_the_lines_of_one_run(spark, genome, tmp_path):
    targets, reads = genome
    config = AlignConfig(partitions=2, alen=20, paired=False)
    for i in range(4):
        reads.where(f"read_id % 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "reads"))
    own = pipeline.indexed(targets, config, str(tmp_path / "i"))
    made = []
    with pytest.MonkeyPatch.context() as patch:
        # Once the index is there, no k-mer of a target is made.
        patch.setattr(align, "positioned", lambda df, columns, *a, f=align.positioned: made.append(columns) or f(df, columns, *a))
        stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
        run_stream(stream, own, str(tmp_path / "out"), str(tmp_path / "state"))
    assert made == [["read_id"]] * 4
    found = spark.read.schema("read_id long, place int, line string, batch int").parquet(str(tmp_path / "out"))
    assert found.select("batch").distinct().count() == 4
    assert rows(found.select("read_id", "line")) == rows(pipeline.run(reads, targets, config).select("read_id", "line"))


def test_a_second_run_makes_no_kmers(spark, genome, tmp_path, monkeypatch):
    targets, reads = genome
    config = AlignConfig(partitions=2, alen=20, paired=False)
    folder = str(tmp_path / "run")
    pipeline.run_to_files(reads, targets, config, folder)
    first = rows(spark.read.text(f"{folder}/result"))
    for module, name in ((dispatch, "keys_of"), (dispatch, "near"), (align, "positioned"), (index, "keys_of"), (index, "positioned")):
        monkeypatch.setattr(module, name, lambda *a: pytest.fail("k-mers are made again"))
    pipeline.run_to_files(reads, targets, config, folder)
    assert rows(spark.read.text(f"{folder}/result")) == first
    with pytest.raises(pytest.fail.Exception):
        pipeline.run_to_files(reads.where("read_id > 0"), targets, config, folder)
