"""An index whose places serve dispatch and the aligner, looked through once for a batch."""

import os
import random

import pytest

from helpers import rows
from strandflow.config import AlignConfig
from strandflow.operators import align, dispatch, index
from strandflow.plans import pipeline
from strandflow.streaming.stream import merge_batch


@pytest.mark.parametrize("few", [True, False])
def test_places_serve_dispatch_and_a_batch_reads_them_once(spark, tmp_path, monkeypatch, few):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [word(300) for _ in range(20)]
    targets = spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "target_id long, name string, seq string")
    reads = spark.createDataFrame([(i, f"q{i}", word(3) + seqs[i][i : i + 40]) for i in range(12)] + [(20, "none", word(40)), (21, "null", None)], "read_id long, name string, seq string")
    config = AlignConfig(partitions=3, alen=24, bmer=15, paired=False, dispatch="minimiser")
    own = pipeline.indexed(targets, config, str(tmp_path / "i"))
    assert sorted(x for x in os.listdir(tmp_path / "i") if x[0] not in "._") == ["manifest", "places", "targets"]
    if not few:
        for module in (align, dispatch, index):
            monkeypatch.setattr(module, "BROADCAST_KMERS", 0)
    narrow = own.for_reads(reads)
    assert narrow.places.count() < 0.3 * own.places.count() if few else narrow is own
    lines, lost = merge_batch(reads, own)
    assert lost == 2 and lines.count() == 14
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert ("strandflow_places" in plan) != few
    want = pipeline.run(reads, targets, AlignConfig(partitions=3, alen=24, bmer=15, paired=False))
    assert rows(pipeline.run(reads, None, config, index=own)) == rows(want)
