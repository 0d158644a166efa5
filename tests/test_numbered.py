"""Row numbers within values: whatever share of the rows a value has, no task gets them all."""

import pytest
from pyspark.sql import functions as F

from strandflow import storage


@pytest.mark.parametrize("most", [0, 100_000])
def test_a_value_that_most_rows_have_is_not_dealt_to_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(storage, "BROADCAST_RUNS", most)
    g = F.when(F.col("id") % 50 == 0, F.lit(None).cast("int")).otherwise(F.when(F.col("id") % 100 == 1, 2).otherwise(1))
    df = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("v"), g.alias("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = storage.numbered(df, "v", within="g")
        assert out.columns == ["v", "g", "ordinal"]
        tasks = out.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in tasks) < 2400
        found = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 4000
    for value in (None, 1, 2):
        own = sorted((r.ordinal, r.v) for r in found if r.g == value)
        assert [n for n, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)


def test_rounds_of_components_send_no_table_to_the_driver(spark):
    from strandflow.operators import graph

    labels = storage.written(spark.range(100).selectExpr("id", "id comp_id", "id up", "id down"), "labels")
    edges = storage.written(spark.range(100).selectExpr("id src", "id dst"), "graph")
    for df in (graph.shortened(labels, edges, labels.select("id", "comp_id")), graph.pointed(labels.select("id", "comp_id"), edges, 0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
