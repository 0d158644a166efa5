"""Statistics of targets: totals, k-mer counts, ranking by length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import n_kmers
from ..storage import numbered


def partition_stats(targets: DataFrame, k: int) -> DataFrame:
    """Of each part: n_targets, total_len, min_len, max_len, and the k-mers that size its Bloom filter. targets: part, len."""
    return targets.groupBy("part").agg(
        F.count("*").alias("n_targets"),
        F.sum("len").cast("long").alias("total_len"),
        F.min("len").cast("long").alias("min_len"),
        F.max("len").cast("long").alias("max_len"),
        F.sum(n_kmers(F.col("len"), k)).cast("long").alias("n_items"),
    )


def length_ranking(targets: DataFrame) -> DataFrame:
    """target_id, len and rank from 1 by length, longest first; equal lengths by id."""
    return numbered(targets.select("target_id", "len"), F.col("len").desc(), F.col("target_id"), name="place").select("target_id", "len", (F.col("place") + 1).alias("rank"))


def run_metadata(targets: DataFrame, reads: DataFrame) -> DataFrame:
    """One row: n_targets, n_reads; an error where one is zero."""
    counts = targets.agg(F.count("*").alias("n_targets")).crossJoin(reads.agg(F.count("*").alias("n_reads")))
    empty = F.raise_error("a run needs at least one target and one read").cast("long")
    return counts.select(F.when((F.col("n_targets") == 0) | (F.col("n_reads") == 0), empty).otherwise(F.col("n_targets")).alias("n_targets"), "n_reads")
