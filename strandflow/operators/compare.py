"""What differs between two results, by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import FIELDS, REVERSE, UNMAPPED, tabbed


def comparable(records: DataFrame) -> Column:
    """The record's line; for unmapped reads without what programs set as they like."""
    blank = lambda c: F.when(F.col("flag") == UNMAPPED, F.lit("*")).otherwise(F.col(c).cast("string"))
    return tabbed(*(blank(c) if c in ("rnext", "seq", "qual") else F.col(c) for c in FIELDS))


def kind_of() -> Column:
    """The kind of difference between columns a_* (expected) and b_* (found); null where there is none that counts."""
    a, b = F.col("a_mapq"), F.col("b_mapq")
    flag = lambda side, bit: F.col(f"{side}_flag").bitwiseAND(bit) != 0
    same_mapq = (
        F.when(F.col("a_cigar") != F.col("b_cigar"), "diff_read_frags")
        .when(flag("a", REVERSE) != flag("b", REVERSE), "diff_dir")
        .otherwise("unclassified")
    )
    return (
        F.when(F.col("a_line") == F.col("b_line"), None)
        .when((a == 0) & (b != 0), "mapq_not_zero")
        .when((a != 0) & (b == 0), "mapq_zero")
        .when((a > 0) & (a == b), same_mapq)
        .when(~flag("a", UNMAPPED) & flag("b", UNMAPPED), "bloom_filter_miss")
        .when((a > 0) | (b > 0), "unclassified")
    )


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, n) of the reads whose records differ; both sides: one record for each read_id."""
    side = lambda df, p: df.select("read_id", comparable(df).alias(f"{p}_line"), *(F.col(c).alias(f"{p}_{c}") for c in ("flag", "mapq", "cigar")))
    both = side(expected, "a").join(side(found, "b"), "read_id").withColumn("kind", kind_of())
    return both.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, repeats counted, with `side`."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
