"""Header lines of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import HEADER
from ..storage import numbered


def header(targets: DataFrame, only_sequences: bool = False) -> DataFrame:
    """(ord, line): format and program, then a line for each target (name, len) in order of `place`."""
    lines = numbered(targets.select("place", "name", "len"), "place", "name", name="n")
    before = 0 if only_sequences else len(HEADER)
    own = lines.select((F.col("n") + before).alias("ord"), F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("len").cast("string")).alias("line"))
    if only_sequences:
        return own
    spark = targets.sparkSession
    head = spark.range(len(HEADER)).select(F.col("id").alias("ord"), F.element_at(F.array(*map(F.lit, HEADER)), (F.col("id") + 1).cast("int")).alias("line"))
    return head.unionByName(own)
