"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitioned(records: DataFrame, folder: str, compression: str = "none", mode: str = "error") -> None:
    """Dispatched records (part, record), a folder for each partition; the rows of a task go to one file of each."""
    records.select("part", F.col("record").alias("value")).write.mode(mode).partitionBy("part").option("compression", compression).text(folder)


def fasta(targets: DataFrame, folder: str, compression: str = "none") -> None:
    """Targets (part, header, seq), a folder for each partition."""
    partitioned(targets.select("part", F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq")).alias("record")), folder, compression)


def lines_in_order(lines: DataFrame, folder: str, *order: str, compression: str = "none", one_file: bool = False, mode: str = "error") -> None:
    """Lines (line) in order over the files' names; one_file only where the result may pass through one task."""
    rows = lines.repartition(1).sortWithinPartitions(*order) if one_file else lines.orderBy(*order)
    rows.select(F.col("line").alias("value")).write.mode(mode).option("compression", compression).text(folder)


def sam(header: DataFrame, merged: DataFrame, folder: str, compression: str = "none", mode: str = "error") -> None:
    """Header lines (ord, line), then merged lines (read_id, place, line)."""
    head = header.select(F.lit(0).alias("body"), F.col("ord").alias("a"), F.lit(0).cast("long").alias("b"), "line")
    body = merged.select(F.lit(1).alias("body"), F.col("read_id").cast("long").alias("a"), F.col("place").cast("long").alias("b"), "line")
    lines_in_order(head.unionByName(body), folder, "body", "a", "b", compression=compression, mode=mode)
