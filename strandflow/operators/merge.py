"""The partitions' alignment records into one result.

Records: read_id, part, ord (line in the partition), the eleven fields and raw (the whole line). Within
a read their order is (part, ord). Each mode returns read_id, place (of the line within the read, from
0) and line; the order of the result is (read_id, place), but for `fast`, which gives its own ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.records import FIELDS, UNMAPPED, blanked, full
from ..functions.sequences import cigar_match_length
from ..storage import numbered
from .dispatch import unmapped_lines


def in_read() -> WindowSpec:
    return Window.partitionBy("read_id").orderBy("part", "ord")


def fast(records: DataFrame) -> DataFrame:
    """(ordinal, line): all lines, the first of each partition, then the second of each, and so on."""
    return numbered(records.select("part", "ord", F.col("raw").alias("line")), "ord", "part").select("ordinal", "line")


def mem(records: DataFrame, reads: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` mapped records of each read, blanked; else one unmapped line. reads: read_id, name."""
    mapped = records.where(F.col("flag") != UNMAPPED)
    kept = mapped.withColumn("rank", F.row_number().over(in_read())).where(F.col("rank") <= most)
    lines = kept.select("read_id", (F.col("rank") - 1).alias("place"), blanked().alias("line"))
    return lines.unionByName(without(mapped, reads))


def in_order(records: DataFrame, reads: DataFrame) -> DataFrame:
    """All mapped records of each read, whole; else one unmapped line."""
    mapped = records.where(F.col("flag") != UNMAPPED)
    lines = mapped.select("read_id", (F.row_number().over(in_read()) - 1).alias("place"), F.col("raw").alias("line"))
    return lines.unionByName(without(mapped, reads))


def without(mapped: DataFrame, reads: DataFrame, paired: bool = False) -> DataFrame:
    lost = reads.join(mapped.select("read_id").distinct(), "read_id", "left_anti")
    return unmapped_lines(lost, paired).select("read_id", F.lit(0).alias("place"), "line")


def chosen(records: DataFrame) -> DataFrame:
    """Of each read that has records: the chosen one (its fields, part, ord, raw), its matched length and `mapq_out`.

    The longest match wins, the first of equals; mapq_out is 0 if several records share it, else its own.
    A read without a mapped record has its first record and mapq_out 0. One aggregation, no window: what
    a task holds of a read is one candidate."""
    mapped = F.col("flag") != UNMAPPED
    length = F.when(mapped, cigar_match_length(F.col("cigar"))).otherwise(-1)
    rows = records.withColumn("mlen", length)
    row = F.struct(*(F.col(c) for c in (*FIELDS, "raw", "part", "ord", "mlen")))
    key = F.struct((-F.col("mlen")).alias("m"), "part", "ord")
    # The number of records of each length in a read, then the best length with its number.
    by_length = rows.groupBy("read_id", "mlen").agg(F.count("*").alias("n"), F.min_by(row, key).alias("row"))
    best = by_length.groupBy("read_id").agg(F.max_by(F.struct("n", "row"), "mlen").alias("best"))
    unique = (F.col("best.n") == 1) & (F.col("best.row.mlen") >= 0)
    return best.select("read_id", "best.row.*", F.when(unique, F.col("best.row.mapq")).otherwise(0).alias("mapq_out"))


def best(records: DataFrame, reads: DataFrame, paired: bool = False) -> DataFrame:
    """The chosen record of each read: whole, or without tags where its mapq becomes 0; else an unmapped line."""
    won = chosen(records)
    line = F.when((F.col("mapq_out") != 0) | (F.col("flag") == UNMAPPED), F.col("raw")).otherwise(full(F.lit(0)))
    return won.select("read_id", F.lit(0).alias("place"), line.alias("line")).unionByName(without(records, reads, paired))


def streamed(records: DataFrame) -> DataFrame:
    """As the streaming merger has it: the chosen record of each read, blanked, with its mapq_out."""
    return chosen(records).select("read_id", F.lit(0).alias("place"), blanked(F.col("mapq_out")).alias("line"))


def alignment_rate(records: DataFrame, reads: DataFrame) -> DataFrame:
    """One row: n_reads, n_aligned (reads whose chosen mapq is not 0) and percent."""
    n = reads.agg(F.count("*").alias("n_reads"))
    aligned = chosen(records).agg(F.count_if(F.col("mapq_out") != 0).alias("n_aligned"))
    percent = F.when(F.col("n_reads") > 0, F.col("n_aligned") * 100.0 / F.col("n_reads"))
    return n.crossJoin(aligned).withColumn("percent", F.round(percent, 4))


def merged(records: DataFrame, reads: DataFrame, mode: str, most: int = 5, paired: bool = False) -> DataFrame:
    if mode == "fast":
        return fast(records)
    if mode == "mem":
        return mem(records, reads, most)
    if mode == "ord":
        return in_order(records, reads)
    if mode == "best":
        return best(records, reads, paired)
    raise ValueError(f"no merge mode {mode!r}: fast, mem, ord or best")
