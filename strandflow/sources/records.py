"""Four-line records (FASTQ) from the splits of text files, in batch and in streams.

Each split finds by itself where its first record begins: a line with @ that a line with + follows two further on; no
sequence begins with either, so that one whole record tells. Records that lie in a split are put together as its lines
come; only the pieces before a split's first and behind its last record, a few lines for each split, are shuffled and
joined file by file. A record's number is its place in its split and the records of the splits before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written

#: Lines of a split by which its records' phase is found: one whole record behind any beginning.
PROBED = 8
ROUND = 1 << 14
PARTS = "file string, block long, at long, lines array<string>, whole boolean"


def text_lines(text: DataFrame) -> DataFrame:
    """(file, block, value) of a text source, batch or stream: block is where the line's split begins."""
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))


def phase_of(lines: list[str]) -> int | None:
    """How many lines stand before the first record; None if too few lines tell."""
    for p in range(min(4, len(lines))):
        if len(lines) > p + 2 and lines[p].startswith("@") and lines[p + 2].startswith("+"):
            return p
    return None


def parts(lines: DataFrame) -> DataFrame:
    """(file, block, at, lines, whole): the records within splits, `at` in order, and the pieces before (at -1) and behind them.

    lines: file, block, value; the rows of a split follow each other in its task."""

    def run(batches):
        out: list[tuple] = []
        split, held, at = None, [], None  # at: records so far, None while the phase is unknown

        def flushed():
            nonlocal out
            made, out = out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()))], names=["file", "block", "at", "lines", "whole"])

        def settle(final: bool):
            """Takes the records that the held lines hold."""
            nonlocal held, at
            if at is None and (final or len(held) >= PROBED):
                phase = 0 if split[1] == 0 else phase_of(held)
                if phase is None and not final:
                    raise ValueError(f"no record of four lines begins near byte {split[1]} of {split[0]}")
                if phase is not None:
                    if phase:
                        out.append((*split, -1, held[:phase], False))
                    held, at = held[phase:], 0
            if at is not None:
                n = len(held) // 4 * 4
                for i in range(0, n, 4):
                    out.append((*split, at, held[i : i + 4], True))
                    at += 1
                held = held[n:]
            if final and held:
                out.append((*split, 1 << 40, held, False))
                held = []

        for batch in batches:
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != split:
                    if split is not None:
                        settle(True)
                    split, held, at = (file, block), [], None
                held.append(value)
                if len(held) >= ROUND:
                    settle(False)
                    yield flushed()
            if split is not None and len(held) >= PROBED:
                settle(False)
            if out:
                yield flushed()
        if split is not None:
            settle(True)
        if out:
            yield flushed()

    return lines.mapInArrow(run, PARTS)


def joined(key, table):
    """The records that the pieces of one file make: each belongs to the split in which it begins."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "at", "lines")), strict=True))
    out, pending, start = [], [], 0
    for block, _, lines in rows:
        for line in lines:
            if not pending:
                start = block
            pending.append(line)
            if len(pending) == 4:
                out.append((start, (1 << 40) + len(out), pending))
                pending = []
    if pending:
        raise ValueError(f"a record lacks lines: {key[0].as_py()}")
    return pa.table({"file": pa.array([key[0].as_py()] * len(out), pa.string()), "block": pa.array([r[0] for r in out], pa.int64()), "at": pa.array([r[1] for r in out], pa.int64()), "lines": pa.array([r[2] for r in out], pa.list_(pa.string())), "whole": pa.array([True] * len(out), pa.bool_())})


def fastq_records(lines: DataFrame) -> DataFrame:
    """n (record in the files, in order of their names, from 0), name, seq (upper-cased), qual. The text is read once: its
    records are written and then numbered."""
    found = written(parts(lines), "record-parts")
    both = found.where("whole").unionByName(found.where("not whole").groupBy("file").applyInArrow(joined, PARTS))
    bad = ~F.col("lines")[0].startswith("@") | ~F.col("lines")[2].startswith("+")
    head = F.when(bad, F.raise_error(F.concat(F.lit("no record of four lines: "), F.col("file"))).cast("string")).otherwise(F.col("lines")[0])
    # Of a split the records in order; only what pieces made comes behind those that are counted by their place already.
    splits = both.groupBy("file", "block").agg(F.count_if(F.col("at") < 1 << 40).alias("inner"), F.count_if(F.col("at") >= 1 << 40).alias("more"), F.min(F.when(F.col("at") >= 1 << 40, F.col("at"))).alias("first"))
    before = F.sum(F.col("inner") + F.col("more")).over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    splits = written(splits.withColumn("before", F.coalesce(before, F.lit(0))), "record-splits")  # a row for each split
    place = F.when(F.col("at") < 1 << 40, F.col("at")).otherwise(F.col("inner") + F.col("at") - F.col("first"))
    rows = both.join(splits, ["file", "block"])
    return rows.select((F.col("before") + place).alias("n"), F.substring(head, 2, 1 << 30).alias("name"), F.upper(F.col("lines")[1]).alias("seq"), F.col("lines")[3].alias("qual"))


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The lines of the files in a folder as a stream, at most so many files in a micro-batch (a file is never divided)."""
    return text_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))
