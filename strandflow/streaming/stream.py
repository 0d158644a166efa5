"""Streaming dispatch, alignment and merge.

Reads arrive as files; each micro-batch is dispatched, aligned and merged by an index of the partitioned targets, which
is built before the first batch and joined bucket by bucket: no batch reads the targets' text or shuffles their k-mers.
All records of a read come from one row of the stream and so fall into one micro-batch: merging is an
aggregation in foreachBatch and needs neither state nor watermark. A read that no partition can hold is
sent to one in turn, as the streaming program does. Batches are written under their number, so that one
that is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import align_indexed
from ..operators.dispatch import round_robin, undispatched
from ..operators.index import TargetIndex
from ..operators.merge import streamed
from ..plans.pipeline import sent_to
from ..sources.records import fastq_records
from ..storage import written


def merge_batch(reads: DataFrame, index: TargetIndex, before: int = 0) -> tuple[DataFrame, int]:
    """One micro-batch: read_id, place, line for every read; and how many of its reads no partition can hold (`before`: of earlier batches)."""
    config, index = index.config, index.for_reads(reads)
    hits = written(sent_to(reads, index.targets, config, index), "hits")
    lost = written(undispatched(reads, hits).select("read_id"), "lost")
    turns = round_robin(lost, config.partitions, before).withColumn("part", F.col("part") - 1)
    sent = reads.join(hits.unionByName(turns.select("read_id", F.col("part").cast(hits.schema["part"].dataType))), "read_id")
    return streamed(align_indexed(config.aligner, sent, index)), lost.count()


def counted_before(spark, folder: str, number: int, name: str) -> int:
    """The sum of what batches before `number` have written of `name`."""
    if not number:
        return 0
    counts = spark.read.schema("n_reads long, n_lost long, batch int").parquet(f"{folder}-counts").where(F.col("batch") < number)
    return counts.agg(F.coalesce(F.sum(name), F.lit(0))).first()[0]


def counts_written(spark, folder: str, number: int, n_reads: int, n_lost: int) -> None:
    row = spark.range(1).select(F.lit(n_reads).cast("long").alias("n_reads"), F.lit(n_lost).cast("long").alias("n_lost"))
    row.write.mode("overwrite").parquet(f"{folder}-counts/batch={number}")


def read_batch(lines: DataFrame, folder: str, number: int) -> DataFrame:
    """The reads of a micro-batch of files (lines: file, block, value): read_id, name, seq, qual; ids go on densely where the
    batches before have ended."""
    before = counted_before(lines.sparkSession, folder, number, "n_reads")
    return fastq_records(lines).select((F.col("n") + before).alias("read_id"), "name", "seq", "qual")


def started(stream: DataFrame, each, checkpoint: str) -> None:
    """Takes all that is there of the stream, then ends."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stream(lines: DataFrame, folder: str, checkpoint: str) -> None:
    """Reads of a stream of FASTQ files (sources.records.stream_of) with dense ids, written to folder/batch=n."""

    def each(batch: DataFrame, number: int) -> None:
        reads = read_batch(batch, folder, number)
        reads.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        counts_written(batch.sparkSession, folder, number, batch.sparkSession.read.parquet(f"{folder}/batch={number}").count(), 0)

    started(lines, each, checkpoint)


def run_stream(reads: DataFrame, index: TargetIndex, folder: str, checkpoint: str) -> None:
    """Takes all that is there of the stream `reads` (read_id, name, seq; or the lines of FASTQ files, whose reads then get dense ids)
    and appends to folder/batch=n, in order of the reads' ids; then ends. The numbers of reads, and the turns of undispatched ones,
    go on over the batches: how many each had is written to folder-counts/batch=n, so that a batch that is repeated counts only
    those before it. The reader's maxFilesPerTrigger bounds a batch."""
    spark = reads.sparkSession
    files = "read_id" not in reads.columns

    def each(batch: DataFrame, number: int) -> None:
        own = written(read_batch(batch, folder, number) if files else batch, "batch")
        lines, lost = merge_batch(own, index, counted_before(spark, folder, number, "n_lost"))
        lines.orderBy("read_id", "place").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        counts_written(spark, folder, number, own.count(), lost)

    started(reads, each, checkpoint)
