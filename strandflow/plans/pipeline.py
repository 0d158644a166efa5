"""Partition, dispatch, align and merge as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AlignConfig
from ..functions.kmers import MOST_K
from ..functions.sequences import n_kmers
from ..operators import bloom
from ..operators.align import align, align_indexed, seeded
from ..operators.dispatch import BROADCAST_KMERS, exact, rendered
from ..operators.header import header
from ..operators.index import TargetIndex, opened, opened_or_built, typed
from ..operators.merge import merged
from ..operators.packing import pack_components, with_parts
from ..operators.stats import run_metadata
from ..sources import writers
from ..storage import digest, stage, written


def partitioned(targets: DataFrame, config: AlignConfig, edges: DataFrame | None = None) -> DataFrame:
    """Targets (target_id, name, seq) with their part; with a graph's edges its components stay together.

    Vertices that the graph has and the targets lack take no room; targets that fit nowhere are left out."""
    if edges is None:
        return with_parts(targets, config.partitions, config.fallback)
    sizes = targets.select(F.col("target_id").alias("id"), F.length("seq").cast("long").alias("len"))
    parts = pack_components(sizes, edges, config.partitions, config.fallback)
    parts = written(parts.where("part is not null"), "parts")
    return targets.join(parts.withColumnRenamed("id", "target_id"), "target_id")


def sent_to(reads: DataFrame, targets: DataFrame, config: AlignConfig, index: TargetIndex | None = None) -> DataFrame:
    """(read_id, part) by the run's way of dispatching; of a read by Bloom filters only what its k-mers confirm."""
    k, step = config.bmer, config.step
    if index and config.window:
        return seeded(reads, index.places, k, config.alen)
    keys = index.keys if index else None
    if config.dispatch != "bloom":
        return exact(targets, reads, k, step, keys, config.window)
    blocks = index.blocks if index else bloom.n_blocks(targets, k, config.ibits)
    found = bloom.probe(index.bank, reads, k, step, blocks, config.nhash) if index else bloom.candidates(targets, reads, k, step, blocks, config.nhash)
    found = written(found, "candidates")
    return bloom.verified(targets, reads, found, k, step, keys)


def dispatched(reads: DataFrame, targets: DataFrame, config: AlignConfig, index: TargetIndex | None = None) -> DataFrame:
    """Reads with each part they go to."""
    return reads.join(written(sent_to(reads, targets, config, index), "hits"), "read_id")


def aligned(reads: DataFrame, targets: DataFrame, config: AlignConfig, index: TargetIndex | None = None) -> DataFrame:
    """Records of all partitions for dispatched reads; targets have their part."""
    if index:
        return align_indexed(config.aligner, reads, index)
    return align(config.aligner, reads, targets, k=config.bmer, alen=config.alen)


def run(reads: DataFrame, targets: DataFrame | None, config: AlignConfig, edges: DataFrame | None = None, index: TargetIndex | None = None) -> DataFrame:
    """read_id, place, line (mode fast: ordinal, line). reads: read_id, name, seq; targets: target_id, name, seq.

    Targets with their parts are written once; dispatch and alignment read them from there. With an index (of targets
    partitioned before) no target is partitioned, and no k-mer of a target made, again."""
    index = index and index.for_reads(reads)
    own = index.targets if index else written(partitioned(targets, config, edges), "targets")
    records = written(aligned(dispatched(reads, own, config, index), own, config, index), "records")
    return merged(records, reads, config.merge_mode, config.max_rec, config.paired)


def indexed(targets: DataFrame, config: AlignConfig, folder: str, edges: DataFrame | None = None) -> TargetIndex:
    """The index in the folder of these targets (target_id, name, seq), partitioned; built there if it is of others, of other
    settings, or not finished."""
    return opened_or_built(targets.sparkSession, folder, config, source_of(targets, config, edges), lambda: partitioned(targets, config, edges))


def source_of(targets: DataFrame, config: AlignConfig, edges: DataFrame | None = None) -> str:
    """The digest of what the targets (target_id, name, seq) with their parts are made of."""
    return digest(targets, "target_id", "name", "seq") + (" " + digest(edges, "src", "dst") if edges is not None else "") + " " + config.fallback


def few(reads: DataFrame, config: AlignConfig) -> bool:
    """Whether all that the reads (read_id, seq) may ask of the targets goes to all tasks, in dispatch as in the built-in aligner: the
    k-mers of both strands for each partition, or all bits of each."""
    n = reads.agg(F.sum(n_kmers(F.length("seq"), min(config.bmer, MOST_K)))).first()[0] or 0
    return n * max(2 * config.partitions, config.nhash) <= BROADCAST_KMERS


def run_to_files(reads: DataFrame, targets: DataFrame, config: AlignConfig, folder: str, edges: DataFrame | None = None, compression: str = "none") -> None:
    """The run as files: folder/counts (numbers of targets and reads; an error where one is zero), folder/dispatched (reads
    of each part as FASTA, or FASTQ with keep_qual), folder/result (header, then the merged lines in order).

    folder/index and folder/stages keep what was computed, under digests of inputs and settings: a run that died goes on where
    it was, and one on the same inputs makes no k-mer again. An index takes several times the targets' room, and more while it
    is built: few reads look through the targets instead, but for dispatch by minimisers, which goes by an index's places. One that
    is in folder/index already is used."""
    spark = reads.sparkSession
    run_metadata(targets, reads).write.mode("overwrite").json(f"{folder}/counts")
    source = source_of(targets, config, edges)
    index = opened(spark, f"{folder}/index", config, source)
    if not index and (config.window or not few(reads, config)):
        index = opened_or_built(spark, f"{folder}/index", config, source, lambda: partitioned(targets, config, edges))
    own = index.targets if index else stage(spark, f"{folder}/stages", "targets", f"{source} {config.partitions}", lambda: typed(partitioned(targets, config, edges)))
    columns = [c for c in ("read_id", "name", "seq", "qual") if c in reads.columns]
    key = f"{source} {config} {digest(reads, *columns)}"
    hits = stage(spark, f"{folder}/stages", "hits", key, lambda: sent_to(reads, own, config, index))
    writers.partitioned(rendered(reads, hits, config.keep_qual), f"{folder}/dispatched", compression, mode="overwrite")
    records = stage(spark, f"{folder}/stages", "records", key, lambda: aligned(reads.join(hits, "read_id"), own, config, index))
    lines = merged(records, reads, config.merge_mode, config.max_rec, config.paired)
    if config.merge_mode == "fast":
        lines = lines.select(F.col("ordinal").alias("read_id"), F.lit(0).alias("place"), "line")
    head = header(targets.select(F.col("target_id").alias("place"), "name", F.length("seq").alias("len")))
    writers.sam(head, lines, f"{folder}/result", compression, mode="overwrite")
