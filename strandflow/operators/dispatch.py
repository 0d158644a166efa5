"""Reads to those partitions of targets that can hold a match: exact, or by Bloom filters and then exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import MOST_K, Wanted, anchors, bundles, core_length, distinct, key_pieces, minimiser_pieces, pieces, wanted_keys
from ..functions.sequences import mate_suffix
from ..storage import numbered, written

#: Sampled k-mers of reads up to which they are sent to every executor (16 bytes each); beyond, both sides are shuffled.
BROADCAST_KMERS = 2_000_000


def found_keys(seq: bytes, k: int, step: int = 1, window: int = 0):
    """Keys of the k-mers at every step-th place, piece by piece; with a window of the least k-mer of each window instead."""
    return minimiser_pieces(seq, k, window) if window else key_pieces(seq, k, step)


def keys_of(rows: DataFrame, own: str, k: int, step: int = 1, window: int = 0) -> DataFrame:
    """(own, key) for the keys of each row's k-mers, distinct in each piece of a sequence; rows: own (a long or int), seq."""
    kind = rows.schema[own].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            held = 0
            for i, seq in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                for found in found_keys(seq, k, step, window) if seq else ():
                    keys.append(distinct(found))
                    ids.append(np.full(len(keys[-1]), i))
                    held += len(keys[-1])
                    if held > 1 << 20:
                        yield rows_of(batch, ids, keys)
                        ids, keys, held = [], [], 0
            if keys:
                yield rows_of(batch, ids, keys)

    def rows_of(batch, ids, keys):
        at = pa.array(np.concatenate(ids))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(keys).view(np.int64))], names=[own, "key"])

    return rows.select(own, "seq").mapInArrow(run, f"{own} {kind}, key long")


#: What an anchor (see kmers.anchors) has besides its key.
BESIDE = {"before": "long", "behind": "long", "n_before": "tinyint", "n_behind": "tinyint"}


def anchors_of(rows: DataFrame, own: str, k: int, step: int = 0) -> DataFrame:
    """(own, key, BESIDE): the anchors of each row's k-mers, or with a step those of the k-mers at every step-th place."""
    kind = rows.schema[own].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, found, held = [], [], 0
            for i, seq in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                for begin, piece in pieces(seq or b"", k):
                    found.append(anchors(piece, k, step, begin))
                    at.append(np.full(len(found[-1][0]), i))
                    held += len(at[-1])
                    if held > 1 << 18:
                        yield rows_of(batch, at, found)
                        at, found, held = [], [], 0
            if held:
                yield rows_of(batch, at, found)

    def rows_of(batch, at, found):
        key, *beside = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(key.view(np.int64)), *map(pa.array, beside)], names=[own, "key", *BESIDE])

    return rows.select(own, "seq").mapInArrow(run, f"{own} {kind}, key long, " + ", ".join(f"{name} {kind}" for name, kind in BESIDE.items()))


def at_anchors(there: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """Rows of the targets' anchors (part, key, BESIDE) with those of the reads' k-mers (read_id, key, BESIDE) that lie in the bases
    around them; by: what else must be equal. A few wanted ones are sent to all tasks."""
    asked = wanted.withColumnsRenamed({name: f"read_{name}" for name in BESIDE})
    asked = F.broadcast(asked) if wanted.count() <= BROADCAST_KMERS else asked
    inside = F.lit(True)
    for side in ("before", "behind"):
        n = F.col(f"read_n_{side}").cast("int")
        own = F.expr(f"shiftleft(1L, 2 * cast(read_n_{side} as int)) - 1")
        inside = inside & (F.col(f"n_{side}") >= n) & (F.col(side).bitwiseAND(own) == F.col(f"read_{side}"))
    return there.join(asked, ["key", *by]).where(inside)


def sorted_keys(wanted: DataFrame, column: str = "key") -> np.ndarray:
    """The column of longs, at most some BROADCAST_KMERS, as a sorted array in the driver."""
    return distinct(np.asarray(wanted.select(column).distinct().toArrow().column(column).combine_chunks(), np.int64).view(np.uint64))


def near(rows: DataFrame, own: str, k: int, wanted: DataFrame, window: int = 0, cores: DataFrame | None = None) -> DataFrame:
    """keys_of the rows, only those among the wanted (key), of which there are at most BROADCAST_KMERS: they are
    sent to all tasks as one sorted array, so that no other key leaves the kernel. cores: keys of the middles (kmers.core_length)
    of the wanted k-mers, needed where k is more than MOST_K and there is no window."""
    kind = rows.schema[own].dataType.simpleString()
    keys = sorted_keys(wanted)
    middles = keys if k <= MOST_K else sorted_keys(cores) if cores is not None else keys[:0]
    sent = rows.sparkSession.sparkContext.broadcast((keys, middles))

    def run(batches):
        wanted, cores = map(Wanted, sent.value)
        for batch in batches:
            ids, found = [], []
            seqs = (seq or b"" for seq in batch.column(1).cast(pa.binary()).to_pylist())
            if not window:
                for bundle in bundles(seqs, k):
                    hit, piece = wanted_keys(bundle, k, wanted, cores)
                    at = bundle.own[piece]
                    order = np.lexsort((hit, at))
                    hit, at = hit[order], at[order]
                    once = np.append(True, (hit[1:] != hit[:-1]) | (at[1:] != at[:-1])) if len(hit) else np.zeros(0, bool)
                    found.append(hit[once])
                    ids.append(at[once])
            else:
                for i, seq in enumerate(seqs):
                    for piece in minimiser_pieces(seq, k, window):
                        found.append(distinct(piece[wanted.among(piece)]))
                        ids.append(np.full(len(found[-1]), i))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(found).view(np.int64))], names=[own, "key"])

    return rows.select(own, "seq").mapInArrow(run, f"{own} {kind}, key long")


def cores_of(reads: DataFrame, k: int, step: int) -> DataFrame:
    """(read_id, key): the middles of the reads' k-mers at every step-th place (and of what would be one behind the last)."""
    core = core_length(k)
    return keys_of(reads.select("read_id", F.expr(f"substring(seq, {(k - core) // 2 + 1})").alias("seq")), "read_id", core, step)


def exact(targets: DataFrame, reads: DataFrame, k: int, step: int, keys: DataFrame | None = None, window: int = 0) -> DataFrame:
    """(read_id, part), distinct: some sampled k-mer of the read is in a target of the partition.

    With a window the k-mers are the least ones of each window of so many k-mers, of the reads and of the targets alike:
    some 2 / (window + 1) of all. A read that shares window + k - 1 bases with a target is then sent to its partition, one
    that shares less may be. targets: part, seq; reads: read_id, seq; keys: where an index has them, the targets' anchors
    (part, key, BESIDE); an index has no minimisers (see align.seeded)."""
    if keys is not None:
        return at_anchors(keys, written(anchors_of(reads, "read_id", k, step), "read-kmers")).select("read_id", "part").distinct()
    wanted = written(keys_of(reads, "read_id", k, step, window), "read-kmers")
    if wanted.count() <= BROADCAST_KMERS:
        # The k-mers of the targets are neither shuffled nor kept.
        cores = cores_of(reads, k, step) if k > MOST_K and not window else None
        there = near(targets, "part", k, wanted, window, cores)
        return there.join(F.broadcast(wanted), "key").select("read_id", "part").distinct()
    # A k-mer common to many targets is one row for each partition before it meets the reads.
    there = keys_of(targets, "part", k, window=window).distinct()
    return there.join(wanted, "key").select("read_id", "part").distinct()


def undispatched(reads: DataFrame, dispatched: DataFrame) -> DataFrame:
    return reads.join(dispatched.select("read_id").distinct(), "read_id", "left_anti")


def round_robin(lost: DataFrame, parts: int, before: int = 0) -> DataFrame:
    """(read_id, part): the n-th undispatched read (from 1, by id, behind `before` others) goes to n modulo parts, plus 1."""
    placed = numbered(lost.select("read_id"), "read_id", name="n")
    return placed.select("read_id", (F.pmod(F.col("n") + 1 + before, F.lit(parts)) + 1).cast("int").alias("part"))


def rendered(reads: DataFrame, dispatched: DataFrame, keep_qual: bool = False) -> DataFrame:
    """(read_id, part, record): FASTA, or FASTQ with keep_qual; the read id goes before the header.

    reads: read_id, name, seq[, qual]."""
    head = F.concat(F.col("read_id").cast("string"), F.lit(":"), F.col("name"))
    if keep_qual:
        record = F.concat(F.lit("@"), head, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    else:
        record = F.concat(F.lit(">"), head, F.lit("\n"), F.col("seq"))
    return dispatched.join(reads, "read_id").select("read_id", "part", record.alias("record"))


def unmapped_lines(reads: DataFrame, paired: bool = False) -> DataFrame:
    """(read_id, line): the unmapped record of each read, by its own name (with its mate's number if paired)."""
    name = F.regexp_extract("name", r"^\s*(\S+)", 1)
    name = F.concat(name, mate_suffix(F.col("read_id"))) if paired else name
    return reads.select("read_id", F.concat(name, F.lit("\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*")).alias("line"))
