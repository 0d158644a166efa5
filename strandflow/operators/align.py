"""Aligners by name, and the one built in: longest exact match.

An aligner takes dispatched reads (read_id, part, name, seq, qual) and targets (part, target_id, name,
seq) and returns records, one for each read and partition it was sent to. The built-in one joins the
k-mers of both strands of the reads with those at every n-th place of the targets, n being such that
no match of the least length is without one. Each k-mer brings the n - 1 bases before and behind it, so
that a run of hits on one diagonal, n places apart, ends where the bases differ, without another look
at the text. The longest run is reported; among equals the smallest target, forward before reverse, then
the first place, with mapq 0 (else 60). Longer k-mers than a code holds are seeded by their first MOST_K
bases, which gives the same runs. Programs outside run through run_program on each partition; with
`adapter` their records become an aligner by name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kmers import CODE, COMPLEMENT, MOST_K, NORMAL, PIECE, Wanted, around, bundles, codes_at, whole_at
from ..functions.records import FIELDS, parsed, tabbed
from ..storage import written
from .dispatch import BROADCAST_KMERS, sorted_keys

BUILT_IN = "longest-exact-match"
ALIGNERS: dict[str, Callable[..., DataFrame]] = {}
#: What a seed has besides its sequence and strand.
SEED = {"position": "int", "code": "long", "before": "long", "behind": "long", "n_before": "tinyint", "n_behind": "tinyint"}


def aligner(name: str):
    def add(function):
        ALIGNERS[name] = function
        return function

    return add


def align(name: str, reads: DataFrame, targets: DataFrame, **options) -> DataFrame:
    if name not in ALIGNERS:
        raise ValueError(f"no aligner {name!r}: {', '.join(sorted(ALIGNERS))}")
    return ALIGNERS[name](reads, targets, **options)


def align_indexed(name: str, reads: DataFrame, index) -> DataFrame:
    """The same with a TargetIndex: the built-in aligner reads its places and no text, programs outside its targets."""
    own = {"places": index.places} if name == BUILT_IN else {}
    return align(name, reads, index.targets, k=index.config.bmer, alen=index.config.alen, **own)


def seeds(k: int, alen: int) -> tuple[int, int]:
    """Length of the seeds, and the distance of those of targets: a match of alen bases has one, and neighbours touch."""
    seed = min(k, MOST_K)
    return seed, min(alen - seed + 1, seed)


def positioned(rows: DataFrame, columns: list[str], k: int, apart: int, both_strands: bool, wanted: DataFrame | None = None) -> DataFrame:
    """The columns, strand (0; 1: reverse complement), position and code of every k-mer of bases in seq, and the apart - 1
    bases around it (before, behind, n_before, n_behind: see kmers.around); of one strand alone those at multiples of apart.
    wanted: with it only those among these codes, at most some BROADCAST_KMERS, which are sent to all tasks."""
    kept = rows.select(*columns, "seq")
    sent = None if wanted is None else rows.sparkSession.sparkContext.broadcast(sorted_keys(wanted, "code"))
    strands, step = 1 + both_strands, 1 if both_strands else apart

    def run(batches):
        own = Wanted(sent.value) if sent else None
        for batch in batches:
            for bundle in bundles(oriented(batch.column(len(columns)).cast(pa.binary()).to_pylist()), k, apart - 1, PIECE):
                base = CODE[np.frombuffer(bundle.text, np.uint8)]
                at, piece = bundle.places(step)
                whole = whole_at(base, at, k)
                at, piece = at[whole], piece[whole]
                code = codes_at(base, at, k)
                if own:
                    hit = own.among(code)
                    at, piece, code = at[hit], piece[hit], code[hit]
                if len(at):
                    row, strand = np.divmod(bundle.own[piece], strands)
                    seed = ((at + bundle.shift[piece]).astype(np.int32), code.view(np.int64), *around(base, at, k, apart - 1))
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(row)) for j in range(len(columns))), pa.array(strand.astype(np.int32)), *map(pa.array, seed)], names=[*columns, "strand", *SEED])

    def oriented(seqs):
        for seq in seqs:
            yield seq or b""
            if both_strands:
                yield (seq or b"").upper().translate(NORMAL).translate(COMPLEMENT)[::-1]

    ddl = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in columns)
    return kept.mapInArrow(run, f"{ddl}, strand int, " + ", ".join(f"{name} {kind}" for name, kind in SEED.items()))


def seeded(reads: DataFrame, places: DataFrame, k: int, alen: int) -> DataFrame:
    """(read_id, part), distinct: some seed of the read is among the places (part, code, ...) of an index. A read that shares
    alen bases with a target is sent to its partition, one that shares less may be."""
    own = positioned(reads.select("read_id", "seq"), ["read_id"], *seeds(k, alen), True)
    wanted = written(own.select("read_id", "code").distinct(), "read-seeds")
    there = places.select("part", "code")
    if wanted.count() <= BROADCAST_KMERS:
        # A seed that is frequent in the targets is one row for each partition before it meets the reads.
        there = there.join(F.broadcast(wanted.select("code").distinct()), "code", "left_semi").distinct()
        return there.join(F.broadcast(wanted), "code").select("read_id", "part").distinct()
    # Both sides by part and code, as the places are dealt already.
    asked = wanted.crossJoin(F.broadcast(places.select("part").distinct()))
    return there.distinct().join(asked, ["part", "code"]).select("read_id", "part").distinct()


def alike(here: str, there: str, n_here: str, n_there: str) -> Column:
    """How many bases beside two seeds are equal: up to the first bit that differs, or the end of either's."""
    differ = F.col(here).bitwiseXOR(F.col(there))
    # All lower bits than the lowest that is set; all bits if none is.
    return F.least(F.shiftright(F.bit_count(differ.bitwiseAND(-differ) - 1), 1), F.col(n_here).cast("int"), F.col(n_there).cast("int"))


def matches(reads: DataFrame, targets: DataFrame, k: int, places: DataFrame | None = None, alen: int | None = None) -> DataFrame:
    """Maximal runs of alen (k, if not given) or more equal bases: read_id, part, target_id, strand, read_at, target_at, length.

    Reads meet the seeds only of the partitions that they were sent to. places: the targets' seeds (part, target_id and
    those columns of SEED), made with the same k and alen, where an index has them."""
    alen = alen or k
    seed, apart = seeds(k, alen)
    own = positioned(reads.select("read_id", "seq").dropDuplicates(["read_id"]), ["read_id"], seed, apart, True)
    own = own.withColumnsRenamed({name: f"read_{name}" for name in SEED if name != "code"})
    wanted = written(own.join(reads.select("read_id", "part").distinct(), "read_id"), "seeds")
    small = wanted.count() <= BROADCAST_KMERS
    if places is None:
        # Few seeds of reads go to all tasks, and of the targets' no others leave the kernel.
        places = positioned(targets, ["part", "target_id"], seed, apart, False, wanted if small else None).drop("strand")
    there = places.withColumnRenamed("position", "target_position")
    hits = there.join(F.broadcast(wanted) if small else wanted, ["part", "code"])
    line = ["read_id", "part", "target_id", "strand", "diagonal"]
    sides = [alike(side, f"read_{side}", f"n_{side}", f"read_n_{side}") for side in ("before", "behind")]
    hits = hits.select("read_id", "part", "target_id", "strand", "target_position", (F.col("target_position") - F.col("read_position")).alias("diagonal"), *(n.alias(side) for n, side in zip(sides, ("left", "right"), strict=True)))
    # A hit that ends on both sides before another could follow is a whole run: short ones go before they are shuffled.
    open_end = (F.col("left") == apart - 1) | (F.col("right") == apart - 1)
    hits = hits.where(open_end | (F.col("left") + F.col("right") + seed >= alen))
    place = F.row_number().over(Window.partitionBy(*line).orderBy("target_position"))
    runs = hits.withColumn("run", F.expr(f"target_position div {apart}") - place).groupBy(*line, "run")
    found = runs.agg(F.min(F.col("target_position") - F.col("left")).alias("target_at"), F.max(F.col("target_position") + seed + F.col("right")).alias("end"))
    found = found.select("read_id", "part", "target_id", "strand", (F.col("target_at") - F.col("diagonal")).alias("read_at"), "target_at", (F.col("end") - F.col("target_at")).alias("length"))
    return found.where(F.col("length") >= alen)


@aligner(BUILT_IN)
def longest_exact_match(reads: DataFrame, targets: DataFrame, k: int, alen: int, places: DataFrame | None = None) -> DataFrame:
    """Records of every dispatched read; flag 4 where no match has alen bases."""
    found = matches(reads, targets, k, places, alen)
    key = F.struct((-F.col("length")).alias("l"), "target_id", "strand", "target_at", "read_at")
    by_length = found.groupBy("read_id", "part", "length").agg(F.count("*").alias("n"), F.min_by(F.struct("target_id", "strand", "read_at", "target_at", "length"), key).alias("row"))
    best = by_length.groupBy("read_id", "part").agg(F.max_by(F.struct("n", "row"), "length").alias("best"))
    names = targets.select("part", "target_id", F.col("name").alias("target_name"))
    placed = best.select("read_id", "part", "best.n", "best.row.*").join(names, ["part", "target_id"])
    rows = reads.select("read_id", "part", "name", "seq").join(placed, ["read_id", "part"], "left")
    mapped = F.col("length").isNotNull()
    after = F.length("seq") - F.col("read_at") - F.col("length")
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    cigar = F.concat(clip(F.col("read_at")), F.col("length").cast("string"), F.lit("M"), clip(after))
    out = rows.select(
        "read_id",
        "part",
        F.col("read_id").alias("ord"),
        F.regexp_extract("name", r"^\s*(\S+)", 1).alias("qname"),
        F.when(mapped, F.col("strand") * 16).otherwise(4).alias("flag"),
        F.coalesce("target_name", F.lit("*")).alias("rname"),
        F.coalesce(F.col("target_at") + 1, F.lit(0)).alias("pos"),
        F.when(mapped & (F.col("n") == 1), 60).otherwise(0).alias("mapq"),
        F.coalesce(cigar, F.lit("*")).alias("cigar"),
        F.lit("*").alias("rnext"),
        F.lit(0).alias("pnext"),
        F.lit(0).alias("tlen"),
        F.lit("*").alias("seq"),
        F.lit("*").alias("qual"),
    )
    return out.withColumn("raw", tabbed(*(F.col(c) for c in FIELDS)))


def run_program(reads: DataFrame, targets: DataFrame, command: list[str]) -> DataFrame:
    """Lines (part, ord, value) of a program outside, run for each partition.

    {reads} and {targets} in the command become the names of FASTA files in the task's own folder; it
    writes records to its standard output, which are passed on as they come. A failure of the program is
    one of the task. Rows come to the task sorted and go to the files batch by batch."""
    body = lambda head: F.concat(F.lit(">"), head, F.lit("\n"), F.col("seq"))
    sent = reads.select("part", F.lit(1).alias("file"), F.col("read_id").cast("long").alias("place"), body(F.concat(F.col("read_id").cast("string"), F.lit(":"), F.col("name"))).alias("text"))
    there = targets.select("part", F.lit(0).alias("file"), F.col("target_id").cast("long").alias("place"), body(F.col("name")).alias("text"))
    rows = there.unionByName(sent).repartition("part").sortWithinPartitions("part", "file", "place")

    def run(batches):
        import subprocess
        import tempfile

        def finish(part, folder, files, seen):
            for f in files:
                f.close()
            if not all(seen):
                return
            names = {"targets": files[0].name, "reads": files[1].name}
            with open(f"{folder.name}/errors", "w+") as errors, subprocess.Popen([c.format(**names) for c in command], stdout=subprocess.PIPE, stderr=errors, text=True) as program:
                lines, ordinal = [], 0
                for line in program.stdout:
                    line = line.rstrip("\n")
                    if line and not line.startswith("@"):
                        lines.append(line)
                    if len(lines) == 8192:
                        yield batch_of(part, ordinal, lines)
                        ordinal, lines = ordinal + len(lines), []
                if lines:
                    yield batch_of(part, ordinal, lines)
                program.wait()
                if program.returncode:
                    errors.seek(0)
                    raise RuntimeError(f"{command[0]} failed on partition {part}: {errors.read()[-500:]}")

        def batch_of(part, ordinal, lines):
            return pa.RecordBatch.from_arrays([pa.array([part] * len(lines), pa.int32()), pa.array(range(ordinal, ordinal + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["part", "ord", "value"])

        current, folder, files, seen = None, None, [], [False, False]
        for batch in batches:
            for part, file, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if part != current:
                    if folder:
                        yield from finish(current, folder, files, seen)
                        folder.cleanup()
                    current, folder, seen = part, tempfile.TemporaryDirectory(), [False, False]
                    files = [open(f"{folder.name}/{n}.fa", "w") for n in ("targets", "reads")]  # noqa: SIM115
                files[file].write(text + "\n")
                seen[file] = True
        if folder:
            yield from finish(current, folder, files, seen)
            folder.cleanup()

    return rows.select(F.col("part").cast("int").alias("part"), "file", "place", "text").mapInArrow(run, "part int, ord long, value string")


def adapter(name: str, command: list[str]) -> None:
    """Registers a program as an aligner: its lines are parsed into records; {k} and {alen} in the command are the run's."""

    @aligner(name)
    def run(reads: DataFrame, targets: DataFrame, k: int, alen: int) -> DataFrame:
        lines = run_program(reads, targets, [c.replace("{k}", str(k)).replace("{alen}", str(alen)) for c in command])
        return parsed(lines, F.col("part")).drop("tags")


#: Commands of aligners by name, as their manuals have them; each indexes the partition's targets and then maps.
PROGRAMS = {
    "bwa-mem": ["sh", "-c", "bwa index {targets} >&2 && bwa mem -k {alen} {targets} {reads}"],
    "bowtie2": ["sh", "-c", "bowtie2-build {targets} {targets} >&2 && bowtie2 -f --reorder -x {targets} -U {reads}"],
    "novoalign": ["sh", "-c", "novoindex {targets}.nix {targets} >&2 && novoalign -o Sync -o SAM -d {targets}.nix -f {reads}"],
}
for _name, _command in PROGRAMS.items():
    adapter(_name, _command)
