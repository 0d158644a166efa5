"""Targets into partitions of nearly equal length, by best fit in order of falling length.

Best fit takes lengths one after another, the longest first, but equal lengths behave alike: the bin that fits them
best is tightened by each and so stays the one, until it no longer holds another. So a table of the distinct lengths
with their counts decides all: runs of equal lengths become ranges of ranks. Rows are numbered in order of length by
ranges and counts, and find their bin by their rank; they never meet in one task. Only the distinct lengths go
through one task, as a sorted stream; however many rows there are, lengths up to L are at most L.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import numbered, written
from .graph import dealt, reach_components

#: (bin, how many of a run go there), one after another.
Runs = list[tuple[int | None, int]]


def capacity(total: int, parts: int) -> int:
    return total // parts + parts + 500


class Bins:
    """Capacities left, of equal bins; the bins in order of room, then number."""

    def __init__(self, total: int, parts: int, fallback: str = "last", left: list[int] | None = None):
        self.total, self.size, self.fallback = total, capacity(total, parts), fallback
        self.left = list(left) if left else [self.size] * parts
        self.order = sorted((room, i) for i, room in enumerate(self.left))

    def take(self, i: int, length: int) -> None:
        self.order.remove((self.left[i], i))
        self.left[i] -= length
        insort(self.order, (self.left[i], i))

    def last_resort(self) -> int:
        """The bin for what fits nowhere: of most room, or the last with more room than the first bin."""
        if self.fallback == "max":
            return max(range(len(self.left)), key=lambda i: (self.left[i], -i))
        return max((i for i, c in enumerate(self.left) if c > self.left[0]), default=0)

    def put(self, length: int, n: int = 1) -> Runs:
        """Bins of n equal lengths: each goes to the one with least room to spare, the first of equals; some room must be left
        over, and less than all lengths together."""
        out: Runs = []
        while n:
            if not length:
                # Takes no room: all go where the first goes.
                return [*out, (self.choose(0), n)]
            i = self.choose(length)
            spare = self.left[i] - length
            # The chosen bin only becomes tighter, until it holds no more; a bin beyond its size is chosen anew each time.
            run = min(n, (self.left[i] - 1) // length) if 0 < spare < self.total else 1
            self.take(i, run * length)
            n -= run
            if out and out[-1][0] == i:
                out[-1] = (i, out[-1][1] + run)
            else:
                out.append((i, run))
        return out

    def choose(self, length: int) -> int:
        at = bisect_right(self.order, (length, len(self.left)))
        if at < len(self.order) and self.order[at][0] - length < self.total:
            return self.order[at][1]
        return self.last_resort()

    def put_first(self, length: int, n: int = 1) -> Runs:
        """Bins of n equal lengths, each into the first that holds it, filled up or not; None for what none holds."""
        out: Runs = []
        for i, room in enumerate(self.left):
            if n and length <= room:
                run = min(n, room // length) if length else n
                self.take(i, run * length)
                out.append((i, run))
                n -= run
        return [*out, (None, n)] if n else out


def pack_lengths(lengths: list[int], parts: int, fallback: str = "last") -> list[int]:
    """Bins of lengths that are already in order."""
    bins = Bins(sum(lengths), parts, fallback)
    return [bins.put(n)[0][0] for n in lengths]


def ranges(lengths: DataFrame, total: int, parts: int, fallback: str, left: list[int] | None = None) -> DataFrame:
    """(length, first, part): from the rank `first` on, rows of that length go to the part. lengths: (length, n), each once;
    left: the bins' room, if not all."""

    def run(batches):
        bins = Bins(total, parts, fallback, left)
        for batch in batches:
            out = []
            for length, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if length > bins.size:
                    raise ValueError(f"a target of length {length} is longer than a partition ({bins.size})")
                first = 0
                for part, own in bins.put(length, n):
                    out.append((length, first, part))
                    first += own
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32())], names=["length", "first", "part"])

    return lengths.repartition(1).sortWithinPartitions(F.col("length").desc()).mapInArrow(run, "length long, first long, part int")


#: Ranks of one length that stand in a cell; a range and a row meet by length and cell.
CELL = 1 << 16


def ranked(rows: DataFrame, length: str, key: str) -> DataFrame:
    """rows with `rank`, from 0, among those of the same length in order of the key."""
    return numbered(rows, key, name="rank", within=length)


def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (length, rank, ...) with their part: the range of their length that holds their rank.

    Ranges are few: one for each distinct length and each bin that it begins in. Both sides are cut into cells of ranks, so
    that a length that most rows have is dealt over many tasks."""
    until = F.lead("first").over(Window.partitionBy("length").orderBy("first"))
    cells = found.withColumn("until", F.coalesce(until, F.lit((1 << 62) - 1)))
    last = rows.groupBy("length").agg(F.max("rank").alias("last"))
    cells = cells.join(last, "length").withColumn("end", F.least(F.col("until") - 1, F.col("last")))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("end") / CELL)))).select(F.col("length").alias("_length"), "cell", "first", "until", "part")
    own = rows.withColumn("_cell", F.floor(F.col("rank") / CELL))
    inside = (own["length"] == cells["_length"]) & (own["_cell"] == cells["cell"]) & (own["rank"] >= cells["first"]) & (own["rank"] < cells["until"])
    return own.join(cells, inside).drop("_length", "cell", "_cell", "first", "until")


def target_ranges(targets: DataFrame, parts: int, fallback: str) -> tuple[DataFrame, DataFrame]:
    """The targets' sizes (id, length), and the ranges of ranks (length, first, part) that best fit gives them. targets: id, len."""
    sizes = written(targets.select(F.col("id").cast("long"), F.col("len").cast("long").alias("length")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long")).first()[0]
    return sizes, written(ranges(sizes.groupBy("length").agg(F.count("*").alias("n")), total, parts, fallback), "ranges")


def pack_targets(targets: DataFrame, parts: int, fallback: str = "last") -> DataFrame:
    """(id, part) for targets (id, len); a target longer than a bin is an error."""
    sizes, found = target_ranges(targets, parts, fallback)
    return placed(ranked(sizes, "length", "id"), found).select("id", "part")


#: Ranges up to which they are sent to all tasks.
BROADCAST_RANGES = 250_000


def with_parts(targets: DataFrame, parts: int, fallback: str = "last") -> DataFrame:
    """targets (target_id, seq, ...) with the part that pack_targets gives them.

    Their text is not shuffled where it need not be: a length alone tells the part, or where it begins in several bins, the
    length and the ids at which they change. Such ranges are few and go to all tasks; more of them are joined by id."""
    own = targets.select(F.col("target_id").alias("id"), F.length("seq").cast("long").alias("len"))
    sizes, found = target_ranges(own, parts, fallback)
    if found.count() > BROADCAST_RANGES:
        placed_ids = written(placed(ranked(sizes, "length", "id"), found).select("id", "part"), "parts")
        return targets.join(placed_ids.withColumnRenamed("id", "target_id"), "target_id")
    several = found.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    begins = ranked(sizes.join(several, "length", "left_semi"), "length", "id").select("length", F.col("rank").alias("first"), F.col("id").alias("_from"))
    bounds = found.join(begins, ["length", "first"], "left")
    until = F.lead("_from").over(Window.partitionBy("length").orderBy("first"))
    rule = written(bounds.select(F.col("length").alias("_length"), "_from", until.alias("_until"), "part"), "rule")
    inside = (F.coalesce(F.col("target_id") >= F.col("_from"), F.col("target_id").isNotNull())) & (F.col("_until").isNull() | (F.col("target_id") < F.col("_until")))
    return targets.join(F.broadcast(rule), (F.length("seq").cast("long") == F.col("_length")) & inside).drop("_length", "_from", "_until")


def pack_components(vertices: DataFrame, edges: DataFrame, parts: int, fallback: str = "last") -> DataFrame:
    """(id, part) for all vertices: components stay together; one longer than a bin is split over the first bins
    that hold its members in order of id, and a member that fits nowhere has part null, as have vertices of length zero.

    Components longer than a bin come first, and so settle what room the others have; those go by their lengths as
    targets do, and their members join them."""
    vertices = written(vertices.select(F.col("id").cast("long"), F.col("len").cast("long")), "vertices")
    comps = written(reach_components(vertices, edges).join(dealt(vertices), "id").select("id", "len", F.col("comp_id").cast("long")), "members")
    sizes = written(comps.groupBy("comp_id").agg(F.sum("len").cast("long").alias("length")), "component-lengths")
    total = vertices.agg(F.coalesce(F.sum("len"), F.lit(0)).cast("long")).first()[0]
    bins = Bins(total, parts, fallback)
    # Fewer than `parts` components are longer than a bin.
    large = sizes.where(F.col("length") > bins.size)
    out = vertices.where("len = 0").select("id", F.lit(None).cast("int").alias("part"))
    if not large.isEmpty():
        members = numbered(comps.join(F.broadcast(large), "comp_id"), F.col("length").desc(), "comp_id", "id").select("id", "len", "ordinal")
        out = out.unionByName(split_in_order(written(members, "split"), bins))
    small = sizes.where(F.col("length") <= bins.size)
    found = written(ranges(small.groupBy("length").agg(F.count("*").alias("n")), total, parts, fallback, bins.left), "ranges")
    whole = placed(ranked(small, "length", "comp_id"), found).select("comp_id", "part")
    return out.unionByName(comps.join(dealt(whole), "comp_id").select("id", "part"))


#: A sequence is summed up in at most so many blocks, of at least so many rows.
MOST_BLOCKS, LEAST_BLOCK = 1 << 16, 1 << 12


def split_in_order(rows: DataFrame, bins: Bins) -> DataFrame:
    """(id, part) for rows (id, len, ordinal) in order of their dense ordinals: each into the first bin that holds it (null: none).

    A block of rows that fits whole into the first bin that could hold any of it is settled by its sum and its extremes.
    Only where a bin fills up are the rows of a block looked at one by one. `bins` ends as they leave it."""
    count = rows.count()
    size = max(LEAST_BLOCK, -(-count // MOST_BLOCKS))
    blocks = rows.groupBy(F.floor(F.col("ordinal") / size).cast("long").alias("block")).agg(F.sum("len").alias("sum"), F.min("len").alias("least"), F.max("len").alias("most"))
    found: list[tuple[int, int, int | None]] = []  # (block, from this ordinal on, part)
    for b in blocks.orderBy("block").collect():  # at most MOST_BLOCKS rows
        first = next((i for i, room in enumerate(bins.left) if room >= b.least), None)
        if first is None:
            found.append((b.block, b.block * size, None))
        elif b.sum <= bins.left[first]:
            bins.take(first, b.sum)
            found.append((b.block, b.block * size, first))
        else:
            inside = rows.where(F.col("ordinal").between(b.block * size, (b.block + 1) * size - 1)).select("ordinal", "len").orderBy("ordinal").toArrow()
            before: int | None = -1
            for ordinal, length in zip(inside.column(0).to_pylist(), inside.column(1).to_pylist(), strict=True):
                part = bins.put_first(length)[0][0]
                if part != before:
                    found.append((b.block, ordinal, part))
                    before = part
    spark = rows.sparkSession
    table = spark.createDataFrame(pa.table({"_block": pa.array([f[0] for f in found], pa.int64()), "first": pa.array([f[1] for f in found], pa.int64()), "until": pa.array([*(f[1] for f in found[1:]), count], pa.int64()), "part": pa.array([f[2] for f in found], pa.int32())}))
    own = rows.withColumn("block", F.floor(F.col("ordinal") / size).cast("long"))
    inside = (own["block"] == table["_block"]) & (own["ordinal"] >= table["first"]) & (own["ordinal"] < table["until"])
    return own.join(table, inside).select("id", "part")


def allocation(vertices: DataFrame, placed: DataFrame) -> DataFrame:
    """Of each part (null: what fits nowhere or has no length): n_vertices and total_len. vertices: id, len; placed: id, part."""
    rows = vertices.select("id", "len").join(placed, "id", "left")
    return rows.groupBy("part").agg(F.count("*").alias("n_vertices"), F.sum("len").cast("long").alias("total_len"))
