"""Components of the contig graph along the direction of its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def dealt(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle: a table of the size of the graph that looks small goes through the driver else, in each round anew."""
    return df.hint("merge")


def reach_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp_id): the smallest id from which a path leads to the vertex.

    vertices: id, len; edges: src, dst. Vertices of length zero are left out and block paths. In each round labels go
    along the edges from where they fell in the round before, and along shortcuts: every vertex has one pointer up
    (to a vertex that leads to it) and one down (to one that it leads to), begun at an edge each and doubled round by
    round. What a shortcut spans a path spans too, so that the result is that of the edges alone; labels are final when
    a round lowers none. When all pointers have run out, edges from vertices that nothing leads to any more have done
    their work and are left out, and pointers begin anew at other edges."""
    live = vertices.where("len <> 0").select("id").distinct()
    kept = edges.join(dealt(live.withColumnRenamed("id", "src")), "src", "left_semi").join(dealt(live.withColumnRenamed("id", "dst")), "dst", "left_semi")
    kept = written(kept.where("src <> dst").select("src", "dst").distinct(), "graph")
    labels = written(pointed(live.withColumn("comp_id", F.col("id")), kept, 0), "labels")
    moving, epoch, rounds = labels.select("id", "comp_id"), 0, 0
    most = labels.count().bit_length() + 1
    while True:
        step = written(shortened(labels, kept, moving), "labels")
        moved, on_the_way = step.agg(F.count_if("moved"), F.count_if(F.col("up").isNotNull() | F.col("down").isNotNull())).first()
        labels, moving = step.select("id", "comp_id", "up", "down"), step.where("moved").select("id", "comp_id")
        if not moved:
            return labels.select("id", "comp_id")
        rounds += 1
        if not on_the_way or rounds == most:
            epoch, rounds = epoch + 1, 0
            into = kept.select(F.col("dst").alias("src")).distinct().unionByName(moving.select(F.col("id").alias("src"))).distinct()
            kept = written(kept.join(dealt(into), "src", "left_semi"), "graph")
            labels = written(pointed(labels.select("id", "comp_id"), kept, epoch), "labels")


def pointed(labels: DataFrame, edges: DataFrame, epoch: int) -> DataFrame:
    """labels (id, comp_id) with up and down: the ends of an edge that a hash with the epoch chooses; null where there is none."""
    chance = F.xxhash64("src", "dst", F.lit(epoch))
    up = edges.groupBy(F.col("dst").alias("id")).agg(F.min_by("src", chance).alias("up"))
    down = edges.groupBy(F.col("src").alias("id")).agg(F.min_by("dst", chance).alias("down"))
    return labels.join(dealt(up), "id", "left").join(dealt(down), "id", "left")


def shortened(labels: DataFrame, edges: DataFrame, moving: DataFrame) -> DataFrame:
    """One round: id, comp_id, up, down, moved. A pointer whose end has none any more has done its work and is null from then on."""
    ends = labels.select(F.col("id").alias("end"), F.col("comp_id").alias("above"), F.col("up").alias("further"))
    tails = labels.select(F.col("id").alias("tail"), F.col("down").alias("below"))
    along = edges.join(dealt(moving), edges.src == moving.id).select(F.col("dst").alias("id"), F.col("comp_id").alias("offer"))
    pushed = labels.where("down is not null").select(F.col("down").alias("id"), F.col("comp_id").alias("offer"))
    offers = along.unionByName(pushed).groupBy("id").agg(F.min("offer").alias("offer"))
    both = labels.join(dealt(ends), labels["up"] == ends["end"], "left").join(dealt(tails), labels["down"] == tails["tail"], "left").join(dealt(offers), "id", "left")
    least = F.least("comp_id", F.coalesce("offer", "comp_id"), F.coalesce("above", "comp_id"))
    return both.select("id", least.alias("comp_id"), F.col("further").alias("up"), F.col("below").alias("down"), (least < F.col("comp_id")).alias("moved"))


def component_lengths(vertices: DataFrame, components: DataFrame) -> DataFrame:
    """comp_id, n_vertices, total_len."""
    return components.join(dealt(vertices), "id").groupBy("comp_id").agg(F.count("*").alias("n_vertices"), F.sum("len").cast("long").alias("total_len"))
