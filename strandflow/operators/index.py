"""An index of partitioned targets that outlives the run that made it.

Two bucketed tables in the shared folder serve dispatch and the built-in aligner: `keys`, the anchors of the targets'
k-mers with the bases beside them (part, key, dispatch.BESIDE), each once in a partition, which tell exactly what k-mers
the partition holds in fewer rows than these are, bucketed by key; `places`, the seeds of the built-in
aligner with the bases around them (part, target_id, align.SEED), bucketed by partition and code. With dispatch by minimisers there
is no first table: of a match of alen bases the places hold a seed, so that they serve dispatch as well. A Bloom bank (block, part, bits) may stand beside them, bucketed by block. Joins with them shuffle only what is asked;
the targets' text is read when the index is built and by programs outside alone. A manifest, written last, names the
settings and a digest of the targets: `opened` gives the index only where both are as wanted, so that a build that
died is done again and an index of other targets is never used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AlignConfig
from ..storage import digest, exists, shared_dir, written
from . import bloom
from .align import SEED, positioned, seeds
from .dispatch import BESIDE, BROADCAST_KMERS, anchors_of, keys_of  # noqa: F401

#: Changes with the tables' columns: an index of another layout is built anew.
LAYOUT = 4
MANIFEST = "layout long, k long, alen long, step long, ibits long, nhash long, parts long, dispatch string, digest string, buckets int, blocks long"
columns_of = lambda kinds: ", ".join(f"{name} {kind}" for name, kind in kinds.items())
TABLES = {"keys": ("part int, key long, " + columns_of(BESIDE), "key"), "places": ("part int, target_id long, " + columns_of(SEED), "part, code"), "bank": ("block long, part int, bits binary", "block")}


@dataclass(frozen=True)
class TargetIndex:
    """keys (with dispatch by minimisers the places' part and code), places and bank (None for exact dispatch) as described above; targets: part, target_id, name, seq as written
    with the index; names: the same without seq."""

    config: AlignConfig
    folder: str
    keys: DataFrame
    places: DataFrame
    targets: DataFrame
    bank: DataFrame | None
    blocks: int
    digest: str

    @property
    def names(self) -> DataFrame:
        return self.targets.select("part", "target_id", "name")

    def for_reads(self, reads: DataFrame) -> TargetIndex:
        """Where dispatch and aligner both ask the places, the index with those alone whose seed some read (read_id, seq) has, written:
        the whole table is looked through once. With more than BROADCAST_KMERS seeds, or another dispatch, the index as it is."""
        if not self.config.window:
            return self
        own = positioned(reads.select("read_id", "seq"), ["read_id"], *seeds(self.config.bmer, self.config.alen), True)
        codes = written(own.select("code").distinct(), "read-codes")
        if codes.count() > BROADCAST_KMERS:
            return self
        places = written(self.places.join(F.broadcast(codes), "code", "left_semi"), "read-places")
        return replace(self, places=places, keys=keys_in(places))


def typed(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("part").cast("int").alias("part"), F.col("target_id").cast("long").alias("target_id"), "name", "seq")


def settings(config: AlignConfig) -> dict:
    return {"layout": LAYOUT, "k": config.bmer, "alen": config.alen, "step": config.step, "ibits": config.ibits, "nhash": config.nhash, "parts": config.partitions, "dispatch": config.dispatch}


def keys_in(places: DataFrame) -> DataFrame:
    """(key, part) of the places, which dispatch by minimisers asks."""
    return places.select(F.col("code").alias("key"), "part")


def table(spark: SparkSession, folder: str, kind: str, buckets: int) -> str:
    """The bucketed table of that kind in the folder, by a name of its own in the session's catalogue. Its files are not sorted:
    joins would not rely on it."""
    columns, by = TABLES[kind]
    name = f"strandflow_{kind}_{uuid.uuid4().hex}"
    place = f"{folder}/{kind}".replace("'", r"\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return name


def filled(rows: DataFrame, folder: str, kind: str, buckets: int, once: bool = False) -> DataFrame:
    """The rows in the bucketed table: one file a bucket. once: equal rows only once, found where they were dealt to."""
    by = TABLES[kind][1].split(", ")
    name = table(rows.sparkSession, folder, kind, buckets)
    columns = [c.split(" ")[0] for c in TABLES[kind][0].split(", ")]
    dealt = rows.select(*columns).repartition(buckets, *by)
    (dealt.distinct() if once else dealt).write.insertInto(name, overwrite=True)
    return rows.sparkSession.table(name)


def build(targets: DataFrame, config: AlignConfig, folder: str | None = None, buckets: int | None = None, source: str | None = None) -> TargetIndex:
    """The index of targets (part, target_id, name, seq), written to the folder. buckets: as many as shuffle partitions, if not
    given; source: the digest that `opened` is to ask for, if not that of the targets themselves."""
    spark = targets.sparkSession
    folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = typed(targets)
    own.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/targets")
    own = spark.read.schema(own.schema).parquet(f"{folder}/targets")
    places = filled(positioned(own, ["part", "target_id"], *seeds(config.bmer, config.alen), False), folder, "places", buckets)
    keys = keys_in(places) if config.window else filled(anchors_of(own, "part", config.bmer), folder, "keys", buckets, once=True)
    bank, blocks = None, 0
    if config.dispatch == "bloom":
        blocks = bloom.n_blocks(own, config.bmer, config.ibits)
        bank = filled(bloom.build(own, config.bmer, blocks, config.nhash), folder, "bank", buckets)
    made = settings(config) | {"digest": source or digest(own, *own.columns), "buckets": buckets, "blocks": blocks}
    row = [made[c.split(" ")[0]] for c in MANIFEST.split(", ")]
    spark.createDataFrame([tuple(row)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return TargetIndex(config, folder, keys, places, own, bank, blocks, made["digest"])


def opened(spark: SparkSession, folder: str, config: AlignConfig, source: str | None = None) -> TargetIndex | None:
    """The index in the folder; None if there is none that was finished, with these settings and (if given) of targets with this digest."""
    if not exists(spark, f"{folder}/manifest/_SUCCESS"):
        return None
    made = spark.read.schema(MANIFEST).json(f"{folder}/manifest").first().asDict()
    if any(made[name] != value for name, value in settings(config).items()) or source not in (None, made["digest"]):
        return None
    own = lambda kind: spark.table(table(spark, folder, kind, made["buckets"]))
    targets = spark.read.schema("part int, target_id long, name string, seq string").parquet(f"{folder}/targets")
    places = own("places")
    return TargetIndex(config, folder, keys_in(places) if config.window else own("keys"), places, targets, own("bank") if config.dispatch == "bloom" else None, made["blocks"], made["digest"])


def opened_or_built(spark: SparkSession, folder: str, config: AlignConfig, source: str, partitioned, buckets: int | None = None) -> TargetIndex:
    """The index in the folder if it is of targets with the digest `source` and of these settings; else one of the targets
    (part, target_id, name, seq) that `partitioned` gives is built there."""
    return opened(spark, folder, config, source) or build(partitioned(), config, folder, buckets, source)
