"""Tables written to the folder that driver and executors share, and dense row numbers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandflow-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the file is there, in whatever file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def digest(rows: DataFrame, *columns: str) -> str:
    """A digest of the rows' columns, whatever the order of the rows."""
    row = F.xxhash64(*columns)
    found = rows.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return f"{found.n}.{found.s or 0}.{found.x or 0}"


def stage(spark: SparkSession, folder: str, name: str, key: str, make) -> DataFrame:
    """What `make` gives, as a table in the folder named by the stage and a hash of the key (inputs and settings): one that an
    earlier run has finished is read instead. A table counts as finished by the file that its commit writes last."""
    path = f"{folder}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where a scan gives fewer (small files of one row group).

    The rows of a large table come in more partitions and stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Runs of equal values (of `within`, in the tasks) up to which they are sent to every executor.
BROADCAST_RUNS = 100_000


def numbered(df: DataFrame, *order: Column | str, name: str = "ordinal", within: str | None = None) -> DataFrame:
    """df with a dense number from 0 in the given order (in each value of `within`, by which it then sorts first).

    Rows are range-partitioned and sorted, and numbered by their place in the partition plus the rows of
    the partitions before: no task sees more than its range, whatever the number of rows."""
    keys = [*([within] if within else []), *order]
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn("_task", F.shiftright("_place", 33)).withColumn("_local", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    # The rows of a task that have one value of `within` stand together: a run of them begins at _first in its task.
    own = [F.col(within).alias("_within")] if within else []
    runs = placed.groupBy("_task", *own).agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    if not within:
        before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
        runs = runs.select("_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_before"))
        return placed.join(F.broadcast(runs), "_task").withColumn(name, F.col("_before") + F.col("_local")).drop("_place", "_task", "_local", "_before")
    before = F.sum("_n").over(Window.partitionBy("_within").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select(F.col("_task").alias("_run"), "_within", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_before")), "runs")
    # A row for each value and each task that it goes on in: few values are sent to all tasks, else both sides are dealt by task
    # and value, so that no task has more than a range whatever a value's share.
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    out = placed.join(runs, (F.col("_task") == F.col("_run")) & F.col(within).eqNullSafe(F.col("_within")))
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_place", "_task", "_local", "_run", "_within", "_before")
