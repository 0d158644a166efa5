"""What the operators share: the shared folder, written tables, batches of texts, growing arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # pa.compute is there only once it was imported
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Texts are handled in slices of about this many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, in at least as many partitions as there are cores: a small file of one row group is one otherwise."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, qualified; a temporary one is set only where none is."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="strandflow-")
            sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


_SCRATCH: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, tag: str):
    """Tables written inside go to a folder of their own in the shared one, which is deleted at the end:
    nothing that still needs them may be used after."""
    folder = new_path(spark, tag)
    _SCRATCH.append(folder)
    try:
        yield folder
    finally:
        _SCRATCH.pop()
        deleted(spark, folder)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut."""
    path = path or new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding about `limit` bytes each; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with the column's texts as UTF-8 bytes, None for null."""
    for batch in batches:
        column_at = batch.schema.get_field_index(column)
        texts = batch.column(column_at).cast(pa.binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
        for a, b in slices(sizes, limit):
            yield batch.slice(a, b - a), texts.slice(a, b - a).to_pylist()
        del texts, sizes
        pa.default_memory_pool().release_unused()


class Carry:
    """Columns of the input that an operator's rows keep. They travel as _0, _1, ... so that no name can clash."""

    def __init__(self, docs: DataFrame, key: str, text: str, names: list[str]):
        self.names = names
        own = [F.col("`" + c.replace("`", "``") + "`").alias(f"_{i}") for i, c in enumerate(names) if c != text]
        self.rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *own)
        # The text itself is not sent twice.
        self.source = ["text" if c == text else f"_{i}" for i, c in enumerate(names)]
        self.fields = [StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(names)]

    def schema(self, own: str) -> StructType:
        """An operator's own columns, and then those of the input."""
        return StructType([*StructType.fromDDL(own).fields, *self.fields])

    def columns(self) -> list:
        return [F.col(f"_{i}").alias(c) for i, c in enumerate(self.names)]

    def untouched(self) -> list:
        """The same of rows that went through no operator's task."""
        return [F.col(c).alias(name) for c, name in zip(self.source, self.names, strict=True)]


#: A key with more than this share of all rows is dealt in parts of about that many; there are fewer than 1 / HOT_SHARE such keys.
HOT_SHARE = 1e-3


def hot_join(rows: DataFrame, once: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """The inner join of rows with `once`, which has one row for each key and in `times` how many of the `total` rows have it.

    Rows of a hot key are dealt by their place, and what they meet is repeated for each part: so no task gets
    more than HOT_SHARE of the rows by one key, and fewer than 2 / HOT_SHARE rows come in by repeating."""
    parts = once.where(F.col(times) > HOT_SHARE * total).select(key, F.ceil(F.col(times) / F.lit(HOT_SHARE * total)).cast("int").alias("_parts"))
    if parts.isEmpty():
        return rows.join(once.drop(times), key)
    own = rows.join(F.broadcast(parts), key, "left")
    own = own.withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"))).drop("_parts")
    other = once.drop(times).join(F.broadcast(parts), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return own.join(other, [key, "_part"]).drop("_part")


def with_kept(part: pa.RecordBatch, made: dict, source: list[str]) -> pa.RecordBatch:
    """An operator's own columns, and then those of Carry.source."""
    columns = made | {f"_{i}": part.column(part.schema.get_field_index(c)) for i, c in enumerate(source)}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_HELD: dict = {}


def held(name: str, make):
    """What `make` gives, kept in this worker until something is asked for under another name.

    Workers are used again by later stages; one operator's tables at a time bounds their memory."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, dtype, width: int = 0):
        self.data = np.zeros((1024, width) if width else 1024, dtype)
        self.n = 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.data.dtype)
        need = self.n + len(values)
        if need > len(self.data):
            data = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : need] = values
        self.n = need

    def view(self) -> np.ndarray:
        return self.data[: self.n]


#: Bytes of the words that a table of numbers holds before it starts afresh.
TABLE_BYTES = 32 << 20


class Numbers(dict):
    """Words to dense numbers in order of first sight; `fresh` holds those not yet taken up."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        self.bytes += len(word)
        return n

    def full(self, most: int) -> bool:
        return len(self) > most or self.bytes > TABLE_BYTES

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def of_texts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' words one after another, and the number of words in each text."""
        found, words = [], []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for own in word_parts(text) if text else ():
                counts[i] += len(own)
                words += own
                if len(words) > PART_WORDS:
                    found.append(self.of(words))
                    words = []
        return np.concatenate([*found, self.of(words)]), counts


#: Words are made of a text in parts of about so many bytes, and taken up in lists of about so many words.
PART_BYTES, PART_WORDS = 1 << 20, 1 << 19
_SPACE = re.compile(rb"[ \t-\r]")


def word_parts(text: bytes, limit: int = PART_BYTES) -> Iterator[list[bytes]]:
    """All words of the text in order, those of about `limit` bytes at a time."""
    a = 0
    while len(text) - a > 2 * limit and (end := _SPACE.search(text, a + limit)):
        yield text[a : end.start()].split()
        a = end.start()
    yield (text[a:] if a else text).split()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between successive bounds (exact for integers)."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[bounds[1:]] - total[bounds[:-1]]
