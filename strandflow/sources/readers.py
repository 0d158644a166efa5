"""Files as DataFrames. Paths may be of any file system that Spark reads, and name folders or patterns.

Plain, gzip and bzip2 files go through Spark's text source; xz, zip and tar files are unpacked by tasks
with the standard library, one file at a time. Formats that need programs of their own are refused.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.records import parsed
from ..functions.sequences import adjacency_digits, first_word
from .records import fastq_records

UNPACKED = (".xz", ".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
REFUSED = (".ar", ".tar.Z", ".Z", ".bam", ".jf", ".jfq", ".sra", ".url")


def unpacked(name: str, content: bytes) -> str:
    """The text in a packed file; members of an archive follow each other in order of name."""
    import lzma
    import tarfile
    import zipfile

    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return "".join(z.read(n).decode() for n in sorted(z.namelist()))
    if any(x in name for x in (".tar", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            return "".join(t.extractfile(m).read().decode() for m in sorted(t.getmembers(), key=lambda m: m.name) if m.isfile())
    return lzma.decompress(content).decode()


def split_rows(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, value, place): what stands between separators, with the split it is in; place grows along a split."""
    if path.endswith(REFUSED):
        raise ValueError(f"{path}: files of this kind need a program to unpack them; unpack them first")
    if path.endswith(UNPACKED):

        def run(batches):
            for batch in batches:
                for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = unpacked(file, content)
                    values = text.removesuffix("\n").split(separator) if text else []
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(values), pa.string()), pa.array([0] * len(values), pa.int64()), pa.array(values, pa.string()), pa.array(range(len(values)), pa.int64())], names=["file", "block", "value", "place"])

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, value string, place long")
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("place"))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value) of the lines; those of a split follow each other in its task."""
    return split_rows(spark, path, "\n").select("file", "block", F.regexp_replace("value", "\r$", "").alias("value"))


def records_of(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, value, ord): what stands between separators, in order of the files' names and of their content."""
    rows = split_rows(spark, path, separator)
    # The rows of a split keep their order in its task: a row's number is its place in the split and the rows of the splits before.
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")  # a row for each split
    out = rows.join(F.broadcast(splits), ["file", "block"])
    return out.select("file", "value", (F.col("before") + F.col("place") - F.col("first")).alias("ord"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    rows = records_of(spark, path, "\n")
    return rows.withColumn("value", F.regexp_replace("value", "\r$", ""))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """target_id (ordinal), name, header, seq, len. Lines of a sequence are joined and upper-cased; text that
    comes before the first > of a file is an error."""
    rows = records_of(spark, path, "\n>")
    rows = rows.join(rows.groupBy("file").agg(F.min("ord").alias("first")), "file")
    body = F.when(F.col("ord") == F.col("first"), F.when(F.col("value").startswith(">"), F.substring("value", 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("no FASTA file: "), F.col("file"))))).otherwise(F.col("value"))
    parts = rows.withColumn("body", body).withColumn("header", F.regexp_replace(F.substring_index("body", "\n", 1), "\r$", ""))
    seq = F.upper(F.regexp_replace(F.expr("substring(body, length(substring_index(body, '\\n', 1)) + 1)"), r"\s", ""))
    out = parts.select(F.col("ord").alias("target_id"), first_word(F.col("header")).alias("name"), "header", seq.alias("seq"))
    return out.withColumn("len", F.length("seq").cast("long"))


def numbered_targets(targets: DataFrame) -> DataFrame:
    """Targets whose names are their ids, as the graph mode needs; another name is an error."""
    id_ = F.when(F.col("name").rlike("^[0-9]+$"), F.col("name").cast("long")).otherwise(F.raise_error(F.concat(F.lit("no numeric target name: "), F.col("name"))))
    return targets.withColumn("target_id", id_)


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """n (record in the file set, from 0), name, seq (upper-cased), qual of four-line records; one that lacks lines is an error."""
    return fastq_records(split_lines(spark, path))


def interleaved(first: DataFrame, second: DataFrame | None, offset: int = 0, lib: int = 0) -> DataFrame:
    """Reads of one library with dense ids from offset: of a pair of files alternately, until one lacks the next."""
    one = first.select("n", "name", "seq", "qual")
    if second is None:
        return one.select((F.col("n") + offset).alias("read_id"), F.lit(lib).alias("lib"), F.lit(0).cast("byte").alias("mate"), "name", "seq", "qual")
    both = one.withColumn("mate", F.lit(0)).unionByName(second.select("n", "name", "seq", "qual").withColumn("mate", F.lit(1)))
    counts = both.groupBy().agg(F.count_if(F.col("mate") == 0).alias("n0"), F.count_if(F.col("mate") == 1).alias("n1"))
    kept = both.crossJoin(F.broadcast(counts)).where(F.when(F.col("mate") == 0, F.col("n") < F.least("n0", F.col("n1") + 1)).otherwise(F.col("n") < F.least("n0", "n1")))
    return kept.select((2 * F.col("n") + F.col("mate") + offset).alias("read_id"), F.lit(lib).alias("lib"), F.col("mate").cast("byte").alias("mate"), "name", "seq", "qual")


def library_list(spark: SparkSession, path: str) -> list[str]:
    """The read files that a list names, one on each line."""
    return [r.value.strip() for r in lines_of(spark, path).orderBy("ord").collect() if r.value.strip()]


def libraries(spark: SparkSession, files: list[str], paired: bool = True) -> DataFrame:
    """Reads of all libraries: each file, or each two files, is one; ids are dense over them all."""
    step = 2 if paired else 1
    if len(files) % step:
        raise ValueError("paired libraries need an even number of files")
    out, offset = None, 0
    for lib, at in enumerate(range(0, len(files), step)):
        own = interleaved(fastq(spark, files[at]), fastq(spark, files[at + 1]) if paired else None, offset, lib)
        offset += own.count()
        out = own if out is None else out.unionByName(own)
    return out


def adjacency(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, len) and edges (src, dst) of adjacency lines (value): id, length, coverage, neighbours."""
    fields = F.filter(F.split(adjacency_digits(F.col("value")), r"[\t ]+"), lambda x: x != "")
    rows = lines.select(F.transform(fields, lambda x: x.cast("long")).alias("f")).where(F.size("f") > 1)
    vertices = rows.select(F.get("f", F.lit(0)).alias("id"), F.get("f", F.lit(1)).alias("len"))
    edges = rows.where(F.size("f") > 3).select(F.get("f", F.lit(0)).alias("src"), F.explode(F.slice("f", 4, 1 << 30)).alias("dst"))
    return vertices, edges


def sam(spark: SparkSession, path: str, part: int) -> DataFrame:
    """Records of one partition's file; the head's lines (those with @ before any other) are skipped."""
    lines = lines_of(spark, path)
    first = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).agg(F.min("ord").alias("first"))
    body = lines.crossJoin(F.broadcast(first)).where(F.col("ord") >= F.col("first")).where("value <> ''").withColumn("ord", F.col("ord") - F.col("first"))
    return parsed(body, F.lit(part))
