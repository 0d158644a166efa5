"""FASTQ records over splits that cut them anywhere, and in streams."""

import gzip
import random

import pytest

from strandflow.sources import readers, records
from strandflow.streaming.stream import read_stream


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randrange(0, 90)
        # Qualities that begin like heads and separators.
        rows.append((f"r{seed}.{i} x", "".join(rng.choice("acgtN") for _ in range(size)), "".join(rng.choice("@+I#") for _ in range(size))))
    return rows


def text(rows, end="\n"):
    return "".join(f"@{h}{end}{s}{end}+{end}{q}{end}" for h, s, q in rows)


@pytest.mark.parametrize("bytes_", [150, 701, 1 << 20])
def test_records_over_splits(spark, tmp_path, bytes_):
    files = [made(12, 1), [], made(1, 2), made(17, 3)]
    for i, rows in enumerate(files):
        (tmp_path / f"{i}.fq").write_text(text(rows, "\r\n" if i == 3 else "\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = readers.fastq(spark, str(tmp_path)).orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [r for rows in files for r in rows]
    assert [r.n for r in found] == list(range(len(want)))
    assert [(r.name, r.seq, r.qual) for r in found] == [(h, s.upper(), q) for h, s, q in want]


def test_a_record_that_lacks_lines_is_an_error(spark, tmp_path):
    for name, content in (("short", text(made(5, 1)) + "@x\nAC\n"), ("other", "AC\nGT\nAC\nGT\n" * 4)):
        (tmp_path / f"{name}.fq").write_text(content)
        with pytest.raises(Exception, match="lacks lines|no record"):
            readers.fastq(spark, str(tmp_path / f"{name}.fq")).collect()


def test_ids_go_on_over_micro_batches(spark, tmp_path):
    import os

    folder, rows = tmp_path / "files", []
    folder.mkdir()
    for i in range(3):
        own = made(10 + i, i)
        rows += own
        path = folder / f"{9 - i}.fq.gz"
        path.write_bytes(gzip.compress(text(own).encode()))
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    stream = lambda: records.stream_of(spark, str(folder))
    for _ in range(2):  # a second start finds nothing new
        read_stream(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("read_id").collect()
    assert [(r.read_id, r.name, r.qual) for r in out] == [(i, h, q) for i, (h, _, q) in enumerate(rows)]
    assert {r.batch for r in out} == {0, 1, 2}
