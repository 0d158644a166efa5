import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

import pytest

from strandflow.sources import readers, writers

FASTA = ">a first\nACg\nT\n>b >odd\nGG\n>c\n"


def packed(tmp_path, kind, name, text):
    data, path = text.encode(), tmp_path / f"{name}{kind}"
    if kind == ".gz":
        path.write_bytes(gzip.compress(data))
    elif kind == ".bz2":
        path.write_bytes(bz2.compress(data))
    elif kind == ".xz":
        path.write_bytes(lzma.compress(data))
    elif kind == ".zip":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(name, data)
    elif kind == ".tar.gz":
        with tarfile.open(path, "w:gz") as t:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    else:
        path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("kind", ["", ".gz", ".bz2", ".xz", ".zip", ".tar.gz"])
def test_fasta(spark, tmp_path, kind):
    out = readers.fasta(spark, packed(tmp_path, kind, "x.fa", FASTA)).orderBy("target_id").collect()
    assert [(r.target_id, r.name, r.header, r.seq, r.len) for r in out] == [(0, "a", "a first", "ACGT", 4), (1, "b", "b >odd", "GG", 2), (2, "c", "c", "", 0)]


def test_fasta_must_begin_with_a_header(spark, tmp_path):
    with pytest.raises(Exception, match="no FASTA file"):
        readers.fasta(spark, packed(tmp_path, "", "x.fa", "ACGT\n>a\nAC\n")).collect()


def test_graph_names_are_numbers(spark, tmp_path):
    ok = readers.numbered_targets(readers.fasta(spark, packed(tmp_path, "", "x.fa", ">12\nAC\n")))
    assert ok.first().target_id == 12
    with pytest.raises(Exception, match="no numeric target name"):
        readers.numbered_targets(readers.fasta(spark, packed(tmp_path, "", "y.fa", ">x\nAC\n"))).collect()


def test_refused(spark):
    with pytest.raises(ValueError, match="unpack them first"):
        readers.fasta(spark, "x.bam")


def fastq(n, name):
    return "".join(f"@{name}{i}\nacg{'T' * i}\n+\n{'I' * (3 + i)}\n" for i in range(n))


def test_pairs_and_libraries(spark, tmp_path):
    files = [packed(tmp_path, "", f"{x}.fq", fastq(n, x)) for x, n in (("a", 3), ("b", 2), ("c", 1), ("d", 2))]
    listed = packed(tmp_path, "", "list", "\n".join(files) + "\n")
    assert readers.library_list(spark, listed) == files
    out = readers.libraries(spark, files).orderBy("read_id").collect()
    # a b alternate until b lacks its third; then the next library begins anew.
    assert [(r.read_id, r.lib, r.mate, r.name) for r in out] == [(0, 0, 0, "a0"), (1, 0, 1, "b0"), (2, 0, 0, "a1"), (3, 0, 1, "b1"), (4, 0, 0, "a2"), (5, 1, 0, "c0"), (6, 1, 1, "d0")]
    assert out[2].seq == "ACGT" and out[2].qual == "IIII"
    assert readers.libraries(spark, files[:2], paired=False).count() == 5
    with pytest.raises(ValueError, match="even number"):
        readers.libraries(spark, files[:3])


def test_records_across_splits_and_short_ones(spark, tmp_path):
    text = fastq(500, "r")
    path = packed(tmp_path, "", "many.fq", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = readers.fastq(spark, path).orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert [(r.n, r.name, r.seq, r.qual) for r in out] == [(i, f"r{i}", "ACG" + "T" * i, "I" * (3 + i)) for i in range(500)]
    with pytest.raises(Exception, match="lacks lines"):
        readers.fastq(spark, packed(tmp_path, "", "short.fq", fastq(2, "x") + "@y\nAC\n")).collect()


def test_adjacency(spark):
    lines = spark.createDataFrame([("0 100 3.5\t; 1 2 [d=-27]",), ("1 50 12",), ("2 0 1\t3",)], "value string")
    vertices, edges = readers.adjacency(lines)
    assert sorted(map(tuple, vertices.collect())) == [(0, 100), (1, 50), (2, 0)]
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 2), (2, 3)]


def test_sam_and_writers(spark, tmp_path):
    text = "@HD\n@SQ\n7:q7\t0\tt1\t5\t9\t4M\t*\t0\t0\tAC\tII\tNM:i:0\n@odd\n8:q8\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"
    out = readers.sam(spark, packed(tmp_path, "", "aln.sam", text), 2).orderBy("ord").collect()
    assert [(r.read_id, r.part, r.ord, r.qname, r.flag) for r in out][0] == (7, 2, 0, "q7", 0) and len(out) == 3
    assert out[0].tags == "NM:i:0" and out[0].raw.startswith("q7\t0") and out[2].mapq == 0
    head = spark.createDataFrame([(1, "@SQ"), (0, "@HD")], "ord long, line string")
    body = spark.createDataFrame([(3, 0, "c"), (1, 1, "b"), (1, 0, "a")], "read_id long, place int, line string")
    writers.sam(head, body, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "@HD\n@SQ\na\nb\nc\n"
    sent = spark.createDataFrame([(0, ">0:a\nAC"), (1, ">1:b\nGT")], "part int, record string")
    writers.partitioned(sent, str(tmp_path / "parts"), "gzip")
    assert sorted(p.name for p in (tmp_path / "parts").glob("part=*")) == ["part=0", "part=1"]
    assert readers.fasta(spark, str(tmp_path / "parts" / "part=0")).first().seq == "AC"
    writers.lines_in_order(body, str(tmp_path / "one"), "read_id", "place", one_file=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
