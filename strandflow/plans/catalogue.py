"""The registered queries on the driver's tables, and the same results in SQL.

Documents stand for targets and benchmark passages for reads, their letters read as bases; lineitem
stands for alignment records and orders for all reads; documents and arithmetic on their ids for the
contig graph. Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AlignConfig
from ..functions.names import partition_names
from ..functions.records import FIELDS, tabbed
from ..functions.sequences import canonical, cigar_match_length, dna, ends_strictly, kmer_at, mate_suffix, reverse_complement, starts_strictly, strip_id
from ..operators import bloom, compare, dispatch, graph, header, index, merge, packing, stats
from ..operators.align import longest_exact_match
from ..sources import readers, writers
from ..storage import numbered, shared_dir, spread_out, written
from ..sources.records import stream_of
from ..streaming.stream import read_stream, run_stream
from . import pipeline

#: k-mers of 28 bases, alignments of at least 43: reads are sampled at every 16th position.
CONFIG = AlignConfig(partitions=4, alen=43, bmer=28, paired=False)
K, STEP, PARTS = CONFIG.bmer, CONFIG.step, CONFIG.partitions
#: k-mers longer than a code holds: three quarters of 60.
LONG = AlignConfig(partitions=4, alen=60, paired=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, name, part, seq."""
    docs = spread_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("target_id"), F.col("doc_id").cast("string").alias("name"), F.pmod("doc_id", F.lit(PARTS)).cast("int").alias("part"), dna(F.col("text")).alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, name, seq."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("read_id"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"), dna(F.col("text")).alias("seq"))


def contig_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, len); every document has an edge to another by arithmetic on their ids."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    vertices = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("len"))
    edges = docs.select("doc_id").crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("src"), F.pmod(F.col("doc_id") * F.col("doc_id") + 3, F.col("n")).alias("dst"))
    return vertices, edges


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, len) and edges by which each half of the documents is one component, longer than a bin."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.ceil(F.count("*") / 2).alias("n"))
    edges = docs.select("doc_id").crossJoin(F.broadcast(n)).select((F.col("doc_id") - F.pmod("doc_id", "n")).alias("src"), F.col("doc_id").alias("dst"))
    return docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("len")), edges


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records in four partitions, in line order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    flag = F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_returnflag") == "A", 16).otherwise(0)
    mapped = F.col("l_returnflag") != "R"
    q = F.col("l_quantity").cast("int").cast("string")
    kind = F.pmod("l_linenumber", F.lit(3))
    cigar = F.when(kind == 0, F.concat(q, F.lit("M"))).when(kind == 1, F.concat(F.lit("5S"), q, F.lit("M"))).otherwise(F.concat(q, F.lit("M5S")))
    rows = items.select(
        F.col("l_orderkey").alias("read_id"),
        F.pmod("l_suppkey", F.lit(4)).cast("int").alias("part"),
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("qname"),
        flag.alias("flag"),
        F.when(mapped, F.concat(F.lit("t"), F.col("l_partkey").cast("string"))).otherwise("*").alias("rname"),
        F.when(mapped, F.col("l_suppkey").cast("int")).otherwise(0).alias("pos"),
        F.when(mapped, F.col("l_linenumber")).otherwise(0).alias("mapq"),
        F.when(mapped, cigar).otherwise("*").alias("cigar"),
        F.lit("*").alias("rnext"),
        F.lit(0).alias("pnext"),
        F.lit(0).alias("tlen"),
        F.lit("*").alias("seq"),
        F.lit("*").alias("qual"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )
    placed = numbered(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", name="ord", within="part")
    return placed.drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("raw", F.concat(tabbed(*(F.col(c) for c in FIELDS)), F.lit("\tNM:i:0")))


def all_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"))


def q01(spark, d):
    return targets(spark, d).select("target_id", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("seq_md5"))


def q02(spark, d):
    """Turns of users and of assistants as a pair of read files, in order of conversation and turn."""
    turns = table(spark, d, "conversations").where("role in ('user', 'assistant')").withColumn("mate", F.when(F.col("role") == "user", 0).otherwise(1))
    placed = numbered(turns.select("mate", "conv_id", "turn", "text"), "conv_id", "turn", "text", name="n", within="mate")
    seq = dna(F.col("text"))
    file = lambda m: placed.where(F.col("mate") == m).select("n", F.concat_ws("/", "conv_id", "turn").alias("name"), seq.alias("seq"), F.repeat(F.lit("I"), F.length(seq)).alias("qual"))
    return readers.interleaved(file(0), file(1)).select("read_id", F.col("mate").cast("int").alias("mate"), "name", F.md5("seq").alias("seq_md5"), F.length("qual").alias("qual_len"))


def q03(spark, d):
    return stats.partition_stats(targets(spark, d).select("part", F.length("seq").cast("long").alias("len")), K)


def q03b(spark, d):
    return stats.length_ranking(targets(spark, d).select("target_id", F.length("seq").cast("long").alias("len")))


def q04(spark, d):
    return header.header(targets(spark, d).select(F.col("target_id").alias("place"), "name", F.length("seq").alias("len")))


def q05(spark, d):
    """The graph written as adjacency lines and parsed again: each vertex with its number of edges and their sum."""
    vertices, edges = contig_graph(spark, d)
    near = edges.groupBy(F.col("src").alias("id")).agg(F.concat_ws(" ", F.collect_list(F.col("dst").cast("string"))).alias("near"))
    line = F.concat(F.col("id").cast("string"), F.lit(" "), F.col("len").cast("string"), F.lit(" 3.5\t; [d=-27 x9] "), F.coalesce("near", F.lit("")))
    read_vertices, read_edges = readers.adjacency(vertices.join(near, "id", "left").select(line.alias("value")))
    out = read_edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_edges"), F.sum("dst").alias("sum_dst"))
    return read_vertices.join(out, "id", "left").select("id", "len", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("sum_dst", F.lit(0)).alias("sum_dst"))


def q06(spark, d):
    return targets(spark, d).select("target_id", F.md5(reverse_complement(F.col("seq"))).alias("rc_md5"))


def q07(spark, d):
    """Canonical k-mers of each target: how many, and how many different."""
    rows = targets(spark, d).select("target_id", "seq")
    different = dispatch.keys_of(rows, "target_id", K).groupBy("target_id").agg(F.count("*").alias("n_distinct"))
    counted = rows.select("target_id", F.greatest(F.length("seq") - K + 1, F.lit(0)).cast("long").alias("n_kmers"))
    return counted.join(different, "target_id", "left").select("target_id", "n_kmers", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def q07b(spark, d):
    """The smallest canonical k-mer of each read, as text."""
    rows = reads(spark, d).where(F.length("seq") >= K)
    kmers = rows.select("read_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - K)).alias("at"))
    return kmers.groupBy("read_id").agg(F.min(canonical(kmer_at(F.col("seq"), F.col("at"), K))).alias("kmer"))


def exact(spark, d):
    return dispatch.exact(targets(spark, d).select("part", "seq"), reads(spark, d), K, STEP)


def q08(spark, d):
    return exact(spark, d)


def bloom_candidates(spark, d):
    own = targets(spark, d).select("part", "seq")
    blocks = bloom.n_blocks(own, K, CONFIG.ibits)
    return bloom.candidates(own, reads(spark, d), K, STEP, blocks, CONFIG.nhash)


def q09(spark, d):
    found = written(bloom_candidates(spark, d), "candidates")
    return bloom.verified(targets(spark, d).select("part", "seq"), reads(spark, d), found, K, STEP)


def q09_candidates(spark, d):
    return bloom_candidates(spark, d)


def q09_hashes(spark, d):
    return bloom.kmer_hashes(reads(spark, d), K, STEP, CONFIG.nhash)


def q10(spark, d):
    return graph.reach_components(*contig_graph(spark, d))


def q10b(spark, d):
    vertices, edges = contig_graph(spark, d)
    return graph.component_lengths(vertices, graph.reach_components(vertices, edges))


def q11(spark, d):
    return dispatch.rendered(reads(spark, d), exact(spark, d))


def q12(spark, d):
    return packing.pack_targets(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("len")), PARTS)


def q12_graph(spark, d):
    return packing.pack_components(*contig_graph(spark, d), PARTS)


def q12_split(spark, d):
    return packing.pack_components(*halves(spark, d), PARTS)


def q12_allocation(spark, d):
    vertices, edges = halves(spark, d)
    return packing.allocation(vertices, packing.pack_components(vertices, edges, PARTS))


def q12_routed(spark, d):
    """Graph mode on a target file that lacks every fifth vertex of the graph."""
    own = targets(spark, d).drop("part").where("target_id % 5 <> 0")
    return pipeline.partitioned(own, CONFIG, contig_graph(spark, d)[1]).select("target_id", "part")


def q12b(spark, d):
    return dispatch.unmapped_lines(dispatch.undispatched(reads(spark, d), exact(spark, d)))


def q13(spark, d):
    return stats.run_metadata(targets(spark, d), reads(spark, d))


def q14(spark, d):
    return merge.fast(records(spark, d))


def q15(spark, d):
    return merge.mem(records(spark, d), all_reads(spark, d), CONFIG.max_rec)


def q16(spark, d):
    return merge.in_order(records(spark, d), all_reads(spark, d))


def q17(spark, d):
    return merge.best(records(spark, d), all_reads(spark, d))


def q17_streamed(spark, d):
    return merge.streamed(records(spark, d))


def q17_lengths(spark, d):
    return records(spark, d).select("read_id", "part", "ord", cigar_match_length(F.col("cigar")).alias("mlen"))


def q18(spark, d):
    return merge.alignment_rate(records(spark, d), all_reads(spark, d))


def q19(spark, d):
    """Lines of reads without any record, with their mates' numbers."""
    lost = all_reads(spark, d).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id")), "read_id", "left_anti")
    return lost.select("read_id", F.concat("name", mate_suffix(F.col("read_id")), F.lit("\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*")).alias("line"))


def q20(spark, d):
    return dispatch.round_robin(dispatch.undispatched(reads(spark, d), exact(spark, d)), PARTS)


def q21(spark, d):
    """Records of the built-in aligner for every read that a partition can hold."""
    sent = reads(spark, d).join(written(exact(spark, d), "hits"), "read_id")
    out = longest_exact_match(sent, targets(spark, d), K, CONFIG.alen)
    return out.select("read_id", "part", "flag", "rname", "pos", "mapq", "cigar")


def q21_long(spark, d):
    """The same with k-mers of 45 bases and alignments of at least 60."""
    sent = reads(spark, d).join(written(dispatch.exact(targets(spark, d).select("part", "seq"), reads(spark, d), LONG.bmer, LONG.step), "hits"), "read_id")
    return longest_exact_match(sent, targets(spark, d), LONG.bmer, LONG.alen).select("read_id", "part", "flag", "rname", "pos", "mapq", "cigar")


def first_and_best(spark, d):
    """Two results: each read's first record, and the chosen one."""
    own = written(records(spark, d), "records")
    names = ("flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "qname")
    first = own.groupBy("read_id").agg(F.min_by(F.struct(*names), F.struct("part", "ord")).alias("r")).select("read_id", "r.*")
    won = merge.chosen(own).withColumn("mapq", F.col("mapq_out"))
    return first, won.select("read_id", *names)


def q22(spark, d):
    return compare.differences(*first_and_best(spark, d))


def q23(spark, d):
    """Lines that the first mode gives and the ordered one does not, and the reverse."""
    left = records(spark, d).select(F.col("raw").alias("line"))
    right = merge.in_order(records(spark, d), all_reads(spark, d)).select("line")
    return compare.symmetric_difference(left, right)


def line_fields(lines: DataFrame) -> DataFrame:
    """What a result's line says of its read: flag, mapq and matched length."""
    fields = F.split("line", "\t")
    at = lambda i: F.element_at(fields, i)
    return lines.select("read_id", at(2).cast("int").bitwiseAND(4).alias("unmapped"), at(5).cast("int").alias("mapq"), cigar_match_length(at(6)).alias("mlen"))


def q24(spark, d):
    """The whole run: targets packed into partitions, reads dispatched, aligned and merged."""
    return pipeline.run(reads(spark, d), targets(spark, d).drop("part"), CONFIG).select("read_id", "line")


def q24_indexed(spark, d):
    """The same run with an index of the targets, opened again as a later run would."""
    folder = new_folder(spark, "index")
    pipeline.indexed(targets(spark, d).drop("part"), CONFIG, folder)
    return pipeline.run(reads(spark, d), None, CONFIG, index=index.opened(spark, folder, CONFIG)).select("read_id", "line")


#: Files of reads, a micro-batch each; the index of a stream holds minimisers, which changes no line.
BATCHES = 4
STREAMED = replace(CONFIG, dispatch="minimiser")


def q25(spark, d):
    """The same run with the reads as a stream of some micro-batches; the lines' places follow from the files written."""
    base = new_folder(spark, "stream")
    own = reads(spark, d)
    bounds = own.agg(F.max("read_id").alias("most")).first().most + 1
    for i in range(BATCHES):
        own.where((F.col("read_id") * BATCHES >= i * bounds) & (F.col("read_id") * BATCHES < (i + 1) * bounds)).coalesce(1).write.mode("append").parquet(f"{base}/reads")
    kept = pipeline.indexed(targets(spark, d).drop("part"), STREAMED, f"{base}/index")
    stream = spark.readStream.schema("read_id long, name string, seq string").option("maxFilesPerTrigger", 1).parquet(f"{base}/reads")
    run_stream(stream, kept, f"{base}/out", f"{base}/state")
    lines = spark.read.schema("read_id long, place int, line string, batch int").parquet(f"{base}/out").select("read_id", "line", "batch", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return numbered(lines, "batch", "file", "row").select("ordinal", "read_id", "line")


def q24_long(spark, d):
    return line_fields(pipeline.run(reads(spark, d), targets(spark, d).drop("part"), LONG))


def fasta_round(spark, d, compression):
    """Targets written as FASTA of each partition, their sequences on lines of 60, and read again."""
    folder = new_folder(spark, "fasta")
    folded = targets(spark, d).select("part", F.col("name").alias("header"), F.regexp_replace("seq", "(.{60})", "$1\n").alias("seq"))
    writers.fasta(folded, folder, compression)
    found = readers.numbered_targets(readers.fasta(spark, f"{folder}/part=*"))
    return found.select("target_id", "name", "len", F.md5("seq").alias("seq_md5"))


def q26_fasta(spark, d):
    return fasta_round(spark, d, "none")


def q26_fasta_gzip(spark, d):
    return fasta_round(spark, d, "gzip")


def q27_fastq(spark, d):
    """Passages as FASTQ of two files, gzipped, named in a list, and read again as pairs with dense ids."""
    folder = new_folder(spark, "fastq")
    rows = reads(spark, d).select((F.col("read_id") % 2).cast("int").alias("part"), "read_id", "name", "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    record = dispatch.rendered(rows.drop("part"), rows.select("read_id", "part"), keep_qual=True)
    for part in (0, 1):
        writers.lines_in_order(record.where(F.col("part") == part).withColumnRenamed("record", "line"), f"{folder}/{part}", "read_id", compression="gzip", one_file=True)
    spark.createDataFrame([(f"{folder}/{part}/*.gz",) for part in (0, 1)], "value string").coalesce(1).write.text(f"{folder}/list")
    found = readers.libraries(spark, readers.library_list(spark, f"{folder}/list"))
    return found.select("read_id", F.col("mate").cast("int").alias("mate"), "name", F.md5("seq").alias("seq_md5"), F.length("qual").alias("qual_len"))


def fastq_files(spark, d, folder):
    """Passages of even ids, then those of odd ids, as FASTQ files of a folder."""
    for part in (0, 1):
        own = reads(spark, d).where(F.col("read_id") % 2 == part)
        record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq")))
        own.select("read_id", record.alias("line")).repartition(1).sortWithinPartitions("read_id").select("line").write.mode("append").text(folder)


def q27_stream(spark, d):
    """The files as a stream, one in a micro-batch: dense ids over the batches."""
    base = new_folder(spark, "fastq-stream")
    fastq_files(spark, d, f"{base}/files")
    read_stream(stream_of(spark, f"{base}/files"), f"{base}/reads", f"{base}/state")
    found = spark.read.schema("read_id long, name string, seq string, qual string, batch int").parquet(f"{base}/reads")
    return found.select("batch", "read_id", "name", F.md5("seq").alias("seq_md5"), F.length("qual").alias("qual_len"))


def q25_files(spark, d):
    """The run on a stream of FASTQ files, whose reads get their ids on the way."""
    base = new_folder(spark, "file-stream")
    fastq_files(spark, d, f"{base}/files")
    kept = pipeline.indexed(targets(spark, d).drop("part"), STREAMED, f"{base}/index")
    run_stream(stream_of(spark, f"{base}/files"), kept, f"{base}/out", f"{base}/state")
    return spark.read.schema("read_id long, place int, line string, batch int").parquet(f"{base}/out").select("batch", "read_id", "line")


def q28_sam(spark, d):
    """Each partition's records as files with a head, in order over their names, and read again."""
    folder = new_folder(spark, "sam")
    own = written(records(spark, d), "records")
    names = targets(spark, d).select(F.col("target_id").alias("place"), "name", F.length("seq").alias("len"))
    head = written(header.header(names).select(F.lit(0).alias("body"), "ord", "line"), "head")
    out = None
    for part in range(PARTS):
        body = own.where(F.col("part") == part).select(F.lit(1).alias("body"), "ord", F.concat(F.col("read_id").cast("string"), F.lit(":"), "raw").alias("line"))
        writers.lines_in_order(head.unionByName(body), f"{folder}/{part}", "body", "ord", compression="gzip" if part % 2 else "none")
        found = readers.sam(spark, f"{folder}/{part}", part)
        out = found if out is None else out.unionByName(found)
    return out.select("read_id", "part", "ord", "flag", "rname", "pos", "mapq", "cigar", "tags", "raw")


def q29_names(spark, d):
    """Names of the partitions' files of target files that are called as the pages' addresses are."""
    paths = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(PARTS))).alias("number")
    return paths.select("page_id", "path", numbers).withColumn("name", partition_names(F.col("path"), F.col("number")))


def q29_lines(spark, d):
    """Lines without their ids; strict beginnings and ends."""
    docs = table(spark, d, "documents")
    line = F.concat_ws(":", F.col("doc_id").cast("string"), "lang", "source")
    return docs.select("doc_id", strip_id(line).alias("stripped"), starts_strictly(F.col("lang"), "e").alias("starts"), starts_strictly(F.col("lang"), "en").alias("is_longer"), ends_strictly(F.col("lang"), "n").alias("ends"))


def q30_files(spark, d):
    """The whole run as files, by Bloom filters: how many lines of each kind the result has, and how many mapped reads."""
    folder = new_folder(spark, "run")
    config = AlignConfig(partitions=PARTS, alen=CONFIG.alen, bmer=K, paired=False, dispatch="bloom", keep_qual=True)
    own = reads(spark, d).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    pipeline.run_to_files(own, targets(spark, d).drop("part"), config, folder)
    lines = readers.lines_of(spark, f"{folder}/result")
    kind = F.when(F.col("value").startswith("@"), F.substring("value", 1, 3)).when(F.split("value", "\t")[1] == "4", "unmapped").otherwise("mapped")
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {name: value for name, value in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

# The oracles: DuckDB SQL on the same tables.
DNA = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
TARGETS = f"t as (select doc_id target_id, doc_id % 4 part, {DNA} seq from documents)"
READS = f"b as (select item_id read_id, {DNA} seq from benchmark)"
RC = lambda s: f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def kmers_sql(k: int, step: int, targets: str = TARGETS) -> str:
    return f"""{targets}, {READS},
 tk as (select distinct part, least(k, {RC("k")}) k from (select part, substr(seq, i::int, {k}) k from t, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) u(i))),
 bk as (select distinct read_id, least(k, {RC("k")}) k from (select read_id, substr(seq, i::int, {k}) k from b, unnest(range(1, greatest(length(seq) - {k} + 2, 1), {step})) u(i))),
 hits as (select distinct read_id, part::int part from tk join bk using (k))"""


KMERS = kmers_sql(K, STEP)
GRAPH = "n as (select count(*) n from documents), v as (select doc_id id, n_chars len from documents), e as (select doc_id src, (doc_id * doc_id + 3) % n dst from documents, n)"
COMPONENTS = f"""{GRAPH}, e2 as (select src, dst from e where src in (select id from v where len <> 0) and dst in (select id from v where len <> 0)),
 r(u, w) as (select id, id from v where len <> 0 union select r.u, e2.dst from r join e2 on e2.src = r.w), comps as (select w id, min(u) comp_id from r group by w)"""
RECORDS = """s as (select l_orderkey read_id, (l_suppkey % 4)::int part,
   row_number() over (partition by l_suppkey % 4 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 ord,
   'r' || l_orderkey qname, case l_returnflag when 'R' then 4 when 'A' then 16 else 0 end flag,
   case when l_returnflag = 'R' then '*' else 't' || l_partkey end rname, case when l_returnflag = 'R' then 0 else l_suppkey::int end pos,
   case when l_returnflag = 'R' then 0 else l_linenumber end mapq,
   case when l_returnflag = 'R' then '*' when l_linenumber % 3 = 0 then l_quantity::int || 'M' when l_linenumber % 3 = 1 then '5S' || l_quantity::int || 'M' else l_quantity::int || 'M5S' end cigar,
   case when l_returnflag = 'R' then 0 else l_quantity::int end matched from lineitem),
 m as (select *, case when flag = 4 then 0 when regexp_matches(cigar, '^[0-9]+M') then regexp_extract(cigar, '^([0-9]+)M', 1)::int else regexp_extract(cigar, '^[0-9]+[A-Z=]([0-9]+)', 1)::int end mlen,
   concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, '*', 0, 0, '*', '*', 'NM:i:0') raw from s),
 a as (select o_orderkey read_id, 'r' || o_orderkey name from orders)"""
UNMAPPED_TAIL = "concat_ws(chr(9), '', 4, '*', 0, 0, '*', '*', 0, 0, '*', '*')"
LOST = f"select read_id, 0 place, name || {UNMAPPED_TAIL} line from a where read_id not in (select read_id from m where flag <> 4)"
CHOSEN = """c as (select *, row_number() over (partition by read_id order by case when flag <> 4 then mlen else -1 end desc, part, ord) rn,
   count(*) over (partition by read_id, case when flag <> 4 then mlen else -1 end) same from m),
 w as (select *, case when flag <> 4 and same = 1 then mapq else 0 end mapq_out from c where rn = 1)"""


def matches_sql(config: AlignConfig, targets: str = TARGETS) -> str:
    k = config.bmer
    return f"""{kmers_sql(k, config.step, targets)},
 o as (select read_id, 0 strand, seq from b union all select read_id, 1, {RC("seq")} from b),
 tp as (select target_id, part::int part, i - 1 tpos, substr(seq, i::int, {k}) k from t, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) u(i)),
 op as (select read_id, strand, i - 1 rpos, substr(seq, i::int, {k}) k from o, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) u(i)),
 h as (select op.read_id, tp.part, target_id, strand, rpos, tpos from tp join op using (k) join hits on hits.read_id = op.read_id and hits.part = tp.part),
 g as (select *, rpos - row_number() over (partition by read_id, target_id, strand, tpos - rpos order by rpos) run from h),
 x as (select read_id, part, target_id, strand, min(rpos) rpos, min(tpos) tpos, count(*) + {k} - 1 len from g group by read_id, part, target_id, strand, tpos - rpos, run having count(*) + {k} - 1 >= {config.alen})"""


MATCHES = matches_sql(CONFIG)
# Arithmetic modulo 2^64 in 128 bits: the hash's factor, 2^64, 2^47, a little-endian word of letters.
M64, T64, T47 = "14313749767032793493::uhugeint", "18446744073709551616::uhugeint", "140737488355328::uhugeint"
WORD = "select sum(ascii(substr(k, ({1} + j + 1)::int, 1))::hugeint * power(256::double, j)::hugeint)::uhugeint from range(0, {0}) r(j)"
MIXED = "({0} * " + M64 + " % " + T64 + ")"
WHOLE_OF = """with {0}, y as (select read_id, len, count(*) n from x group by all), z as (select read_id, max(len) mlen, arg_max(n, len) n from y group by read_id)
 select b.read_id, case when z.mlen is null then 4 else 0 end unmapped, case when z.n = 1 then 60 else 0 end mapq, coalesce(mlen, 0)::int mlen from b left join z using (read_id)"""
WHOLE = WHOLE_OF.format(MATCHES)
# Targets in the partitions that best fit gives them, the longest first.
FITTED = f"""t0 as (select doc_id target_id, {DNA} seq from documents), s0 as (select target_id id, length(seq) len, row_number() over (order by length(seq) desc, target_id) rn from t0),
 k0 as (select sum(len)::bigint tot, sum(len)::bigint // {PARTS} + {PARTS} + 500 cap from s0),
 r0(rn, id, part, caps) as (select 0::bigint, -1::bigint, -1::bigint, [cap, cap, cap, cap]::bigint[] from k0 union all
  select q.rn, q.id, q.part, list_transform(q.caps, lambda x, i: case when i = q.part + 1 then x - q.len else x end)
  from (select s0.rn, s0.id, s0.len, r0.caps, coalesce((select arg_min(i, (caps[i + 1] - s0.len, i)) from range(0, {PARTS}) t(i) where caps[i + 1] - s0.len > 0 and caps[i + 1] - s0.len < k0.tot),
    coalesce((select max(i) from range(1, {PARTS}) t(i) where caps[i + 1] > caps[1]), 0)) part from r0 join s0 on s0.rn = r0.rn + 1, k0) q),
 t as (select target_id, part, seq from t0 join r0 on r0.id = target_id)"""
CIGAR = "case when rpos > 0 then rpos || 'S' else '' end || len || 'M' || case when length(seq) - rpos - len > 0 then (length(seq) - rpos - len) || 'S' else '' end"
# The best record of each partition, the best of these, and its line; a read without one has an unmapped line.
LINES_OF = f"""with recursive {{0}}, y as (select *, row_number() over (partition by read_id, part order by len desc, target_id, strand, tpos, rpos) rn, count(*) over (partition by read_id, part, len) same from x),
 w as (select *, row_number() over (partition by read_id order by len desc, part) first, count(*) over (partition by read_id, len) parts from y where rn = 1),
 lines as (select b.read_id, 'b' || b.read_id || case when w.read_id is null then {UNMAPPED_TAIL}
   else concat_ws(chr(9), '', strand * 16, target_id, tpos + 1, case when same = 1 and parts = 1 then 60 else 0 end, {CIGAR}, '*', 0, 0, '*', '*') end line
  from b left join (select * from w where first = 1) w on w.read_id = b.read_id)"""
LINES = LINES_OF.format(matches_sql(CONFIG, FITTED))
ALIGNED_OF = """with {0}, y as (select *, row_number() over (partition by read_id, part order by len desc, target_id, strand, tpos, rpos) rn, count(*) over (partition by read_id, part, len) same from x)
 select hits.read_id, hits.part, coalesce(strand * 16, 4)::int flag, coalesce(target_id::varchar, '*') rname, coalesce(tpos + 1, 0)::int pos, case when same = 1 then 60 else 0 end mapq,
 coalesce(case when rpos > 0 then rpos || 'S' else '' end || len || 'M' || case when length(seq) - rpos - len > 0 then (length(seq) - rpos - len) || 'S' else '' end, '*') cigar
 from hits join b using (read_id) left join (select * from y where rn = 1) y on y.read_id = hits.read_id and y.part = hits.part"""
# Vertices one after another in order of their components (comps, v): whole components by best fit; those longer than a bin vertex by
# vertex into the first bin that holds it.
PACKED = f"""cs as (select comp_id, sum(len)::bigint comp_len from comps join v using (id) group by comp_id),
 s as (select id, len, comp_id, comp_len, row_number() over (order by comp_len desc, comp_id, id) rn, lag(comp_id) over (order by comp_len desc, comp_id, id) is distinct from comp_id is_first from comps join v using (id) join cs using (comp_id)),
 k as (select sum(len)::bigint tot, sum(len)::bigint // {PARTS} + {PARTS} + 500 cap from v),
 p(rn, id, part, caps) as (select 0::bigint, -1::bigint, -1::bigint, [cap, cap, cap, cap]::bigint[] from k union all
  select q.rn, q.id, q.part, list_transform(q.caps, lambda x, i: case when i = q.part + 1 then x - q.taken else x end)
  from (select s.rn, s.id, p.caps, case when comp_len > k.cap then len when is_first then comp_len else 0 end taken,
    case when comp_len > k.cap then (select min(i) from range(0, {PARTS}) t(i) where caps[i + 1] >= len)
      when not is_first then p.part
      else coalesce((select arg_min(i, (caps[i + 1] - comp_len, i)) from range(0, {PARTS}) t(i) where caps[i + 1] - comp_len > 0 and caps[i + 1] - comp_len < k.tot),
        coalesce((select max(i) from range(1, {PARTS}) t(i) where caps[i + 1] > caps[1]), 0)) end part
    from p join s on s.rn = p.rn + 1, k) q),
 packed as (select v.id, v.len, p.part::int part from v left join p on p.id = v.id and p.rn > 0)"""
HALVES = "n as (select (count(*) + 1) // 2 n from documents), v as (select doc_id id, n_chars len from documents), e as (select doc_id - doc_id % n src, doc_id dst from documents, n)"
CLOSURE = COMPONENTS.removeprefix(GRAPH)
LACKING = GRAPH.replace("v as (select doc_id id, n_chars len from documents)", f"v as (select doc_id id, length({DNA}) len from documents where doc_id % 5 <> 0)")

# q09_candidates in SQL takes some 8 GB at sf0.01: a test runs it at sf0.001, and it is not among ORACLE.
# Bits of canonical k-mers: five hashes of each distinct one (as in q09_hashes), the block by the first, the bits by the upper halves.
LETTERS = lambda n, at: " + ".join(f"ascii(k[{at + j + 1}])::uhugeint * {256**j}::uhugeint" for j in range(n))
CANDIDATES = f"""{TARGETS}, {READS},
 tk as (select distinct part, least(k, {RC("k")}) k from (select part, substr(seq, i::int, {K}) k from t, unnest(range(1, greatest(length(seq) - {K} + 2, 1))) u(i))),
 bk as (select distinct read_id, least(k, {RC("k")}) k from (select read_id, substr(seq, i::int, {K}) k from b, unnest(range(1, greatest(length(seq) - {K} + 2, 1), {STEP})) u(i))),
 size as (select greatest(1, (max(n) * {CONFIG.ibits} + {bloom.BLOCK_BITS} - 1) // {bloom.BLOCK_BITS})::uhugeint blocks from (select sum(greatest(length(seq) - {K} + 1, 0))::bigint n from t group by part)),
 ks as (select distinct k from (select k from tk union all select k from bk)),
 w as (select k, {LETTERS(8, 0)} w0, {LETTERS(8, 8)} w1, {LETTERS(8, 16)} w2, {LETTERS(4, 24)} w3 from ks),
 m as (select k, {MIXED.format("w0")} m0, {MIXED.format("w1")} m1, {MIXED.format("w2")} m2, w3 from w),
 a as (select k, seed, xor(m0, m0 // {T47}) * {M64} % {T64} x0, xor(m1, m1 // {T47}) * {M64} % {T64} x1, xor(m2, m2 // {T47}) * {M64} % {T64} x2, w3, xor(seed::uhugeint, {K} * {M64} % {T64}) h from m, range(0, {CONFIG.nhash}) s(seed)),
 h1 as (select k, seed, x1, x2, w3, xor(h, x0) * {M64} % {T64} h from a), h2 as (select k, seed, x2, w3, xor(h, x1) * {M64} % {T64} h from h1),
 h3 as (select k, seed, w3, xor(h, x2) * {M64} % {T64} h from h2), h4 as (select k, seed, xor(h, w3) * {M64} % {T64} h from h3),
 h5 as (select k, seed, xor(h, h // {T47}) * {M64} % {T64} h from h4), hashed as (select k, seed, xor(h, h // {T47}) h from h5),
 bits as (select k, max(h % blocks) filter (seed = 0) block, list(distinct ((h // 4294967296::uhugeint) % {bloom.BLOCK_BITS})::int) bits from hashed, size group by k),
 bank as (select distinct part, block, unnest(bits) bit from tk join bits using (k)),
 asked as (select read_id, k, block, unnest(bits) bit, len(bits) n from bk join bits using (k)),
 found as (select read_id, part, k from asked join bank using (block, bit) group by read_id, part, k, n having count(*) = n)
 select distinct read_id, part::int part from found"""

ORACLE = {
    "q01": f"with {TARGETS} select target_id, length(seq) len, md5(seq) seq_md5 from t",
    "q02": f"""with f as (select case when role = 'user' then 0 else 1 end mate, conv_id || '/' || turn name, {DNA} seq, row_number() over (partition by role order by conv_id, turn, text) - 1 n from conversations where role in ('user', 'assistant')),
 c as (select count(*) filter (mate = 0) n0, count(*) filter (mate = 1) n1 from f)
 select 2 * n + mate read_id, mate, name, md5(seq) seq_md5, length(seq)::int qual_len from f, c where case when mate = 0 then n < least(n0, n1 + 1) else n < least(n0, n1) end""",
    "q03": f"with {TARGETS} select part::int part, count(*) n_targets, sum(length(seq))::bigint total_len, min(length(seq)) min_len, max(length(seq)) max_len, sum(greatest(length(seq) - {K} + 1, 0))::bigint n_items from t group by part",
    "q03b": f"with {TARGETS} select target_id, length(seq) len, row_number() over (order by length(seq) desc, target_id) \"rank\" from t",
    "q04": f"""with {TARGETS} select 0::bigint ord, '@HD' || chr(9) || 'VN:0.3' line union all select 1, concat_ws(chr(9), '@PG', 'ID:strandflow', 'PN:strandflow', 'VN:0.1.0')
 union all select 1 + row_number() over (order by target_id), '@SQ' || chr(9) || 'SN:' || target_id || chr(9) || 'LN:' || length(seq) from t""",
    "q05": f"with {GRAPH} select v.id, len, count(dst) n_edges, coalesce(sum(dst), 0)::bigint sum_dst from v left join e on e.src = v.id group by v.id, len",
    "q06": f"with {TARGETS} select target_id, md5({RC('seq')}) rc_md5 from t",
    "q07": f"""with {TARGETS}, k as (select target_id, count(distinct least(k, {RC("k")})) n_distinct from (select target_id, substr(seq, i::int, {K}) k from t, unnest(range(1, greatest(length(seq) - {K} + 2, 1))) u(i)) group by target_id)
 select target_id, greatest(length(seq) - {K} + 1, 0) n_kmers, coalesce(n_distinct, 0) n_distinct from t left join k using (target_id)""",
    "q07b": f"with {READS} select read_id, min(least(k, {RC('k')})) kmer from (select read_id, substr(seq, i::int, {K}) k from b, unnest(range(1, greatest(length(seq) - {K} + 2, 1))) u(i)) group by read_id",
    "q08": f"with {KMERS} select read_id, part from hits",
    "q09": f"with {KMERS} select read_id, part from hits",
    "q09_hashes": f"""with {READS}, k as (select read_id, i place, least(k, {RC("k")}) k from (select read_id, i, substr(seq, (i + 1)::int, {K}) k from b, unnest(range(0, greatest(length(seq) - {K} + 1, 0), {STEP})) u(i))),
 w as (select read_id, place, seed, ({WORD.format(8, 0)}) w0, ({WORD.format(8, 8)}) w1, ({WORD.format(8, 16)}) w2, ({WORD.format(4, 24)}) w3 from k, range(0, {CONFIG.nhash}) s(seed)),
 a as (select *, {MIXED.format("w0")} m0, {MIXED.format("w1")} m1, {MIXED.format("w2")} m2, xor(seed::uhugeint, {K} * {M64} % {T64}) h from w),
 h0 as (select *, xor(h, xor(m0, m0 // {T47}) * {M64} % {T64}) * {M64} % {T64} g from a),
 h1 as (select *, xor(g, xor(m1, m1 // {T47}) * {M64} % {T64}) * {M64} % {T64} f from h0),
 h2 as (select *, xor(f, xor(m2, m2 // {T47}) * {M64} % {T64}) * {M64} % {T64} e from h1),
 h3 as (select *, xor(e, w3) * {M64} % {T64} d from h2), h4 as (select *, xor(d, d // {T47}) * {M64} % {T64} c from h3)
 select read_id, place, seed::int seed, lower(printf('%016x', xor(c, c // {T47})::ubigint)) hash from h4""",
    "q10": f"with recursive {COMPONENTS} select id, comp_id from comps",
    "q10b": f"with recursive {COMPONENTS} select comp_id, count(*) n_vertices, sum(len)::bigint total_len from comps join v using (id) group by comp_id",
    "q11": f"with {KMERS} select read_id, part, '>' || read_id || ':b' || read_id || chr(10) || seq record from hits join b using (read_id)",
    "q12": """with recursive s as (select doc_id id, n_chars len, row_number() over (order by n_chars desc, doc_id) rn from documents),
 k as (select sum(len)::bigint tot, sum(len)::bigint // 4 + 4 + 500 cap from s),
 r(rn, id, part, caps) as (select 0::bigint, -1::bigint, -1::bigint, [cap, cap, cap, cap]::bigint[] from k union all
  select q.rn, q.id, q.part, list_transform(q.caps, lambda x, i: case when i = q.part + 1 then x - q.len else x end)
  from (select s.rn, s.id, s.len, r.caps, coalesce((select arg_min(i, (caps[i + 1] - s.len, i)) from range(0, 4) t(i) where caps[i + 1] - s.len > 0 and caps[i + 1] - s.len < k.tot),
    coalesce((select max(i) from range(1, 4) t(i) where caps[i + 1] > caps[1]), 0)) part from r join s on s.rn = r.rn + 1, k) q)
 select id, part::int part from r where id >= 0""",
    "q12_graph": f"with recursive {COMPONENTS}, {PACKED} select id, part from packed",
    "q12_split": f"with recursive {HALVES}{CLOSURE}, {PACKED} select id, part from packed",
    "q12_allocation": f"with recursive {HALVES}{CLOSURE}, {PACKED} select part, count(*) n_vertices, sum(len)::bigint total_len from packed group by part",
    "q12_routed": f"with recursive {LACKING}{CLOSURE}, {PACKED} select id target_id, part from packed where part is not null",
    "q12b": f"with {KMERS} select read_id, 'b' || read_id || {UNMAPPED_TAIL} line from b where read_id not in (select read_id from hits)",
    "q13": "select (select count(*) from documents) n_targets, (select count(*) from benchmark) n_reads",
    "q14": f"with {RECORDS} select row_number() over (order by ord, part) - 1 ordinal, raw line from m",
    "q15": f"""with {RECORDS} select read_id, (rn - 1)::int place, line from (select read_id, row_number() over (partition by read_id order by part, ord) rn, concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, '*', 0, 0, '*', '*') line from m where flag <> 4) where rn <= 5
 union all {LOST}""",
    "q16": f"with {RECORDS} select read_id, (row_number() over (partition by read_id order by part, ord) - 1)::int place, raw line from m where flag <> 4 union all {LOST}",
    "q17": f"""with {RECORDS}, {CHOSEN} select read_id, 0 place, case when mapq_out <> 0 or flag = 4 then raw else concat_ws(chr(9), qname, flag, rname, pos, 0, cigar, '*', 0, 0, '*', '*') end line from w
 union all select read_id, 0, name || {UNMAPPED_TAIL} from a where read_id not in (select read_id from m)""",
    "q17_streamed": f"with {RECORDS}, {CHOSEN} select read_id, 0 place, concat_ws(chr(9), qname, flag, rname, pos, mapq_out, cigar, '*', 0, 0, '*', '*') line from w",
    "q17_lengths": f"with {RECORDS} select read_id, part, ord, matched mlen from m",
    "q18": f"with {RECORDS}, {CHOSEN} select (select count(*) from a) n_reads, count(*) filter (mapq_out <> 0) n_aligned, round(count(*) filter (mapq_out <> 0) * 100.0 / (select count(*) from a), 4) percent from w",
    "q19": f"with a as (select o_orderkey read_id, 'r' || o_orderkey name from orders) select read_id, name || '/' || (read_id % 2 + 1) || {UNMAPPED_TAIL} line from a where read_id not in (select l_orderkey from lineitem)",
    "q20": f"with {KMERS} select read_id, (row_number() over (order by read_id) % 4 + 1)::int part from b where read_id not in (select read_id from hits)",
    "q21": ALIGNED_OF.format(MATCHES),
    "q21_long": ALIGNED_OF.format(matches_sql(LONG)),
    "q22": f"""with {RECORDS}, {CHOSEN}, f as (select *, row_number() over (partition by read_id order by part, ord) first from m),
 p as (select f.mapq am, w.mapq_out bm, f.cigar ac, w.cigar bc, f.flag af, w.flag bf, concat_ws(chr(9), f.flag, f.rname, f.pos, f.mapq, f.cigar) al, concat_ws(chr(9), w.flag, w.rname, w.pos, w.mapq_out, w.cigar) bl from f join w using (read_id) where first = 1),
 k as (select case when al = bl then null when am = 0 and bm <> 0 then 'mapq_not_zero' when am <> 0 and bm = 0 then 'mapq_zero'
   when am > 0 and am = bm then case when ac <> bc then 'diff_read_frags' when (af & 16) <> (bf & 16) then 'diff_dir' else 'unclassified' end
   when (af & 4) = 0 and (bf & 4) <> 0 then 'bloom_filter_miss' when am > 0 or bm > 0 then 'unclassified' end kind from p)
 select kind, count(*) n from k where kind is not null group by kind""",
    "q23": f"""with {RECORDS}, l as (select raw line from m), o as (select raw line from m where flag <> 4 union all select line from ({LOST}))
 select line, 'left' side from (select line from l except all select line from o) union all select line, 'right' from (select line from o except all select line from l)""",
    "q24": f"{LINES} select read_id, line from lines",
    "q24_indexed": f"{LINES} select read_id, line from lines",
    "q24_long": WHOLE_OF.format(matches_sql(LONG)),
    "q25": f"{LINES} select row_number() over (order by read_id) - 1 ordinal, read_id, line from lines",
    "q26_fasta": f"with {TARGETS} select target_id, target_id::varchar \"name\", length(seq) len, md5(seq) seq_md5 from t",
    "q26_fasta_gzip": f"with {TARGETS} select target_id, target_id::varchar \"name\", length(seq) len, md5(seq) seq_md5 from t",
    "q27_fastq": f"""with {READS}, f as (select read_id % 2 mate, read_id || ':b' || read_id \"name\", seq, row_number() over (partition by read_id % 2 order by read_id) - 1 n from b),
 c as (select count(*) filter (mate = 0) n0, count(*) filter (mate = 1) n1 from f)
 select 2 * n + mate read_id, mate::int mate, "name", md5(seq) seq_md5, length(seq)::int qual_len from f, c where case when mate = 0 then n < least(n0, n1 + 1) else n < least(n0, n1) end""",
    "q27_stream": f"""with {READS} select (read_id % 2)::int batch, row_number() over (order by read_id % 2, read_id) - 1 read_id, 'b' || read_id "name", md5(seq) seq_md5, length(seq)::int qual_len from b""",
    "q25_files": f"""{LINES}, ids as (select read_id, row_number() over (order by read_id % 2, read_id) - 1 id from b) select (read_id % 2)::int batch, id read_id, line from lines join ids using (read_id)""",
    "q28_sam": f"with {RECORDS} select read_id, part, ord, flag, rname, pos, mapq, cigar, 'NM:i:0' tags, raw from m",
    "q29_names": f"""with n as (select page_id, split_part(split_part(url, '?', 1), '#', 1) path from pages), m as (select page_id, path, split_part(path, '/', -1) file from n),
 k as (select *, length(file) - position('.' in reverse(file)) dot from m)
 select page_id, path, i::int number, case when position('.' in file) = 0 or dot = 0 then file || '-' || i || '.fa' else file[:dot] || '-' || i || file[dot + 1:] end "name" from k, range(1, {PARTS + 1}) r(i)""",
    "q29_lines": "select doc_id, concat_ws(':', lang, source) stripped, lang like 'e_%' starts, lang like 'en_%' is_longer, lang like '%_n' ends from documents",
    "q30_files": f"select kind, n from (values ('@HD', 1), ('@PG', 1)) h(kind, n) union all select '@SQ', count(*) from documents union all select case when unmapped = 4 then 'unmapped' else 'mapped' end, count(*) from ({WHOLE}) group by 1",
}
