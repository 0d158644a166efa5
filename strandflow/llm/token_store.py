"""Token ids as raw binary shards with a minimal perfect hash from document key to place.

A store is a folder of shards, each one key range in ascending key order:

* ``ids-*.bin``: an 8-byte head (``b"SFIDS1"``, bytes per id, 0), then the ids of one document after
  another, little-endian, two bytes each where the vocabulary allows, else four;
* ``idx-*.bin``: a head of fixed size, then sections of numbers of fixed width: the perfect hash's bit
  levels and ranks, for each slot a 32-bit fingerprint of its key and the number of the first document
  with that key, the documents' keys in order, and their offsets (in ids, one more than documents);
* ``manifest``: Parquet, one row for each shard that a task has committed: file names, counts, key range.

Tasks write files under names of their own and only committed tasks have manifest rows, so a lost or
repeated task leaves at most a file that nothing names. Keyed access is a search of the manifest and then
a few reads of some bytes each, whatever the size of the shard: the head, a word of the bits for each level
probed (1.6 on average), rank, fingerprint, document, key, two offsets, and the payload.

Null texts are empty documents (only the end id); rows with a null key come first and are stored but
not indexed; of rows with one key all are stored and the index names the first (in order of a hash of
the text). An empty table is a store without shards. Further columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Growing, new_path, offsets, text_slices
from .word_tokens import END_ID, encoder

#: Documents of a shard, until there are so many shards; then shards grow.
SHARD_DOCS, MOST_SHARDS = 8192, 20_000
#: Bits for each key of a level of the perfect hash; keys that share a bit go to the next level.
SPARSENESS, LEVELS = 2.0, 40

#: The index file: its mark and counts (documents, documents without a key, keys, words of bits, levels), bounds of
#: the levels; then its sections, name and type.
INDEX_MARK = b"SFIDX1\0\0"
COUNTS = ("n_docs", "nulls", "n_keys", "n_words", "n_levels")
HEAD_BYTES = len(INDEX_MARK) + 8 * (len(COUNTS) + LEVELS + 1)
SECTIONS = (("bits", "<u8", "n_words"), ("ranks", "<i8", "n_words"), ("marks", "<u4", "n_keys"), ("docs", "<i8", "n_keys"), ("keys", "<i8", "n_own"), ("offsets", "<i8", "n_bounds"))
#: Keys asked of one shard up to which each is read by itself.
FEW_KEYS = 64

MANIFEST = "shard int, ids_file string, idx_file string, n_docs long, n_keys long, n_tokens long, first_key long, last_key long"
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * MIX[0] & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1: a key's slot is the rank of the first level's bit that is its own."""

    def __init__(self, bits: np.ndarray, level_bounds: np.ndarray, ranks: np.ndarray):
        self.bits, self.level_bounds, self.ranks = bits, level_bounds, ranks

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        parts, left, bounds = [], keys, [0]
        for level in range(LEVELS):
            if not len(left):
                break
            size = (max(64, int(len(left) * SPARSENESS)) + 63) // 64 * 64
            at = (mixed(left, level) % np.uint64(size)).astype(np.int64)
            own = np.bincount(at, minlength=size) == 1
            parts.append(own)
            bounds.append(bounds[-1] + size)
            left = left[~own[at]]
        if len(left):
            raise ValueError("keys of a perfect hash must be distinct")
        bits = np.packbits(np.concatenate(parts), bitorder="little").view("<u8") if parts else np.zeros(0, "<u8")
        counts = np.bitwise_count(bits).astype(np.int64)
        return cls(bits, np.array(bounds, np.int64), np.cumsum(counts) - counts)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots; for a key that was not among those given, -1 or another's slot."""
        out = np.full(len(keys), -1, np.int64)
        open_at = np.arange(len(keys))
        for level, (a, b) in enumerate(zip(self.level_bounds[:-1], self.level_bounds[1:], strict=True)):
            if not len(open_at):
                break
            at = (mixed(keys[open_at], level) % np.uint64(b - a)).astype(np.int64) + a
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_at[hit]] = (self.ranks[at >> 6] + np.bitwise_count(below))[hit]
            open_at = open_at[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, folder: str, shard: int, width: int):
        self.fs, self.path = filesystem(folder)
        self.shard, self.dtype = shard, np.dtype(f"<u{width}")
        self.names = [f"{kind}-{shard:05d}-{uuid.uuid4().hex}.bin" for kind in ("ids", "idx")]
        self.out = self.fs.open_output_stream(f"{self.path}/{self.names[0]}")
        self.out.write(b"SFIDS1" + bytes([width, 0]))
        self.keys, self.nulls, self.lengths = Growing(np.int64), 0, Growing(np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents in order; those without a key come first."""
        self.nulls += keys.null_count
        self.keys.extend(np.asarray(keys.drop_null()))
        self.lengths.extend(lengths)
        self.out.write(ids.astype(self.dtype).tobytes())

    def close(self) -> dict:
        self.out.close()
        lengths, keys = self.lengths.view(), self.keys.view()
        distinct, first = np.unique(keys, return_index=True)
        hashed = PerfectHash.of(distinct)
        slots = hashed.slots(distinct)
        marks, docs = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64)
        marks[slots], docs[slots] = fingerprints(distinct), first + self.nulls
        levels = np.full(LEVELS + 1, hashed.level_bounds[-1], np.int64)
        levels[: len(hashed.level_bounds)] = hashed.level_bounds
        own = {"bits": hashed.bits, "ranks": hashed.ranks, "marks": marks, "docs": docs, "keys": keys, "offsets": offsets(lengths)}
        with self.fs.open_output_stream(f"{self.path}/{self.names[1]}") as out:
            out.write(INDEX_MARK + np.array([len(lengths), self.nulls, len(distinct), len(hashed.bits), len(hashed.level_bounds) - 1], "<i8").tobytes() + levels.astype("<i8").tobytes())
            for name, kind, _ in SECTIONS:
                out.write(own[name].astype(kind).tobytes())
        span = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        return dict(shard=self.shard, ids_file=self.names[0], idx_file=self.names[1], n_docs=len(lengths), n_keys=len(distinct), n_tokens=int(lengths.sum()), first_key=span[0], last_key=span[1])


@dataclass
class Shard:
    """An opened shard: its index's head, and files to read the rest from."""

    index: pa.NativeFile
    payload: pa.NativeFile
    counts: dict
    levels: np.ndarray

    @classmethod
    def open(cls, folder: str, row: dict) -> Shard:
        fs, path = filesystem(folder)
        index, payload = fs.open_input_file(f"{path}/{row['idx_file']}"), fs.open_input_file(f"{path}/{row['ids_file']}")
        head = index.read_at(HEAD_BYTES, 0)
        if head[: len(INDEX_MARK)] != INDEX_MARK:
            raise ValueError(f"{row['idx_file']} is no index of ids")
        numbers = np.frombuffer(head, "<i8", offset=len(INDEX_MARK))
        counts = dict(zip(COUNTS, numbers.tolist()))
        counts |= {"n_own": counts["n_docs"] - counts["nulls"], "n_bounds": counts["n_docs"] + 1}
        return cls(index, payload, counts, numbers[len(COUNTS) : len(COUNTS) + counts["n_levels"] + 1])

    def at(self, name: str, first: int = 0, n: int | None = None) -> np.ndarray:
        """n numbers of a section from `first` on (default: all), read from the file."""
        place = HEAD_BYTES
        for section, kind, count in SECTIONS:
            width = np.dtype(kind).itemsize
            if section == name:
                n = self.counts[count] - first if n is None else n
                return np.frombuffer(self.index.read_at(n * width, place + first * width), kind)
            place += self.counts[count] * width
        raise KeyError(name)

    def find_one(self, key: int) -> int:
        """The number of the first document with this key, or -1; some bytes of each section are read."""
        one = np.array([key], np.int64)
        for level, (a, b) in enumerate(zip(self.levels[:-1].tolist(), self.levels[1:].tolist(), strict=True)):
            at = a + int(mixed(one, level)[0] % np.uint64(b - a))
            word, bit = int(self.at("bits", at >> 6, 1)[0]), at & 63
            if word >> bit & 1:
                slot = int(self.at("ranks", at >> 6, 1)[0]) + (word & ((1 << bit) - 1)).bit_count()
                if self.at("marks", slot, 1)[0] != fingerprints(one)[0]:
                    return -1
                doc = int(self.at("docs", slot, 1)[0])
                # A fingerprint may agree by chance; the stored key decides.
                return doc if self.at("keys", doc - self.counts["nulls"], 1)[0] == key else -1
        return -1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For each key the number of its first document in this shard, or -1."""
        keys = np.asarray(keys, np.int64)
        if not self.counts["n_keys"]:
            return np.full(len(keys), -1, np.int64)
        if len(keys) <= FEW_KEYS:
            return np.array([self.find_one(int(k)) for k in keys], np.int64)
        slots = PerfectHash(self.at("bits"), self.levels, self.at("ranks")).slots(keys)
        found = (slots >= 0) & (self.at("marks")[slots] == fingerprints(keys))
        docs = np.where(found, self.at("docs")[slots], -1)
        return np.where(found & (self.at("keys")[np.maximum(docs - self.counts["nulls"], 0)] == keys), docs, -1)

    def ids(self, docs: Iterable[int], bounds: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The ids of the documents with those numbers; bounds: the offsets, if they have been read."""
        head = self.payload.read_at(8, 0)
        if head[:6] != b"SFIDS1":
            raise ValueError("no id file")
        width = head[6]
        for d in docs:
            a, b = (int(x) for x in (self.at("offsets", int(d), 2) if bounds is None else bounds[d : d + 2]))
            yield np.frombuffer(self.payload.read_at((b - a) * width, 8 + a * width), f"<u{width}")

    def close(self) -> None:
        self.index.close()
        self.payload.close()


def write_store(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> str:
    """Encodes the texts and writes a store (default: a new folder in the shared one); returns its folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-store")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = rows.count()
    shards = min(MOST_SHARDS, max(1, -(-n // SHARD_DOCS)))
    order = F.xxhash64("text")
    ranged = rows.repartitionByRange(shards, F.col("key").asc_nulls_first(), order).sortWithinPartitions(F.col("key").asc_nulls_first(), order)

    def write(batches):
        from pyspark import TaskContext

        enc, writer = encoder(tokenizer_path), None
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        for part, texts in text_slices(batches):
            writer = writer or ShardWriter(folder, TaskContext.get().partitionId(), width)
            ids, lengths = enc.encode(texts, end_id)
            writer.add(part.column(0), ids, lengths)
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()], schema=pa.schema([("shard", pa.int32()), ("ids_file", pa.string()), ("idx_file", pa.string()), ("n_docs", pa.int64()), ("n_keys", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]))

    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> list[dict]:
    """The committed shards in key order, each with `before`: the ids of all shards before it. At most MOST_SHARDS rows."""
    rows = sorted((r.asDict() for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()), key=lambda r: r["shard"])
    before = 0
    for r in rows:
        r["before"] = before
        before += r["n_tokens"]
    return rows


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each stored document, read back through the index: doc_id, start, n_tokens, ids_crc32."""
    rows = manifest(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                row = rows[number]
                shard = Shard.open(folder, row)
                nulls, keys, bounds = shard.counts["nulls"], shard.at("keys"), shard.at("offsets")
                docs = shard.find(keys)
                if (docs < 0).any() or len(keys) + nulls != row["n_docs"]:
                    raise ValueError(f"the index of shard {number} lacks keys")
                # Later rows of a repeated key follow the one that the index names.
                first = np.searchsorted(keys, keys, side="left")
                docs = np.concatenate((np.arange(nulls), docs + np.arange(len(keys)) - first))
                for a in range(0, len(docs), 4096):
                    own = docs[a : a + 4096]
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.ids(own, bounds)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(keys[d - nulls]) if d >= nulls else None for d in own], pa.int64()), pa.array(bounds[own] + row["before"], pa.int64()), pa.array(bounds[own + 1] - bounds[own], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    return spark.range(0, len(rows), 1, len(rows)).mapInArrow(read, schema)


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> dict[int, np.ndarray]:
    """The ids of the (first) documents with those keys; keys that are not stored are left out."""
    rows, out = [r for r in manifest(spark, folder) if r["n_keys"]], {}
    lasts = np.array([r["last_key"] for r in rows], np.int64)
    at = np.searchsorted(lasts, np.array(keys, np.int64), side="left")
    for i in np.unique(at[at < len(rows)]):
        shard = Shard.open(folder, rows[i])
        own = np.array([k for k, j in zip(keys, at, strict=True) if j == i], np.int64)
        docs = shard.find(own)
        out |= dict(zip(own[docs >= 0].tolist(), shard.ids(docs[docs >= 0]), strict=True))
        shard.close()
    return out
