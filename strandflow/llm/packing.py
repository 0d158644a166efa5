"""Hierarchical packing of documents into training sequences of several lengths.

Every document's ids end with an end id. Whole windows of the longest tier are cut off its front; the
rest is routed to the smallest tier that holds it. From the longest tier down, a waiting rest opens a
window of its tier, and the gap behind it is filled from rests no longer than the gap (largest first,
so mostly of shorter tiers) and at last by cutting the shortest waiting rest to fit. So every window
is full but for the last of a task: these few ids, less than a longest window for each task, are
packed once more together. Windows of one tier form step groups of equal tokens: a group has
``step_tokens`` / tier windows, numbered through over all tasks.

Packing runs in the task that encodes, over bounded blocks; what a block leaves goes into the next.
Null texts are empty documents (one end id); rows with a null doc_id are packed like any other.
An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_slices, written
from .word_tokens import END_ID, encoder

#: Context sizes; powers of two, so that a full window is never padded.
TIERS = (2048, 1024, 512, 256)
#: Tokens of one optimiser step.
STEP_TOKENS = 1 << 19
#: Tasks whose last ids are packed together by one task.
TAIL_TASKS = 4096

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int"
ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("tier", pa.int32()), ("ids", pa.binary())])


class Packer:
    """Takes documents' ids and makes rows; sequence numbers are first_sequence and up."""

    def __init__(self, first_sequence: int, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        self.most = self.tiers[-1]
        self.next = first_sequence
        self.waiting: list[deque] = [deque() for _ in range(self.most + 1)]
        self.there = 0  # bit n: a rest of n ids waits
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> None:
        doc_tokens = len(ids) if doc_tokens is None else doc_tokens
        at = 0
        while len(ids) - at >= self.most:
            self.emit([(doc_id, start + at, ids[at : at + self.most], doc_tokens)], self.most)
            at += self.most
        if at < len(ids):
            self.wait((doc_id, start + at, ids[at:], doc_tokens))

    def wait(self, rest: tuple) -> None:
        n = len(rest[2])
        self.waiting[n].append(rest)
        self.there |= 1 << n
        self.tokens += n

    def take(self, n: int) -> tuple:
        rest = self.waiting[n].popleft()
        if not self.waiting[n]:
            self.there &= ~(1 << n)
        self.tokens -= n
        return rest

    def emit(self, window: list[tuple], tier: int) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in window:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), doc_tokens, self.next, offset, tier, None))
            offset += len(ids)
        self.next += 1

    def pack(self) -> None:
        """Packs what waits into full windows, and leaves less than one window waiting."""
        while self.there:
            longest = self.there.bit_length() - 1
            tier = next(t for t in self.tiers if t >= longest)
            if self.tokens < tier:
                # Too little for the window that the longest rest asks for: no full one can hold it whole.
                break
            window, gap = [self.take(longest)], tier - longest
            while gap:
                fit = (self.there & ((2 << gap) - 1)).bit_length() - 1
                if fit > 0:
                    window.append(self.take(fit))
                    gap -= fit
                else:
                    shortest = (self.there & -self.there).bit_length() - 1
                    doc_id, start, ids, doc_tokens = self.take(shortest)
                    window.append((doc_id, start, ids[:gap], doc_tokens))
                    self.wait((doc_id, start + gap, ids[gap:], doc_tokens))
                    gap = 0
            self.emit(window, tier)

    def left(self) -> Iterator[tuple]:
        while self.there:
            yield self.take(self.there.bit_length() - 1)

    def close(self) -> None:
        """Packs all that waits; full windows of smaller tiers first, then one that is padded."""
        self.pack()
        rest = list(self.left())
        total = sum(len(r[2]) for r in rest)
        for tier in reversed(self.tiers):
            while total >= tier:
                window, gap = [], tier
                while gap:
                    doc_id, start, ids, doc_tokens = rest.pop()
                    window.append((doc_id, start, ids[:gap], doc_tokens))
                    if len(ids) > gap:
                        rest.append((doc_id, start + gap, ids[gap:], doc_tokens))
                    gap -= len(window[-1][2])
                self.emit(window, tier)
                total -= tier
        if rest:
            self.emit(rest, self.tiers[0])

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""

    def pack_task(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, tiers)
        for part, texts in text_slices(batches):
            ids, lengths = enc.encode(texts, end_id)
            at = 0
            for doc_id, n in zip(part.column(0).to_pylist(), lengths.tolist(), strict=True):
                packer.add(doc_id, ids[at : at + n])
                at += n
            packer.pack()
            yield packer.drain()
        yield batch_of([(d, s, len(i), zlib.crc32(i), n, TaskContext.get().partitionId(), None, None, i.astype("<u4").tobytes()) for d, s, i, n in packer.left()])

    pieces = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack_task, f"{PIECE}, ids binary"), "packed")

    def pack_tails(tails):
        # Few ids of each of at most TAIL_TASKS tasks.
        packer = Packer(0, tiers)
        rows = tails.select(["doc_id", "start", "doc_tokens", "ids", "sequence_id"]).to_pylist()
        rows.sort(key=lambda r: (r["sequence_id"], r["start"], r["ids"]))
        packer.next = (1 << 62) + (rows[0]["sequence_id"] // TAIL_TASKS << 32)
        for r in rows:
            packer.add(r["doc_id"], np.frombuffer(r["ids"], "<u4"), r["start"], r["doc_tokens"])
        packer.close()
        return pa.Table.from_batches([packer.drain().select(list(range(len(ARROW) - 1)))])

    # An open row has its task's number in place of a sequence's.
    open_rows = pieces.where("ids is not null").withColumn("group", F.floor(F.col("sequence_id") / TAIL_TASKS))
    tails = open_rows.groupBy("group").applyInArrow(pack_tails, PIECE)
    whole = pieces.where("ids is null").drop("ids").unionByName(tails)
    return step_groups(whole, step_tokens)


def step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """step_group: in each tier, windows in order of their sequence_id fall into groups of step_tokens.

    The number of windows that a task has before each of its own is known from its sequence ids; the
    windows of each (task, tier) are counted, and only these counts are summed up over the tasks."""
    first = pieces.where("offset = 0").select("sequence_id", "tier", F.shiftright("sequence_id", 32).alias("task"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("task", "tier").orderBy("sequence_id")) - 1)
    counts = first.groupBy("task", "tier").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    per = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    groups = first.join(before, ["task", "tier"]).select("sequence_id", F.floor((F.col("rank") + F.coalesce("before", F.lit(0))) / per).cast("long").alias("step_group"))
    return pieces.join(groups, "sequence_id")
