"""Byte-level BPE: texts to ids by a rank file, and ids back to bytes.

Pre-tokenisation uses no regular expression. Code points become classes (letter, number, other, white
space), refined by what follows: white space that ends its run, an apostrophe with a contraction
behind it. A small automaton over these classes says before which code points a piece begins. Its
state at every position comes from an associative scan: each class is a function on states, functions
compose by a table over the monoid that they generate, blocks of text are scanned side by side and the
blocks' functions are then scanned in turn. The pieces so found are looked up in a bounded table of
pieces already merged; only new ones go through pair merging. Every token's place in its text's bytes
is kept beside its id: decoding puts the tokens' bytes there, and can do so for any range of a text.

The pieces are those of public_tokenizers.PATTERN. Null texts are empty: no ids, empty bytes. Rows keep
their key, null or repeated, as it is; further columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Growing, Numbers, held, offsets, slices, spread

#: Code points of the Unicode property White_Space.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The pattern's contractions.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Classes to the automaton. RUN: white space followed by white space or the end. ATTACHING: U+0020 before
#: anything else; LONE: other white space before anything else. SHORT and LONG: an apostrophe and one or
#: two letters of a contraction. FIRST is added at a text's first code point.
RUN, ATTACHING, LONE, SHORT, LONG, FIRST = 3, 4, 5, 6, 7, 8
#: States: nothing that the next code point could join; in letters, numbers, others, white space; after an
#: attaching space; one or two letters of a contraction to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, ATTACHED, ONE_MORE, TWO_MORE = range(8)
#: Pieces kept per worker before the table starts afresh.
TABLE_PIECES = 400_000
BLOCK = 512
#: Bytes of text worked on at once: some forty bytes of arrays stand for each.
PART_BYTES = 1 << 20


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state behind a code point, and whether a piece begins before it."""
    if kind >= FIRST:
        state, kind = FREE, kind - FIRST
    if kind == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (FREE if state == ONE_MORE else ONE_MORE), False
        return IN_LETTERS, state not in (IN_LETTERS, ATTACHED)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, ATTACHED)
    if kind == OTHER or kind in (SHORT, LONG) and state in (IN_OTHERS, ATTACHED):
        return IN_OTHERS, state not in (IN_OTHERS, ATTACHED)
    if kind in (SHORT, LONG):
        return (ONE_MORE if kind == SHORT else TWO_MORE), True
    if kind == RUN:
        return IN_SPACE, state != IN_SPACE
    return (ATTACHED if kind == ATTACHING else FREE), True


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The functions that the classes generate: numbers of the classes' own, the table of compositions
    (row first, then column), what each does to each state, the piece starts, the identity's number."""
    kinds = range(2 * FIRST)
    own = [tuple(step(s, k)[0] for s in range(8)) for k in kinds]
    found = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:
        for g in own:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(queue)
                queue.append(h)
    table = np.array([[found[tuple(g[s] for s in f)] for g in queue] for f in queue], np.uint16)
    starts = np.array([[step(s, k)[1] for k in kinds] for s in range(8)])
    return np.array([found[f] for f in own], np.uint16), table, np.array(queue, np.uint8), starts, 0


@cache
def code_point_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            table[i] = LETTER
        elif major == "N":
            table[i] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def kinds_of(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The automaton's classes; firsts marks each text's first code point."""
    base = code_point_classes()[points]
    last = np.append(firsts[1:], True)
    follows = np.append(base[1:], SPACE)
    follows[last] = SPACE
    kinds = base.copy()
    before_other = (base == SPACE) & (follows != SPACE)
    kinds[before_other] = np.where(points[before_other] == 0x20, ATTACHING, LONE)
    at = np.flatnonzero((points == 0x27) & ~last)
    for tail in CONTRACTIONS if len(at) else ():
        fits = at + len(tail) < len(points)
        for j, letter in enumerate(tail, start=1):
            place = np.minimum(at + j, len(points) - 1)
            fits &= (points[place] == ord(letter)) & ~firsts[place]
        kinds[at[fits]] = SHORT if len(tail) == 1 else LONG
    kinds[firsts] += FIRST
    return kinds


def piece_starts(points: np.ndarray, firsts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Positions of the code points at which a piece begins."""
    if not len(points):
        return np.zeros(0, np.int64)
    own, table, effects, starts, identity = monoid()
    kinds = kinds_of(points, firsts)
    n_blocks = -(-len(kinds) // block)
    padded = np.zeros(n_blocks * block, np.uint8)
    padded[: len(kinds)] = kinds
    rows = np.ascontiguousarray(padded.reshape(n_blocks, block).T)
    # before[k]: what the first k code points of each block do together.
    before = np.empty((block, n_blocks), np.uint16)
    so_far = np.full(n_blocks, identity, np.uint16)
    for k in range(block):
        before[k] = so_far
        so_far = table[so_far, own[rows[k]]]
    # An inclusive scan over the blocks by doubling, then the state in which each block begins.
    reach = 1
    while reach < n_blocks:
        so_far = np.concatenate((so_far[:reach], table[so_far[:-reach], so_far[reach:]]))
        reach *= 2
    enters = effects[np.concatenate(([identity], so_far[:-1])), FREE]
    states = effects[before, enters]
    return np.flatnonzero(starts[states, rows].T.reshape(-1)[: len(kinds)])


class Ranks:
    """The merges of a rank file, and the pieces merged so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.clear()

    def clear(self) -> None:
        self.numbers, self.starts, self.lengths, self.pool = Numbers(), Growing(np.int64), Growing(np.int64), Growing(np.int32)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank is merged, the leftmost of equals, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self.merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        ends, previous, following = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            j = following[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            ends[i], alive[j], following[i] = end, False, following[j]
            if following[i] < n:
                previous[following[i]] = i
            for a in (previous[i], i):
                if a >= 0 and (b := following[a]) < n and (r := ranks.get(piece[a : ends[b]])) is not None:
                    heapq.heappush(heap, (r, a, ends[b]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = following[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's number of ids."""
        if self.numbers.full(TABLE_PIECES):
            self.clear()
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = offsets(lengths)
        firsts = np.zeros(len(points), bool)
        firsts[bounds[:-1][lengths > 0]] = True
        begins = piece_starts(points, firsts)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at_byte = offsets(width)
        raw = joined.encode()
        cuts = at_byte[begins].tolist()
        numbers = self.numbers.of([raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])])
        if self.numbers.fresh:
            fresh, self.numbers.fresh = self.numbers.fresh, []
            ids: list[int] = []
            ends = []
            for piece in fresh:
                ids += self.merged(piece)
                ends.append(len(ids))
            counts = np.diff(ends, prepend=0)
            self.starts.extend(self.pool.n + np.array(ends) - counts)
            self.lengths.extend(counts)
            self.pool.extend(ids)
        n_ids = self.lengths.view()[numbers]
        flat = self.pool.view()[spread(self.starts.view()[numbers], n_ids)]
        of_text = np.searchsorted(begins, bounds)
        return flat, np.diff(offsets(n_ids)[of_text])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes, one after another."""
        return self.blob[spread(self.token_starts[ids], self.token_lengths[ids])]

    def places(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where each token begins in its text's bytes; counts: the texts' numbers of ids."""
        ends = offsets(self.token_lengths[ids])
        return ends[:-1] - np.repeat(ends[offsets(counts)[:-1]], counts)

    def decode_range(self, ids: np.ndarray, places: np.ndarray, first: int, last: int) -> tuple[int, bytes]:
        """The tokens of one text that meet its bytes first to last - 1: where they begin, and their bytes."""
        a = max(0, int(np.searchsorted(places, first, side="right")) - 1)
        b = int(np.searchsorted(places, last, side="left"))
        return (int(places[a]), self.decode(ids[a:b]).tobytes()) if a < b else (first, b"")


def rank_file(path: str) -> Ranks:
    """This worker's own."""
    return held(f"ranks {path}", lambda: Ranks(path))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ids and places (arrays of int) of every text: its tokens, and where each begins in the text's UTF-8 bytes."""
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        ranks = rank_file(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
            for a, b in slices(sizes, PART_BYTES):
                ids, counts = ranks.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                bounds = pa.array(offsets(counts), pa.int32())
                columns = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, ranks.places(ids, counts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["key", "ids", "places"])

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(run, f"key {kind}, ids array<int>, places array<int>").withColumnRenamed("key", key)


def decode(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids", places: str = "places") -> DataFrame:
    """The rows with `bytes` (binary): the ids' bytes at their places; null ids give empty bytes. Places that leave a
    gap or overlap are an error. Other columns than the key and ids are dropped."""
    kept = ids.select(F.col(key).alias("key"), F.col(column).alias("ids"), F.col(places).alias("places"))

    def run(batches):
        ranks = rank_file(path)
        for batch in batches:
            lists = batch.column(1)
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
            for a, b in slices(4 * counts, PART_BYTES):
                part = lists.slice(a, b - a)
                flat, at = np.asarray(part.flatten()), np.asarray(batch.column(2).slice(a, b - a).flatten())
                own = offsets(ranks.token_lengths[flat])
                bounds = own[offsets(counts[a:b])]
                if len(at) != len(flat) or (at + np.repeat(bounds[:-1], counts[a:b]) != own[:-1]).any():
                    raise ValueError("places of tokens do not follow from their lengths")
                raw = ranks.decode(flat).tobytes()
                made = pa.array([raw[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, made], names=["key", "ids", "bytes"])

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(run, f"key {kind}, ids array<int>, bytes binary").withColumnRenamed("key", key).withColumnRenamed("ids", column)
