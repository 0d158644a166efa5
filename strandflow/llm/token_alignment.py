"""Alignment of two tokenizers over the same texts: a byte-level BPE (A) and a sentence-piece model (B).

Both see a space and the text. Each token is a range of its text's bytes. Two merges by position (pandas
merge_asof, keyed by document) find for every token start the other side's token that covers it; the union of
both directions is all overlaps, and overlaps with equal ends close groups. Tokens of one group are linked:
`aligned` gives a row for each document with its groups and its linked id pairs; `with_link_scores` counts over
all documents how many hold each pair and sums these counts for each document.

No token of either side goes over a U+0020 that stands between two other characters than white space. So words cut
there are encoded once per worker, and texts of any length go through in parts of about PART_BYTES.

Texts that are null or empty have no tokens; nor have those whose tokens' bytes are not a space and the text (such
as texts with U+2581, which B reads as a space): counts of zero, empty groups. Rows keep their key, null or
repeated, as it is, and each counts as a document of its own; further columns are dropped; an empty table gives no
rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Growing, Numbers, held, offsets, slices, spread, sums, written

#: Bytes of text that are worked on at once; words that a worker keeps.
PART_BYTES, TABLE_WORDS = 1 << 20, 300_000
#: Links of a group that are spelled out; those of larger groups are counted by their distinct ids.
GROUP_LINKS = 1 << 12
#: Pairs that more than one in so many of all (document, pair) rows hold are looked up in a broadcast table; there are fewer than this.
HOT_PAIRS = 1 << 20
#: Where no token of either side goes on: a space between two characters that are not white.
CUT = re.compile(r"(?<=\S) (?=\S)")
LOWER_ONE = "▁"


def byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Digits:
    """Ids as text, each with a comma behind it."""

    def __init__(self, n: int):
        own = [b"%d," % i for i in range(n)]
        self.blob = np.frombuffer(b"".join(own), np.uint8)
        self.lengths = np.fromiter(map(len, own), np.int64, n)
        self.starts = np.cumsum(self.lengths) - self.lengths


class Side:
    """One tokenizer: how it encodes words (behind a space), the bytes of each id, and the ids of words seen so far."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.widths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.clear()

    def clear(self) -> None:
        self.starts, self.counts, self.pool = Growing(np.int64), Growing(np.int64), Growing(np.int32)

    def take_up(self, words: list[str]) -> list[bytes]:
        """The words' bytes as their tokens have them."""
        found = self.encode(words)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.starts.extend(self.pool.n + np.cumsum(counts) - counts)
        self.counts.extend(counts)
        self.pool.extend([i for ids in found for i in ids])
        return [b"".join([self.pieces[i] for i in ids]) for ids in found]

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words one after another, and each word's number of ids."""
        counts = self.counts.view()[numbers]
        return self.pool.view()[spread(self.starts.view()[numbers], counts)], counts


#: Fixed value: the pattern by which byte-level files without one of their own cut texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to here are letters, numbers or neither alike in every version of Unicode that a library may have.
SETTLED = "\u024f"


def merged_by_id(path: str, pieces: list[bytes]):
    """A faster encoder of single words with the file's own vocabulary, where its merges come in order of the ids they make; else None."""
    import json

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    model, cut = own["model"], own["pre_tokenizer"] or {}
    first = len(model["vocab"]) - len(model["merges"])
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if own["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or model.get("ignore_merges"):
        return None
    if any(model["vocab"].get(m) not in (first + i, None) or m not in model["vocab"] for i, m in enumerate(made[: len(pieces)])):
        return None
    import tiktoken

    special = {t["id"] for t in own["added_tokens"]}
    ranks = {piece: i for i, piece in enumerate(pieces) if i not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_level_side(path: str) -> Side:
    """Words of settled characters by merged_by_id where the file allows it, others by the tokenizers library (tests hold both
    against the library on whole texts)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    letters = byte_of_letter()
    pieces = [b""] * (max(model.get_vocab().values()) + 1)
    for token, i in model.get_vocab().items():
        pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    quick = merged_by_id(path, pieces)

    def encode(words: list[str]) -> list[list[int]]:
        out = [quick(" " + w) if quick and (w.isascii() or max(w) <= SETTLED) else None for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, model.encode_batch([" " + words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return Side(encode, pieces)


def sentence_piece_side(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = [name for i, name in enumerate(names) if not model.is_byte(i)]
    if any(LOWER_ONE in name.lstrip(LOWER_ONE) for name in plain):
        raise ValueError(f"{path}: a piece has a space behind another character; texts can't be cut at spaces")
    pieces = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(LOWER_ONE, " ").encode() for i, name in enumerate(names)]
    return Side(lambda words: model.encode(words, num_threads=1), pieces)


def piece_count(path: str) -> int:
    """The size of a sentence-piece model's vocabulary."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()


def overlaps(a_ends: np.ndarray, a_doc: np.ndarray, b_ends: np.ndarray, b_doc: np.ndarray) -> pd.DataFrame:
    """All pairs (a, b) of tokens whose bytes overlap, in order, by their places in the arrays.

    Ends grow along each array (documents follow each other); tokens have at least one byte and both sides cover all."""
    starts = lambda ends: np.concatenate(([0], ends))[: len(ends)]
    left = pd.DataFrame({"at": starts(a_ends), "doc": a_doc, "a": np.arange(len(a_ends))})
    right = pd.DataFrame({"at": starts(b_ends), "doc": b_doc, "b": np.arange(len(b_ends))})
    covering = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy(np.int64)
    covered = pd.merge_asof(right, left, on="at", by="doc")["a"].to_numpy(np.int64)
    # A pair that starts together is found both ways.
    second = np.flatnonzero(left["at"].to_numpy()[covered] != right["at"].to_numpy())
    a, b = np.concatenate((np.arange(len(a_ends)), covered[second])), np.concatenate((covering, second))
    # Along the text a and b never fall: sorting by their sum puts the pairs in order.
    order = np.argsort(a + b, kind="stable")
    return pd.DataFrame({"a": a[order], "b": b[order]}, copy=False)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of `times` of each."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(times, firsts) if len(firsts) else times


class Aligner:
    """Both sides, and the alignment of documents in parts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_level_side(a_path), sentence_piece_side(b_path)
        self.width = len(self.b.pieces)
        self.digits = [Digits(len(self.a.pieces)), Digits(self.width)]
        self.blob = np.concatenate([d.blob for d in self.digits])
        self.clear()

    def clear(self) -> None:
        self.numbers, self.same = Numbers(), Growing(bool)
        self.a.clear()
        self.b.clear()

    def numbered(self, words: list[str]) -> np.ndarray:
        if self.numbers.full(TABLE_WORDS):
            self.clear()
        numbers = self.numbers.of(words)
        if self.numbers.fresh:
            fresh, self.numbers.fresh = self.numbers.fresh, []
            both = zip(fresh, self.a.take_up(fresh), self.b.take_up(fresh), strict=True)
            self.same.extend([a == b == b" " + word.encode() and LOWER_ONE not in word for word, a, b in both])
        return numbers

    def part(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Of each text: same (whether both sides give it back), n_a, n_b, n_groups, n_links, groups; and doc, code, times of
        its distinct linked pairs. A text that is not the same has no tokens."""
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = CUT.split(text)
                counts[i] = len(own)
                words += own
        numbers = self.numbered(words)
        of_word = np.repeat(np.arange(len(texts)), counts)
        same = np.bincount(of_word, weights=~self.same.view()[numbers], minlength=len(texts)) == 0
        kept = same[of_word]
        numbers, of_word = numbers[kept], of_word[kept]
        (a, a_counts), (b, b_counts) = self.a.tokens(numbers), self.b.tokens(numbers)
        a_doc, b_doc = np.repeat(of_word, a_counts), np.repeat(of_word, b_counts)
        a_ends, b_ends = np.cumsum(self.a.widths[a]), np.cumsum(self.b.widths[b])
        pairs = overlaps(a_ends, a_doc, b_ends, b_doc)
        at_a, at_b = (pairs[side].to_numpy(np.int64) for side in ("a", "b"))
        closes = a_ends[at_a] == b_ends[at_b]
        group = np.cumsum(closes) - closes
        a_group, b_group = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_group[at_a], b_group[at_b] = group, group
        n_groups = int(closes.sum())
        in_a, in_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        doc_of_group = a_doc[at_a[closes]]
        per_doc = lambda of, weights=None: np.bincount(of, weights=weights, minlength=len(texts)).astype(np.int64)
        links = np.zeros(len(texts), np.int64)
        np.add.at(links, doc_of_group, in_a * in_b)
        doc, code, times = self.linked(a, b, in_a, in_b, doc_of_group)
        return {
            "same": same,
            "n_a": per_doc(a_doc),
            "n_b": per_doc(b_doc),
            "n_groups": per_doc(doc_of_group),
            "n_links": links,
            "groups": self.spelled(a, b, in_a, in_b, per_doc(doc_of_group)),
            "doc": doc,
            "code": code,
            "times": times,
        }

    def linked(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, doc_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, code, times): the distinct pairs a * width + b linked in each document, and how many links each has there."""
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        base = len(self.a.pieces) * self.width
        small = in_a * in_b <= GROUP_LINKS
        # Each A token of a small group beside each B token of it.
        a_at = spread(first_a[small], in_a[small])
        group = np.repeat(np.flatnonzero(small), in_a[small])
        b_at = spread(first_b[group], in_b[group])
        near = np.repeat(a_at, in_b[group])
        keys = [np.repeat(doc_of_group[group], in_b[group]) * base + a[near].astype(np.int64) * self.width + b[b_at]]
        found = [summed(keys[0], np.ones(len(keys[0]), np.int64))]
        for g in np.flatnonzero(~small).tolist():
            own_a, n_a = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            own_b, n_b = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            codes = (own_a.astype(np.int64)[:, None] * self.width + own_b).reshape(-1)
            found.append((int(doc_of_group[g]) * base + codes, (n_a[:, None] * n_b).reshape(-1)))
        keys, times = summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if len(found) > 1 else found[0]
        return keys // base, keys % base, times

    def spelled(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, groups_of_doc: np.ndarray) -> list[str]:
        """The groups of each document as text: a1,a2|b1;a3|b2,b3."""
        last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)
        # Of the tokens in the order of the text form: those of A of a group, then those of B.
        place_a = np.arange(len(a)) + np.repeat(last_b - in_b, in_a)
        place_b = np.arange(len(b)) + np.repeat(last_a, in_b)
        lengths, starts, kind = (np.zeros(len(a) + len(b), np.int64) for _ in range(3))
        for side, place, ids in ((0, place_a, a), (1, place_b, b)):
            lengths[place], starts[place], kind[place] = self.digits[side].lengths[ids], self.digits[side].starts[ids], side
        # B's digits stand behind A's.
        text = self.blob[spread(starts + kind * len(self.digits[0].blob), lengths)]
        ends = np.cumsum(lengths)
        close_b = last_a + last_b
        text[ends[close_b - in_b - 1] - 1] = ord("|")
        text[ends[close_b - 1] - 1] = ord(";")
        raw = text.tobytes()
        of_group = np.concatenate(([0], ends[close_b - 1]))[offsets(groups_of_doc)]
        return [raw[x : max(x, y - 1)].decode() for x, y in zip(of_group[:-1].tolist(), of_group[1:].tolist())]

    def whole(self, text: str) -> dict[str, np.ndarray | list]:
        """The same of one text of any length, part by part."""
        out = None
        for own in text_parts(text):
            found = self.part([own])
            if not found["same"][0]:
                return self.part([""]) | {"same": found["same"]}
            if out is None:
                out = found | {"groups": []}
            else:
                for name in ("n_a", "n_b", "n_groups", "n_links"):
                    out[name] = out[name] + found[name]
                out["code"], out["times"] = summed(np.concatenate((out["code"], found["code"])), np.concatenate((out["times"], found["times"])))
            out["groups"].append(found["groups"][0])
        return out | {"groups": [";".join(out["groups"])], "doc": np.zeros(len(out["code"]), np.int64)}


def text_parts(text: str, limit: int = PART_BYTES) -> Iterator[str]:
    """The text in parts of about `limit` characters, cut (without the space) where no token goes on."""
    a = 0
    while len(text) - a > limit and (cut := CUT.search(text, a + limit)):
        yield text[a : cut.start()]
        a = cut.end()
    yield text[a:] if a else text


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_a, n_b, n_groups, n_links, groups (as text: ids of A, |, ids of B; groups parted by ;), pairs (distinct linked
    ids, each a * B's size + b) and times (links of each pair) of every document."""
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        both = held(f"aligner {a_path} {b_path}", lambda: Aligner(a_path, b_path))
        for batch in batches:
            texts = batch.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
            for x, y in slices(sizes, PART_BYTES):
                own = texts.slice(x, y - x).to_pylist()
                found = both.whole(own[0] or "") if len(own) == 1 else both.part([t or "" for t in own])
                bounds = pa.array(np.searchsorted(found["doc"], np.arange(len(own) + 1)), pa.int32())
                columns = [pa.array(found[name]) for name in ("n_a", "n_b", "n_groups", "n_links")]
                lists = [pa.ListArray.from_arrays(bounds, pa.array(found[name], pa.int64())) for name in ("code", "times")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *columns, pa.array(found["groups"], pa.string()), *lists], names=["key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kind = kept.schema["key"].dataType.simpleString()
    found = kept.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")
    return found.withColumnRenamed("key", key)


#: Distinct pairs of documents that a task adds up before it passes them on.
ROUND_PAIRS = 1 << 21


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each pair in their array `pairs`. Tasks add up before anything is shuffled."""

    def run(batches):
        found, size = [], 0
        for batch in batches:
            codes = np.asarray(batch.column(0).flatten())
            found.append(summed(codes, np.ones(len(codes), np.int64)))
            size += len(found[-1][0])
            if size > ROUND_PAIRS:
                found = [summed(*(np.concatenate(x) for x in zip(*found)))]
                if len(found[0][0]) > ROUND_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.pop()], names=["pair", "n"])
                size = sum(len(f[0]) for f in found)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*(np.concatenate(x) for x in zip(*found)))], names=["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_link_scores(rows: DataFrame, width: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The rows of `aligned` (or what was derived from them) without pairs and times, with n_best and count_sum over their links.

    A pair's count is how many rows hold it. n_best: links whose pair has the highest count of all pairs with its A id;
    count_sum: the sum of the links' counts. Pairs above a share of 1 / hot_pairs of all (row, pair) are fewer than
    hot_pairs: their counts, and the highest count of each A id, are sent to all tasks. The other pairs are joined; none
    of them has more than that share of the rows."""
    spark = rows.sparkSession
    stored = written(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(stored), "pair-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * F.lit(hot_pairs) > F.lit(total)
    highest = counts.groupBy(F.floor(F.col("pair") / F.lit(width)).cast("long").alias("a")).agg(F.max("n").alias("most"))
    arrays = lambda df: [np.asarray(c.combine_chunks()) for c in df.toArrow().columns]
    ids, most = arrays(highest.orderBy("a"))
    best = np.zeros(int(ids[-1]) + 1 if len(ids) else 1, np.int64)
    best[ids] = most
    pairs, n = arrays(counts.where(is_hot).orderBy("pair"))
    table = spark.sparkContext.broadcast((pairs, n, n == best[pairs // width] if len(pairs) else np.zeros(0, bool)))

    kept = [c for c in stored.columns if c not in ("pairs", "times")]

    def looked_up(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each row's pairs begin, each pair's place in the table and whether it is there, its times."""
        codes, times = np.asarray(batch.column("pairs").flatten()), np.asarray(batch.column("times").flatten())
        bounds = offsets(np.asarray(pa.compute.list_value_length(batch.column("pairs")), np.int64))
        own = table.value[0]
        at = np.minimum(np.searchsorted(own, codes), max(0, len(own) - 1))
        return bounds, at, own[at] == codes if len(own) else np.zeros(len(codes), bool), times

    def hot(batches):
        _, n, is_best = table.value
        for batch in batches:
            bounds, at, there, times = looked_up(batch)
            times = np.where(there, times, 0)
            own = [sums(times * x[at], bounds) if len(n) else np.zeros(len(bounds) - 1, np.int64) for x in (is_best, n)]
            columns = [batch.column(c) for c in kept] + [pa.array(x) for x in own]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum"])

    def cold(batches):
        for batch in batches:
            bounds, _, there, times = looked_up(batch)
            rest = np.flatnonzero(~there)
            row = np.repeat(np.asarray(batch.column("_row")), np.diff(bounds))[rest]
            yield pa.RecordBatch.from_arrays([pa.array(row), batch.column("pairs").flatten().take(pa.array(rest)), pa.array(times[rest])], names=["_row", "pair", "times"])

    ddl = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in kept)
    out = stored.mapInArrow(hot, f"{ddl}, n_best long, count_sum long")
    others = counts.where(~is_hot)
    if others.isEmpty():
        return out.drop("_row")
    others = others.join(F.broadcast(highest), F.floor(F.col("pair") / F.lit(width)) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    joined = stored.select("_row", "pairs", "times").mapInArrow(cold, "_row long, pair long, times long").join(others, "pair")
    rest = joined.groupBy("_row").agg(F.sum(F.col("times") * F.col("is_best")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    out = out.join(rest, "_row", "left")
    for name, more in (("n_best", "_best"), ("count_sum", "_sum")):
        out = out.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return out.drop("_row", "_best", "_sum")
