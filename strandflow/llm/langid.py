"""Language of texts and of spans of mixed-language text.

A word's script (ranges of code points) narrows the languages it can be in to those that use the script
in the training rows. Character n-grams give the word a log-probability in each of them. A Viterbi pass
over a text's words, with a fixed penalty for each switch of language, labels the spans; the text's
language is the one with most letters. The score is a share, no confidence: that is the share of the words'
longest n-grams that the languages of their spans were seen with, near 1 in a learned language and low in
others, in a script that was not learned, and in gibberish.

The pass works on blocks of words of many texts side by side: first each block's best scores from every
entry state to every exit state, which compose by (max, +) along a text, then the states inside each
block. The model is learned from a bounded sample of labelled rows: n-gram counts for each language.

A word is a run without U+0020 and U+0009 to U+000D; words without a letter carry no evidence. Texts
that are null or have no letter get `und` and score 0. Ties go to the language that sorts first. Null
languages teach nothing; with no language learned every text is `und`. Rows keep their doc_id, null or
repeated (one that is null teaches nothing and is not held out by the query); further columns are ignored; an
empty table gives no rows. Very long texts are taken in parts, with the same result.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carry, Growing, Numbers, held, offsets, sums, text_slices, with_kept
from .labelled import bounded_sample

#: Labelled rows of each language that are learned from at most (expected number).
SAMPLE_ROWS = 1000
#: n-gram lengths; words are marked at both ends.
GRAMS = (1, 2, 3)
#: Log-probability lost by each switch of language.
SWITCH = 12.0
#: A language uses a script if this share of its letters has it.
SCRIPT_SHARE = 0.01
#: An n-gram was seen with a language if this share of its n-grams are this one: a larger sample holds more by chance.
SEEN_SHARE = 2e-5
TABLE_WORDS = 300_000
BLOCK = 64
#: Bytes of arrays that the pass works on at once.
PART_BYTES = 32 << 20
UNKNOWN = "und"

#: First and last code point of ranges of scripts; other letters are of script 0.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF),
    ("burmese", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF),
    ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("han", 0x20000, 0x2FA1F),
)
SCRIPTS = ("other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))
_BY_START = sorted((a, b, SCRIPTS.index(name)) for name, a, b in SCRIPT_RANGES)
_STARTS, _ENDS, _SCRIPTS = (np.array(x) for x in zip(*_BY_START, strict=True))


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point (of a letter)."""
    at = np.maximum(np.searchsorted(_STARTS, points, side="right") - 1, 0)
    return np.where((points >= _STARTS[at]) & (points <= _ENDS[at]), _SCRIPTS[at], 0)


#: Letters and what Python's re counts among them besides.
RUNS = re.compile(r"[^\W\d_]+")


def letters_of(word: bytes) -> str:
    """The word's lower-case letters; what is between them becomes one space."""
    text = word.decode("utf-8", "replace").lower()
    if text.isalpha():
        return text
    text = " ".join(RUNS.findall(text))
    if text.isascii():
        return text
    return " ".join("".join(c if c.isalpha() else " " for c in text).split())


def coded(letters: list[str]):
    """What the words look like side by side, each with a space at both ends: code points, the words' bounds,
    and for each n the n-grams' numbers (21 bits for each character) and the places at which one begins."""
    lengths = np.fromiter(map(len, letters), np.int64, len(letters)) + 2
    points = np.frombuffer("".join(f" {x} " for x in letters).encode("utf-32-le"), "<u4").astype(np.uint64)
    bounds = offsets(lengths)
    left = np.repeat(bounds[1:], lengths) - np.arange(len(points))
    codes, grams = np.zeros(len(points), np.uint64), {}
    for n in range(1, max(GRAMS) + 1):
        codes = (codes << np.uint64(21)) | np.append(points[n - 1 :], np.zeros(n - 1, np.uint64))[: len(points)]
        if n in GRAMS:
            grams[n] = codes, np.flatnonzero(left >= n)
    return points, bounds, grams


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model from labelled rows: languages, n-gram log-probabilities, the scripts of each language."""
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    sample = bounded_sample(named, "key", "lang", sample_rows)

    def count(batches):
        from collections import Counter

        for part, texts in text_slices(batches):
            words: dict[str, Counter] = {}
            for name, one in zip(part.column(part.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
                words.setdefault(name, Counter()).update(one.split())
            for name, own in words.items():
                letters = list(map(letters_of, own))
                points, bounds, grams = coded(letters)
                times = np.repeat(np.fromiter(own.values(), np.int64, len(own)), np.diff(bounds))
                empty = np.repeat(np.diff(bounds) == 2, np.diff(bounds))
                inside = np.flatnonzero(~empty & (points != 0x20))
                found = [(0, scripts_of(points[inside]).astype(np.uint64), times[inside])]
                for n, (codes, at) in grams.items():
                    at = at[~empty[at]]
                    found.append((n, codes[at], times[at]))
                for n, codes, weights in found:
                    distinct, at = np.unique(codes, return_inverse=True)
                    total = np.bincount(at, weights, len(distinct)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(distinct), pa.string()), pa.array(np.full(len(distinct), n, np.int32)), pa.array(distinct.view(np.int64)), pa.array(total)], names=["lang", "n", "code", "times"])

    # Bounded by the sample: its n-grams of at most three characters, and its letters by script (n = 0).
    counted = sample.mapInArrow(count, "lang string, n int, code long, times long").groupBy("lang", "n", "code").agg(F.sum("times").alias("times")).toArrow()
    names, lengths, found, times = (counted.column(c) for c in ("lang", "n", "code", "times"))
    languages = sorted(set(names.to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    lang_of = np.fromiter(map(place.__getitem__, names.to_pylist()), np.int64, len(names))
    lengths, found, times = np.asarray(lengths), np.asarray(found).view(np.uint64), np.asarray(times)
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    own = lengths == 0
    np.add.at(scripts, (found[own].astype(np.int64), lang_of[own]), times[own])
    codes, tables, seen, at = {}, [], [], 0
    for n in GRAMS:
        own = lengths == n
        known, row = np.unique(found[own], return_inverse=True)
        counts = np.zeros((len(known), len(languages)))
        np.add.at(counts, (row, lang_of[own]), times[own])
        # Of each length the n-grams as sorted numbers, and their rows of the table.
        codes[n] = known, at + np.arange(len(known))
        tables.append(np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(known) + 1))))
        seen.append((counts > 0) & (counts >= SEEN_SHARE * counts.sum(axis=0)))
        at += len(known)
    table = np.concatenate(tables).astype(np.float32)
    # A new n-gram says nothing; others are taken against the mean of the languages.
    if len(languages):
        table -= table.mean(axis=1, keepdims=True)
    used = scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE
    return {"languages": languages, "codes": codes, "table": table, "seen": np.concatenate(seen).astype(np.float32), "scripts": used, "id": uuid.uuid4().hex}


class Scorer:
    """The model, with scores and letters of each distinct word met."""

    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.numbers, self.letters = Numbers(), Growing(np.int64)
        self.scores = Growing(np.float32, max(1, len(self.model["languages"])))
        self.seen, self.grams = Growing(np.float32, max(1, len(self.model["languages"]))), Growing(np.int64)

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' words, and each text's number of words."""
        numbers, counts = self.numbers.of_texts(texts)
        if fresh := self.numbers.fresh:
            self.numbers.fresh = []
            letters = list(map(letters_of, fresh))
            self.letters.extend([len(x) - x.count(" ") for x in letters])
            if self.model["languages"]:
                scores, seen, grams = self.score(letters)
                self.scores.extend(scores)
                self.seen.extend(seen)
                self.grams.extend(grams)
        return numbers, counts

    def score(self, letters: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' scores, from the n-grams of all of them side by side; how many of their longest n-grams
        each language was seen with, and how many they have (0 without a letter)."""
        table = self.model["table"]
        points, bounds, grams = coded(letters)
        total = np.zeros((len(points), table.shape[1]), np.float32)
        for n, (codes, at) in grams.items():
            known, rows = self.model["codes"][n]
            if len(known):
                found = np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)
                same = known[found] == codes[at]
                total[at[same]] += table[rows[found[same]]]
        scores = sums(total.astype(np.float64), bounds) / len(GRAMS)
        empty = np.diff(bounds) == 2
        codes, at = grams[max(GRAMS)]
        known, rows = self.model["codes"][max(GRAMS)]
        met = np.zeros((len(points), table.shape[1]), np.float32)
        if len(known):
            found = np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)
            same = known[found] == codes[at]
            met[at[same]] = self.model["seen"][rows[found[same]]]
        seen = sums(met.astype(np.float64), bounds)
        n_grams = np.where(empty, 0, np.diff(bounds) - max(GRAMS) + 1)
        scores[empty] = 0
        # Languages that don't use any of a word's scripts are out, unless none does.
        bits = np.where(points == 0x20, 0, np.int64(1) << scripts_of(points).astype(np.int64))
        masks = np.bitwise_or.reduceat(bits, bounds[:-1]) if len(letters) else np.zeros(0, np.int64)
        for mask in np.unique(masks[~empty]):
            fits = self.model["scripts"][[s for s in range(len(SCRIPTS)) if mask >> s & 1]].any(axis=0)
            if fits.any() and not fits.all():
                own = np.flatnonzero(masks == mask)
                scores[np.ix_(own, np.flatnonzero(~fits))] = (scores[own].min(axis=1) - SWITCH)[:, None]
        return scores, seen, n_grams


class Gathered:
    """Rows of a table by numbers, taken only when a slice is asked for."""

    def __init__(self, table: np.ndarray, numbers: np.ndarray):
        self.table, self.numbers, self.shape = table, numbers, (len(numbers), table.shape[1])

    def __getitem__(self, own: slice) -> np.ndarray:
        return self.table[self.numbers[own]]


class Blocks:
    """The words of some texts in blocks side by side, each block the next words of one text.

    first: the blocks' numbers at which texts begin; blocks of a text follow each other."""

    def __init__(self, scores, sizes: np.ndarray, firsts: np.ndarray, penalty: float, block: int):
        self.penalty, self.block, self.n = penalty, block, len(sizes)
        self.inside = np.arange(block) < sizes[:, None]
        at = np.minimum(offsets(sizes)[:-1, None] + np.arange(block), len(scores) - 1)
        self.scores = np.where(self.inside[:, :, None], scores[at], 0)
        self.n_states = scores.shape[1]
        # The blocks that are n-th in their texts, for n = 1, 2, ...: of fewer and fewer texts.
        lengths = np.diff(np.append(firsts, self.n))
        order = np.argsort(-lengths, kind="stable")
        self.firsts, left = firsts[order], np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), side="left")
        self.rounds = [self.firsts[:n] + i + 1 for i, n in enumerate(left.tolist()) if n]
        self.last = firsts + lengths - 1

    def enter_values(self, first: np.ndarray | None) -> np.ndarray:
        """Each block's best score so far by the state before its first word; `first` is that of the first block."""
        s = self.n_states
        enter = np.zeros((self.n, s))
        if first is not None:
            enter[0] = first
        if self.rounds:
            # Best score of each block from an entry state to an exit state; these compose along a text.
            best = np.full((self.n, s, s), -np.inf)
            best[:, np.arange(s), np.arange(s)] = 0
            for k in range(self.block):
                moved = np.maximum(best, best.max(axis=2, keepdims=True) - self.penalty) + self.scores[:, k, None, :]
                best = np.where(self.inside[:, k, None, None], moved, best)
            for own in self.rounds:
                enter[own] = (enter[own - 1][:, :, None] + best[own - 1]).max(axis=1)
        return enter

    def forward(self, enter: np.ndarray, note: bool) -> np.ndarray:
        """The scores behind each block; with `note`, from which state each state was best reached."""
        value, rows = enter, np.arange(self.n)
        self.came = np.empty((self.block, self.n, self.n_states), np.int8 if self.n_states < 128 else np.int32) if note else None
        for k in range(self.block):
            top = value.argmax(axis=1)
            switched = value[rows, top] - self.penalty
            stays = value >= switched[:, None]
            if note:
                self.came[k] = np.where(self.inside[:, k, None] & ~stays, top[:, None], np.arange(self.n_states))
            value = np.where(self.inside[:, k, None], np.where(stays, value, switched[:, None]) + self.scores[:, k], value)
        return value

    def backward(self, value: np.ndarray, leave_last: int | None) -> tuple[np.ndarray, int]:
        """The state of every word, and the one before the first; leave_last: the last block's, where its text goes on."""
        # The entry state that each exit state of a block leads back to, then the real exit states.
        back = np.tile(np.arange(self.n_states), (self.n, 1))
        rows = np.arange(self.n)
        for k in range(self.block - 1, -1, -1):
            back = self.came[k][rows[:, None], back]
        leave = np.zeros(self.n, np.int64)
        leave[self.last] = value[self.last].argmax(axis=1)
        if leave_last is not None:
            leave[-1] = leave_last
        for own in reversed(self.rounds):
            leave[own - 1] = back[own, leave[own]]
        states = np.empty((self.n, self.block), np.int64)
        for k in range(self.block - 1, -1, -1):
            states[:, k] = leave
            leave = self.came[k][rows, leave]
        return states[self.inside], int(leave[0])


def viterbi(scores, counts: np.ndarray, penalty: float = SWITCH, block: int = BLOCK, part_bytes: int = PART_BYTES) -> np.ndarray:
    """The best state of every word: scores (words, states), counts of words of each text; a switch costs penalty.

    Blocks are taken in parts of about part_bytes of arrays, however long a text or many the states: forwards,
    keeping the scores at which each part begins, and then backwards through the parts once more."""
    n_states = scores.shape[1]
    blocks_of = -(-counts // block)
    n_blocks = int(blocks_of.sum())
    if not n_blocks:
        return np.zeros(0, np.int64)
    first_block = offsets(blocks_of)[:-1]
    text_of = np.repeat(np.arange(len(counts)), blocks_of)
    within = np.arange(n_blocks) - first_block[text_of]
    sizes = np.minimum(block, counts[text_of] - within * block)
    begins = offsets(sizes)
    step = max(1, part_bytes // (n_states * (8 * n_states + 9 * block)))
    parts = [(a, min(a + step, n_blocks)) for a in range(0, n_blocks, step)]

    def part(i: int) -> Blocks:
        a, b = parts[i]
        firsts = np.flatnonzero(np.append(True, within[a + 1 : b] == 0))
        return Blocks(scores[begins[a] : begins[b]], sizes[a:b], firsts, penalty, block)

    goes_on = lambda i: i < len(parts) and within[parts[i][0]] > 0
    enters: list[np.ndarray | None] = [None]
    for i in range(len(parts) - 1):
        enters.append(None)
        if goes_on(i + 1):
            own = part(i)
            enters[i + 1] = own.forward(own.enter_values(enters[i]), False)[-1]
    out, leave = [], None
    for i in reversed(range(len(parts))):
        own = part(i)
        value = own.forward(own.enter_values(enters[i]), True)
        states, before = own.backward(value, leave if goes_on(i + 1) else None)
        out.append(states)
        leave = before
    return np.concatenate(out[::-1])


def detect(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", penalty: float = SWITCH, keep=None) -> DataFrame:
    """doc_id, lang_pred, score (its share of the letters), confidence (0 to 1: how well the words are known in the
    languages of their spans), and spans: array of (lang, first word, words) of every text.

    With keep, a condition over these columns: the rows of docs where it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample learned from
    languages = model["languages"]
    carry = Carry(docs, key, text, docs.columns if keep is not None else [])
    source = carry.source
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        model = shared.value
        scorer = held(model["id"], lambda: Scorer(model))
        names = pa.array([*languages, UNKNOWN], pa.string())
        for part, texts in text_slices(batches):
            if scorer.numbers.full(TABLE_WORDS):
                scorer.clear()
            numbers, counts = scorer.of(texts)
            bounds, n_words = offsets(counts), len(numbers)
            letters = scorer.letters.view()[numbers]
            if languages:
                states = viterbi(Gathered(scorer.scores.view(), numbers), counts, penalty)
            else:
                states = np.zeros(n_words, np.int64)
            of_text = np.repeat(np.arange(len(counts)), counts)
            width = max(1, len(languages))
            share = np.bincount(of_text * width + states, letters, len(counts) * width).reshape(len(counts), width)
            total = share.sum(axis=1)
            known = (total > 0) & bool(languages)
            pred = np.where(known, share.argmax(axis=1), len(languages))
            score = np.where(known, share.max(axis=1) / np.maximum(total, 1), 0.0)
            sure = np.zeros(len(counts))
            if languages:
                grams = np.bincount(of_text, scorer.grams.view()[numbers], len(counts))
                sure = np.bincount(of_text, scorer.seen.view()[numbers, states] * (letters > 0), len(counts)) / np.maximum(grams, 1)
            # A span begins with a text and where the state changes; texts without letters have none.
            starts = np.ones(n_words, bool)
            starts[1:] = (states[1:] != states[:-1]) | (of_text[1:] != of_text[:-1])
            starts &= known[of_text]
            first = np.flatnonzero(starts)
            end = np.append(first[1:], n_words)
            end = np.minimum(end, bounds[of_text[first] + 1])
            made = pa.StructArray.from_arrays([names.take(pa.array(states[first])), pa.array(first - bounds[of_text[first]]), pa.array(end - first)], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(offsets(np.bincount(of_text[first], minlength=len(counts))), pa.int32()), made)
            yield with_kept(part, {"doc_id": part.column(0), "lang_pred": names.take(pa.array(pred)), "score": pa.array(score, pa.float64()), "confidence": pa.array(np.where(known, sure, 0.0), pa.float64()), "spans": lists}, source)

    found = carry.rows.mapInArrow(run, carry.schema("doc_id long, lang_pred string, score double, confidence double, spans array<struct<lang: string, first_word: long, n_words: long>>"))
    return found if keep is None else found.where(keep).select(*carry.columns())
