"""Licence notices in texts: winnowed fingerprints pick candidates, banded alignment measures them.

Texts and templates become words: runs of ASCII letters, digits and non-ASCII characters, in lower
case. Of every GRAM adjacent words' hash, winnowing keeps the smallest of each WINDOW in a row; the
templates' kept hashes are an inverted index (a few thousand entries, the same size for any input).
A text's kept hashes that are in the index fall into clusters of one template and nearly one diagonal.
A cluster with enough of the template's fingerprints is aligned with the text in a band around it; the
alignment gives the share of the template's words found in order, and the span in the text. Any run of
GRAM + WINDOW - 1 words common to text and template gives a fingerprint of the template in the text; a
candidate needs CANDIDATE_SHARE of the template's fingerprints near one diagonal, so a few sentences of a
long notice are none. Where other words divide a notice, its pieces are clusters of their own: they are aligned by
themselves and chained in order of text and template, with up to MOST_BETWEEN words between two. Statements of up to SHORT_WORDS words must be there word for word: one word tells licences apart.

One row for each notice found; of notices that overlap in the text by more than half of the shorter
one, only the one with most words matched (then the highest coverage, then the first name) is reported.
Null and empty texts have none. Rows with a null doc_id are reported under null; repeated rows repeat;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, text_slices
from .license_templates import TEMPLATES

GRAM, WINDOW = 3, 3
#: Words by which an alignment may leave the diagonal.
BAND = 16
#: The share of a template's fingerprints that makes a cluster a candidate; the coverage that is reported.
CANDIDATE_SHARE, LEAST_COVERAGE = 0.3, 0.6
#: The share of a template's fingerprints that makes a piece of a notice; how many words may stand between two pieces.
PIECE_SHARE, MOST_BETWEEN = 0.1, 256
#: Templates of up to so many words are reported only with all of them and no other between.
SHORT_WORDS = 12
#: Alignment scores.
MATCH, MISMATCH, GAP = 2, -1, -1

#: Bytes that are not in words become spaces, ASCII capitals small.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(numbers: np.ndarray) -> np.ndarray:
    """A hash of each GRAM adjacent word numbers; NEVER where one of them is -1."""
    n = len(numbers) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            own = numbers[k : k + n]
            known &= own >= 0
            out = (out ^ (own.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.where(known, out, NEVER)


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash of each WINDOW in a row (the last of equals; fewer: of all), without NEVER."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        at = np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
        at = np.unique(np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1))
    return at[hashes[at] != NEVER]


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = [templates[n].encode().translate(TABLE).split() for n in self.names]
        vocabulary: dict[bytes, int] = {}
        self.templates = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], np.int64) for own in words]
        self.vocabulary = vocabulary
        entries = []
        self.sizes = []
        for t, numbers in enumerate(self.templates):
            hashes = gram_hashes(numbers)
            at = winnowed(hashes)
            self.sizes.append(len(at))
            entries += [(int(hashes[i]), t, int(i)) for i in at]
        entries.sort()
        self.hashes = np.array([e[0] for e in entries], np.uint64)
        self.template_of = np.array([e[1] for e in entries], np.int64)
        self.position_of = np.array([e[2] for e in entries], np.int64)

    def scan(self, numbers: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(template, coverage, matched, first word, last word) of notices in a text, given its kept hashes at `at`."""
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        hits = [(int(self.template_of[e]), int(i - self.position_of[e]), int(i)) for i, a, b in zip(at.tolist(), low.tolist(), high.tolist()) for e in range(a, b)]
        hits.sort()
        found, i = [], 0
        pieces: dict[int, list[tuple[int, int, int, int, int]]] = {}
        while i < len(hits):
            # A cluster: hits of one template, each diagonal within BAND of the one before.
            j = i + 1
            while j < len(hits) and hits[j][0] == hits[i][0] and hits[j][1] - hits[j - 1][1] <= BAND:
                j += 1
            t, n = hits[i][0], len(self.templates[hits[i][0]])
            positions = {h[2] - h[1] for h in hits[i:j]}
            if len(positions) >= max(1, CANDIDATE_SHARE * self.sizes[t]):
                # A long cluster can hold several notices one after another; each is aligned by itself.
                diagonals = sorted({h[1] for h in hits[i:j]})
                taken = -1 << 60
                for d in diagonals:
                    if d - taken > BAND // 2:
                        taken = d
                        if aligned := align(self.templates[t], numbers, d):
                            matched, first, last = aligned
                            if matched == last - first + 1 == n if n <= SHORT_WORDS else matched / n >= LEAST_COVERAGE:
                                found.append((t, matched / n, matched, first, last))
            if n > SHORT_WORDS and len(positions) >= max(2, PIECE_SHARE * self.sizes[t]):
                pieces.setdefault(t, []).extend(self.pieces(t, hits[i:j], numbers))
            i = j
        for t, own in pieces.items():
            found += self.chained(t, own)
        return self.best(found)

    def pieces(self, t: int, hits: list[tuple[int, int, int]], numbers: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(first word, last word, template from, to, matched) of the parts of a template that a cluster (in order of diagonals)
        holds: fingerprints within BAND // 2 of a diagonal, with at most BAND words of the template between one and the next."""
        template, out, i = self.templates[t], [], 0
        while i < len(hits):
            j = i + 1
            while j < len(hits) and hits[j][1] - hits[i][1] <= BAND // 2:
                j += 1
            own = sorted((h[2] - h[1], h[1]) for h in hits[i:j])
            i, a = j, 0
            while a < len(own):
                b = a + 1
                while b < len(own) and own[b][0] - own[b - 1][0] <= BAND:
                    b += 1
                if len({p for p, _ in own[a:b]}) >= max(2, PIECE_SHARE * self.sizes[t]):
                    diagonals = sorted(d for _, d in own[a:b])
                    middle, low, high = diagonals[len(diagonals) // 2], own[a][0], own[b - 1][0] + GRAM
                    while low > 0 and middle + low > 0 and numbers[middle + low - 1] == template[low - 1]:
                        low -= 1
                    while high < len(template) and middle + high < len(numbers) and numbers[middle + high] == template[high]:
                        high += 1
                    if aligned := align(template[low:high], numbers, middle + low):
                        out.append((aligned[1], aligned[2], low, high, aligned[0]))
                a = b
        return out

    def chained(self, t: int, pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
        """Notices that other words divide: pieces of one template in order in text and template, not more than MOST_BETWEEN words apart."""
        n, pieces = len(self.templates[t]), sorted(pieces)
        best: list[tuple[int, int]] = []  # matched words of the best chain that ends here, and the piece before
        for i, (first, _, low, _, matched) in enumerate(pieces):
            total, before = matched, -1
            for j in range(i - 1, -1, -1):
                if first - pieces[j][0] > MOST_BETWEEN + 2 * n:
                    break
                apart, shared = first - pieces[j][1] - 1, max(0, pieces[j][3] - low)
                if 0 <= apart <= MOST_BETWEEN and shared <= GRAM and best[j][0] + matched - shared > total:
                    total, before = best[j][0] + matched - shared, j
            best.append((total, before))
        out = []
        for i, (total, before) in enumerate(best):
            if before >= 0 and total / n >= LEAST_COVERAGE:
                j = i
                while best[j][1] >= 0:
                    j = best[j][1]
                out.append((t, total / n, total, pieces[j][0], pieces[i][1]))
        return out

    def best(self, found: list[tuple[int, float, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
        """Of notices that overlap by more than half of the shorter one, only the best; what is kept is looked up by its place."""
        span = max((f[4] - f[3] + 1 for f in found), default=1)
        kept: dict[int, list[tuple[int, float, int, int, int]]] = {}
        for one in sorted(found, key=lambda f: (-f[2], -f[1], self.names[f[0]], f[3])):
            a, b = one[3], one[4]
            # None is longer than span, so what overlaps begins in this stretch or in one beside it.
            near = (k for i in range(a // span - 1, b // span + 1) for k in kept.get(i, ()))
            if all(2 * (min(b, k[4]) - max(a, k[3]) + 1) <= min(b - a, k[4] - k[3]) + 1 for k in near):
                kept.setdefault(a // span, []).append(one)
        return sorted((k for own in kept.values() for k in own), key=lambda f: (f[3], f[4]))


def align(template: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Matched words, first and last matched word in the text, of the best alignment of the whole template
    to any part of the text, template word i to text words diagonal + i - BAND to diagonal + i + BAND."""
    n, width = len(template), 2 * BAND + 1
    low = -(10**6)
    # best[i, c]: template words before i used, text position diagonal + i - BAND + c reached.
    best = np.full((n + 1, width), low, np.int64)
    column = np.arange(width)
    reach = diagonal - BAND + column
    best[0, (reach >= 0) & (reach <= len(text))] = 0
    for i in range(1, n + 1):
        reach = diagonal + i - BAND + column
        word = reach - 1
        there = (word >= 0) & (word < len(text))
        same = there & (text[np.clip(word, 0, max(0, len(text) - 1))] == template[i - 1])
        own = np.where(there, best[i - 1] + np.where(same, MATCH, MISMATCH), low)
        skipped = np.append(best[i - 1, 1:], low) + GAP  # the template's word is left out
        own = np.maximum(own, np.where((reach >= 0) & (reach <= len(text)), skipped, low))
        own = np.maximum.accumulate(own - GAP * column) + GAP * column  # text words are left out
        best[i] = np.where((reach >= 0) & (reach <= len(text)), own, low)
    c = int(best[n].argmax())
    if best[n, c] <= 0:
        return None
    matched, first, last, i = 0, -1, -1, n
    while i > 0:
        word = diagonal + i - BAND + c - 1
        same = 0 <= word < len(text) and text[word] == template[i - 1]
        if 0 <= word < len(text) and best[i, c] == best[i - 1, c] + (MATCH if same else MISMATCH):
            if same:
                matched, first, last = matched + 1, word, word if last < 0 else last
            i -= 1
        elif c + 1 < width and best[i, c] == best[i - 1, c + 1] + GAP:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return (matched, first, last) if matched else None


@cache
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the text begins and ends, in characters."""
    word = np.frombuffer(b" " + text.translate(TABLE) + b" ", np.uint8) != 0x20
    begins, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    chars = offsets(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    return chars[begins], chars[ends]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched_words, begin, end (characters of the text) of every notice found."""
    given = tuple(sorted(templates.items()))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        index = index_of(given)
        get = index.vocabulary.get
        for part, texts in text_slices(batches):
            words: list[bytes] = []
            counts = np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                own = t.translate(TABLE).split() if t else []
                counts[i] = len(own)
                words += own
            numbers = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            bounds = offsets(counts)
            # Texts with GRAM words of the vocabulary in a row; others can have no fingerprint.
            known = gram_hashes(numbers) != NEVER
            texts_hit = np.unique(np.searchsorted(bounds, np.flatnonzero(known), side="right") - 1)
            rows = []
            for i in texts_hit.tolist():
                own = numbers[bounds[i] : bounds[i + 1]]
                hashes = gram_hashes(own)
                at = winnowed(hashes)
                if found := index.scan(own, at, hashes[at]):
                    begins, ends = word_bounds(texts[i])
                    doc_id = part.column(0)[i].as_py()
                    rows += [(doc_id, index.names[t], coverage, matched, int(begins[first]), int(ends[last])) for t, coverage, matched, first, last in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, license string, coverage double, matched_words long, begin long, end long")
