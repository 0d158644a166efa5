"""Quality rules: counts with fixed limits, then a calibrated n-gram logistic regression.

Words are runs without U+0020 and U+0009 to U+000D. The regression's features are hashed word, word
pair and character n-gram counts, each divided by the text's words; it is fitted on a bounded sample of
labelled rows and calibrated on another part of it (Platt); each row weighs as many as it stands for, so
that probabilities mean the same at every size. A text is scored in Arrow batches: what one
word adds is computed once per distinct word and kept in a bounded table per worker.

Null and empty texts have no words: all counts 0, base_failed, not kept. Where no label of both kinds
is there, the model's verdict is to keep. Rows keep their doc_id, null or repeated; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Carry, Growing, Numbers, held, offsets, spread, sums, text_slices, with_kept
from .labelled import bounded_sample, hash_share, logistic, platt, sigmoid

#: Fixed limits.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: The symbols that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
#: A text is kept if its calibrated probability of good quality is at least this.
LEAST_PROBABILITY = 0.5
#: Labelled rows of each label that the model is fitted on at most (expected number); a quarter calibrates.
SAMPLE_ROWS = 2500
FEATURES = 1 << 18
#: Bytes of the sampled rows' texts of each label (expected): where they have more, fewer rows are taken, each of them whole.
#: A byte gives about one feature of 8 bytes, and a row at most FEATURES, so this bounds what the driver fits on.
SAMPLE_BYTES = 8 << 20
GRAMS = (2, 3)
TABLE_WORDS = 300_000
L2 = 1e-5
SCALE = 8.0


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(31)
        return x * np.uint64(0xD6E8FEB86659FD93)


def hashed(items: list[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(i, seed) for i in items), np.uint64, len(items))


def word_features(words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each word, one word after another, and how many each has: the word itself and the
    GRAMS bytes in a row that it has, both ends marked."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    marked = np.frombuffer(b"".join(b"\x02%b\x03" % w for w in words), np.uint8).astype(np.uint64)
    bounds = offsets(lengths)
    left = np.repeat(bounds[1:], lengths) - np.arange(len(marked))
    found, of_word = [hashes], [np.arange(len(words))]
    own = np.repeat(np.arange(len(words)), lengths)
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, np.uint64)
        for i in range(n):
            code = code << np.uint64(8) | marked[at + i]
        found.append(mix(code, np.uint64(n)))
        of_word.append(own[at])
    of_word = np.concatenate(of_word)
    order = np.argsort(of_word, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(FEATURES)).astype(np.int64), np.bincount(of_word, minlength=len(words))


class Words:
    """What is known of each distinct word; weights may be None while counting only."""

    def __init__(self, weights: np.ndarray | None):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.numbers, self.chars, self.symbols = Numbers(), Growing(np.int64), Growing(np.int64)
        self.hashes, self.adds = Growing(np.uint64), Growing(np.float64)

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' words, and each text's number of words."""
        numbers, counts = self.numbers.of_texts(texts)
        if fresh := self.numbers.fresh:
            self.numbers.fresh = []
            self.chars.extend([len(w) - sum(map(w.count, CONTINUATION)) if not w.isascii() else len(w) for w in fresh])
            self.symbols.extend([len(w) - len(w.translate(None, SYMBOLS)) for w in fresh])
            self.hashes.extend(hashed(fresh, 7))
            if self.weights is not None:
                features, n_features = word_features(fresh, self.hashes.view()[-len(fresh) :])
                self.adds.extend(sums(self.weights[features].astype(np.float64), offsets(n_features)))
        return numbers, counts


#: UTF-8 continuation bytes.
CONTINUATION = [bytes([b]) for b in range(0x80, 0xC0)]


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """In each text, the words in a WINDOW-word window that occurs at least twice in it (by 64-bit hash within the text)."""
    n, bounds = len(hashes), offsets(counts)
    if n < WINDOW:
        return np.zeros(len(counts), np.int64)
    of_text = np.repeat(np.arange(len(counts)), counts)
    windows = mix(hashes[: n - WINDOW + 1], of_text[: n - WINDOW + 1].astype(np.uint64))
    for k in range(1, WINDOW):
        windows = mix(windows, hashes[k : n - WINDOW + 1 + k])
    begins = np.flatnonzero(of_text[: n - WINDOW + 1] == of_text[WINDOW - 1 :])
    windows = windows[begins]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(begins), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    change[begins[twice]] += 1
    change[begins[twice] + WINDOW] -= 1
    return sums((np.cumsum(change[:-1]) > 0).astype(np.int64), bounds)


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def pair_features(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each two adjacent words of a text, and the texts they are in; all repeats of a word share one."""
    of_text = np.repeat(np.arange(len(counts)), counts)
    inside = of_text[1:] == of_text[:-1]
    one, other = hashes[:-1][inside], hashes[1:][inside]
    pairs = np.where(one == other, np.uint64(0), mix(one, other))
    return (pairs % np.uint64(FEATURES)).astype(np.int64), of_text[1:][inside]


def numbers_in(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers in all values of a binary column, one after another."""
    out = np.empty(int(pa.compute.sum(pa.compute.binary_length(column)).as_py() or 0) // np.dtype(kind).itemsize, kind)
    at = 0
    for chunk in column.chunks:
        for value in chunk:
            own = np.frombuffer(value.as_buffer(), kind)
            out[at : at + len(own)] = own
            at += len(own)
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> dict | None:
    """The model: weights (float32), bias, the calibration's a and b; None without labels of both kinds."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    marked = bounded_sample(marked.groupBy("key").agg(F.min("label").alias("label")), "key", "label", sample_rows, "weight")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(marked), "key").select(F.xxhash64("key").alias("hash"), "text", "label", "weight", (hash_share("key", 5) < 0.25).alias("calibrates"), hash_share("key").alias("place"))
    # At most twice sample_rows keys. Chosen rows' places are below 1 / weight; those below a share of that stay.
    sizes = rows.groupBy("hash", "label").agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()
    for mark in (0, 1):
        share = min(1.0, sample_bytes / max(1, sum(r.bytes for r in sizes if r.label == mark)))
        rows = rows.where((F.col("label") != mark) | (F.col("place") * F.col("weight") < share)).withColumn("weight", F.when(F.col("label") == mark, F.col("weight") / share).otherwise(F.col("weight")))
    rows = rows.drop("place")
    if any(r.n > 1 for r in sizes):
        # One text for each key, however many rows share it.
        rows = rows.groupBy("hash", "label", "weight", "calibrates").agg(F.min("text").alias("text"))

    def run(batches):
        for part, texts in text_slices(batches, limit=SLICE_BYTES // 4):  # many features stand for a byte
            known = Words(None)
            numbers, counts = known.of(texts)
            hashes = known.hashes.view()[numbers]
            pairs, of_text = pair_features(hashes, counts)
            each, lengths = word_features(list(known.numbers), known.hashes.view())
            flat = each[spread(offsets(lengths)[numbers], lengths[numbers])] if len(numbers) else np.zeros(0, np.int64)
            rows = np.concatenate((np.repeat(np.repeat(np.arange(len(counts)), counts), lengths[numbers]), of_text))
            cells, found = np.unique(rows * FEATURES + np.concatenate((flat, pairs)), return_counts=True)
            values = (found / np.maximum(counts, 1)[cells // FEATURES]).astype(np.float32)
            bounds = offsets(np.bincount(cells // FEATURES, minlength=len(counts)))
            columns = (cells % FEATURES).astype(np.int32)
            made = {c: part.column(part.schema.get_field_index(c)) for c in ("hash", "label", "weight", "calibrates")}
            for name, flat in (("columns", columns), ("values", values)):
                made[name] = pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    # The bound: rows of about twice sample_bytes, twice sample_rows at most; in a fixed order, for sums depend on it.
    sample = rows.mapInArrow(run, "hash long, label int, weight double, calibrates boolean, columns binary, values binary").toArrow().sort_by([("hash", "ascending"), ("columns", "ascending")])
    marks = np.asarray(sample.column("label").to_pylist(), np.float64)
    weigh = np.asarray(sample.column("weight").to_pylist(), np.float64)
    calibrates = np.asarray(sample.column("calibrates").to_pylist(), bool)
    if min(sum(marks[~calibrates] == v) for v in (0, 1)) < 1 or len(marks) < 4:
        return None
    per = np.asarray(pa.compute.binary_length(sample.column("columns")), dtype=np.int64) // 4
    columns, values = numbers_in(sample.column("columns"), np.int32), numbers_in(sample.column("values"), np.float32)
    del sample  # one copy of the features is held from here on
    pa.default_memory_pool().release_unused()
    values *= np.float32(SCALE)
    bounds, of_fit = offsets(per), np.repeat(~calibrates, per)
    row = np.repeat(np.arange((~calibrates).sum(), dtype=np.int32), per[~calibrates])
    weights, bias = logistic(row, columns[of_fit], values[of_fit], int((~calibrates).sum()), FEATURES, marks[~calibrates], L2, per_row=weigh[~calibrates])
    scores = np.array([weights[columns[a:b]] @ values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]) + bias
    held = calibrates if len(set(marks[calibrates])) == 2 else ~calibrates
    a, b = platt(scores[held], marks[held], weights=weigh[held])
    return {"weights": (weights * SCALE).astype(np.float32), "bias": bias, "a": a, "b": b, "id": uuid.uuid4().hex}


def judged(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text", least: float = LEAST_PROBABILITY, only_kept: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept of every row.

    With only_kept: the rows of docs that are kept."""
    carry = Carry(docs, key, text, docs.columns if only_kept else [])
    source = carry.source
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats

    def run(batches):
        model = shared.value
        known = held(model["id"] if model else "counts", lambda: Words(model["weights"] if model else None))
        for part, texts in text_slices(batches):
            if known.numbers.full(TABLE_WORDS):
                known.clear()
            numbers, counts = known.of(texts)
            bounds = offsets(counts)
            hashes = known.hashes.view()[numbers]
            if model:
                pairs, of_text = pair_features(hashes, counts)
                total = sums(known.adds.view()[numbers], bounds) + np.bincount(of_text, model["weights"][pairs], len(counts))
                probability = sigmoid(model["a"] * (total / np.maximum(counts, 1) + model["bias"]) + model["b"])
            else:
                probability = np.ones(len(counts))
            made = {
                "doc_id": part.column(0),
                "n_words": pa.array(counts),
                "word_chars": pa.array(sums(known.chars.view()[numbers], bounds)),
                "n_symbols": pa.array(sums(known.symbols.view()[numbers], bounds)),
                "n_dup_lines": pa.array([repeated_lines(t) if t else 0 for t in texts], pa.int64()),
                "n_repeat_words": pa.array(repeated_words(hashes, counts)),
                "probability": pa.array(probability),
            }
            yield with_kept(part, made, source)

    rows = carry.rows.mapInArrow(run, carry.schema("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    found = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= least))
    return found.where("kept").select(*carry.columns()) if only_kept else found
