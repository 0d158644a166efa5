"""Quality scores from a sparse ensemble of rules over statistics of the text.

Boosted shallow trees are grown on the statistics of a bounded sample of labelled rows. Every path from
a root to a node is a rule: a conjunction of "statistic <= bound" and "statistic > bound". A logistic
regression with an L1 penalty weighs them, which leaves few; these are compiled into one Spark column
expression over the statistics' columns. Sampled rows weigh as many as they stand for, so that scores mean
the same at every size.

Null and empty texts have all statistics 0 and are scored like others. Without labels of both kinds
the score is the share of label 1 (0.5 without labels). Rows keep their doc_id, null or repeated;
further columns are ignored; an empty table gives no rows. Labelled rows without a doc_id teach nothing, and of rows
that share one the smallest text does.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .labelled import bounded_sample, sigmoid

#: Labelled rows of each label that are learned from at most (expected number).
SAMPLE_ROWS = 8000
#: Words of a window in which distinct words are counted, so that the share does not fall with length.
WINDOW = 50
TREES, DEPTH, BINS, LEARNING_RATE, LEAST_LEAF = 30, 3, 64, 0.3, 8
#: The L1 penalty on a rule's weight.
L1 = 2e-4
THRESHOLD = 0.3

#: Bytes counted by the statistics.
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
SYMBOLS, STOPS, SHOUTS = b"#*$%&|<>@^~=+_\\{}[]/", b".,;:", b"!?"

STATISTICS = ("words", "bytes_per_word", "upper", "digits", "symbols", "stops", "shouts", "distinct", "top_word", "repeats_last", "lines", "words_per_line", "repeated_lines", "short_words", "long_words")


def statistics_of(text: bytes | None) -> tuple[float, ...]:
    words = text.split() if text else []
    if not words:
        return (0.0,) * len(STATISTICS)
    n, size = len(words), len(text)
    share = lambda those: (size - len(text.translate(None, those))) / size
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths = list(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        float(n),
        sum(lengths) / n,
        share(UPPER),
        share(DIGITS),
        share(SYMBOLS),
        share(STOPS),
        share(SHOUTS),
        sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW)) / n,
        max(seen.values()) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        float(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(x <= 2 for x in lengths) / n,
        sum(x >= 20 for x in lengths) / n,
    )


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `also` and a column of each statistic."""
    kept = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *also)
    names = ["doc_id", *also, *STATISTICS]

    def run(batches):
        for part, texts in text_slices(batches):
            found = np.array([statistics_of(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))
            others = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", *also)]
            yield pa.RecordBatch.from_arrays([*others, *(pa.array(found[:, i]) for i in range(len(STATISTICS)))], names=names)

    kinds = [f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("doc_id", *also)]
    return kept.mapInArrow(run, ", ".join([*kinds, *(f"{c} double" for c in STATISTICS)]))


#: A rule: (statistic's number, above, bound) for each condition.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * holds(rule, x) for rule, w in self.rules), np.zeros(len(x)))

    def score(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            met = F.lit(True)
            for i, above, bound in rule:
                column = F.col(STATISTICS[i])
                met = met & ((column > bound) if above else (column <= bound))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    met = np.ones(len(x), bool)
    for i, above, bound in rule:
        met &= x[:, i] > bound if above else x[:, i] <= bound
    return met


def grown(bins: np.ndarray, bounds: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: Rule, rules: list[Rule], move: np.ndarray) -> None:
    """Grows a tree below `path` by second-order gain, notes the path of every node, and sets the rows' moves at leaves."""
    if path:
        rules.append(path)
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, -1, -1)
    if len(path) < DEPTH:
        for i in range(bins.shape[1]):
            own = bins[rows, i]
            left_g = np.cumsum(np.bincount(own, gradient[rows], BINS))[:-1]
            left_h = np.cumsum(np.bincount(own, hessian[rows], BINS))[:-1]
            left_n = np.cumsum(np.bincount(own, minlength=BINS))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            gain[(left_n < LEAST_LEAF) | (len(rows) - left_n < LEAST_LEAF)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), i, at)
    _, i, at = best
    if i < 0:
        move[rows] = -g / (h + 1)
        return
    bound = float(bounds[i][at])
    left = bins[rows, i] <= at
    for above, own in ((False, rows[left]), (True, rows[~left])):
        grown(bins, bounds, gradient, hessian, own, (*path, (i, above, bound)), rules, move)


def fitted(x: np.ndarray, labels: np.ndarray, weigh: np.ndarray | None = None) -> Ensemble:
    """The ensemble for the rows of statistics x with labels 0 and 1 and the rows' weights."""
    weigh = np.ones(len(labels)) if weigh is None or not len(labels) else weigh / weigh.mean()
    prior = float((weigh * labels).mean()) if len(labels) else 0.5
    if len(labels) < 2 * LEAST_LEAF or len(np.unique(labels)) < 2:
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return Ensemble(float(np.log(share / (1 - share))), [])
    bounds, bins = [], np.zeros(x.shape, np.int64)
    for i in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1]))
        # Halfway to the next value that occurs, so that a bound is no value of the sample.
        values = np.unique(x[:, i])
        after = values[np.minimum(np.searchsorted(values, cuts, side="right"), len(values) - 1)]
        cuts = np.unique((cuts + after) / 2)
        bins[:, i] = np.searchsorted(cuts, x[:, i], side="left")
        bounds.append(np.append(cuts, np.full(BINS - len(cuts), cuts[-1])))
    margin = np.full(len(x), np.log(prior / (1 - prior)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = sigmoid(margin)
        move = np.zeros(len(x))
        grown(bins, bounds, weigh * (p - labels), weigh * p * (1 - p), np.arange(len(x)), (), rules, move)
        margin += LEARNING_RATE * move
    columns, kept = {}, []
    for rule in dict.fromkeys(tuple(sorted(r)) for r in rules):
        met = holds(rule, x)
        mark = met.tobytes()
        if 0 < met.sum() < len(x) and mark not in columns:
            columns[mark] = met
            kept.append(rule)
    if not kept:
        return Ensemble(float(np.log(prior / (1 - prior))), [])
    return lasso(np.stack(list(columns.values()), axis=1).astype(np.float64), labels, kept, prior, weigh)


def lasso(met: np.ndarray, labels: np.ndarray, rules: list[Rule], prior: float, weigh: np.ndarray, rounds: int = 1500) -> Ensemble:
    """L1 logistic regression by accelerated proximal gradient steps."""
    n = len(labels)
    scale = np.maximum(met.std(axis=0), 1e-3)
    z = np.hstack(((met - met.mean(axis=0)) / scale, np.ones((n, 1))))
    vector = np.ones(z.shape[1])
    for _ in range(30):
        vector = z.T @ (weigh * (z @ vector))
        norm = np.linalg.norm(vector)
        vector /= norm
    step = 4 * n / (norm * 1.05)
    weights = np.zeros(z.shape[1])
    weights[-1] = np.log(prior / (1 - prior))
    ahead, t = weights.copy(), 1.0
    for _ in range(rounds):
        new = ahead - step * (z.T @ (weigh * (sigmoid(z @ ahead) - labels)) / n)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * L1, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - weights)
        done = np.abs(new - weights).max() < 1e-6
        weights = new
        if done:
            break
    own = weights[:-1] / scale
    used = np.flatnonzero(np.abs(own) > 1e-6)
    return Ensemble(float(weights[-1] - own @ met.mean(axis=0)), [(rules[i], float(own[i])) for i in used])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    marked = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = bounded_sample(marked.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id", "label", sample_rows, "weight")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marked), "doc_id")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        # One text for each key, however many rows share it.
        rows = rows.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text"))
    sample = with_statistics(rows, also=("label", "weight")).toArrow()  # twice sample_rows rows of numbers
    order = np.argsort(np.asarray(sample.column("doc_id")), kind="stable")
    x = np.stack([np.asarray(sample.column(c)) for c in STATISTICS], axis=1)[order]
    return fitted(x, np.asarray(sample.column("label"), np.float64)[order], np.asarray(sample.column("weight"), np.float64)[order])


def scored(docs: DataFrame, ensemble: Ensemble, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and the statistics of every row."""
    rows = with_statistics(docs, key, text).withColumn("score", ensemble.score())
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS)
