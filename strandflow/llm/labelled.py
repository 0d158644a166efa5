"""Bounded samples of labelled rows, and small models fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_mod(key: str, n: int):
    """crc32 of the key as text, modulo n (null for a null key)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n).cast("long"))


def hash_share(key: str, seed: int = 0):
    """A number from 0 to 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30).cast("long")) / F.lit(1 << 30)


def bounded_sample(rows: DataFrame, key: str, group: str, most: int, weight: str | None = None) -> DataFrame:
    """About `most` rows of each group of labelled rows at most, chosen by a hash of the key; in a column `weight` the rows that each stands for."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    chosen = rows.join(F.broadcast(counts), group).where(hash_share(key) < F.lit(most) / F.col("_n"))
    if weight is not None:
        chosen = chosen.withColumn(weight, F.greatest(F.lit(1.0), F.col("_n") / F.lit(most)))
    return chosen.drop("_n")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 100, weights: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is the (weighted) share of label 1 among such scores; Newton's method with Platt's smoothed targets.

    a is never negative: where a higher score means label 1 less often, a is 0 and all get the share."""
    weights = np.ones(len(labels)) if weights is None else weights / weights.mean()
    positive, negative = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    # In units of their spread and from the labels' own share, each step halved until it helps: large scores diverge otherwise.
    centre, spread = float(scores.mean()), max(float(scores.std()), 1e-9)
    x = np.stack(((scores - centre) / spread, np.ones_like(scores)), axis=1)
    share = float((weights * target).mean())
    at = np.array([0.0, np.log(share / (1 - share))])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((weights * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(rounds):
        p = sigmoid(x @ at)
        gradient = x.T @ (weights * (p - target))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move, now = np.linalg.solve(hessian, gradient), loss(at)
        while np.abs(move).max() > 1e-8 and loss(at - move) > now:
            move = move / 2
        at = at - move
        if np.abs(move).max() < 1e-8:
            break
    if not np.isfinite(at).all() or at[0] <= 0:
        # Scores that say nothing, or the contrary: the share alone is the safe answer.
        return 0.0, float(np.log(share / (1 - share)))
    return float(at[0] / spread), float(at[1] - at[0] * centre / spread)


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int, labels: np.ndarray, l2: float, rounds: int = 70, per_row: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 logistic regression over sparse entries (row, column, value), rows weighted by per_row; Adam on the whole sample."""
    per_row = np.ones(n_rows) if per_row is None else per_row / per_row.mean()
    weights, bias = np.zeros(n_columns), 0.0
    parts = [slice(a, a + (1 << 20)) for a in range(0, len(rows), 1 << 20)]  # so that no temporary is large
    mean, square = np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    for t in range(1, rounds + 1):
        z = sum((np.bincount(rows[p], weights[columns[p]] * values[p], n_rows) for p in parts), np.full(n_rows, bias))
        error = per_row * (sigmoid(z) - labels) / n_rows
        gradient = np.append(sum((np.bincount(columns[p], error[rows[p]] * values[p], n_columns) for p in parts), l2 * weights), error.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        rate = 0.3 * min(1.0, 2 - 2 * t / (rounds + 1))
        move = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, float(bias)
