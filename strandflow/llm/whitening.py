"""Whitening of embeddings by their principal components, found by QDWH spectral divide-and-conquer.

Entries become whole numbers x = floor(64 c) + 1000000, so that sums over all rows are exact. Mean and covariance are
over each distinct vector once, summed by tasks (vectors go to tasks by their content, never to one). The
covariance has as many rows as a vector has entries, whatever the number of vectors: it is split on the driver. The
polar factor U of the covariance less a shift, by the dynamically weighted Halley iteration (QDWH), gives the
projector (U + I) / 2 on the space of all eigenvalues above the shift; bases of this space and of its complement
split the matrix in two, and each half is split again until single components are left. The components, a matrix
bounded by the vectors' length, are sent to all tasks, which whiten their rows.

Rows whose vector is null or holds a null or an entry that is not finite (or whose x would not fit into 64 bits) take
no part. Vectors of other lengths are whitened among themselves. A component with no variance (up to rounding)
can't be whitened and is left out; so a single distinct vector, and vectors without entries, give no rows. Keys,
null or repeated, stay as they are; further columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 64, 1_000_000
#: Entries whose scaled value is beyond this are no longer whole numbers of 64 bits.
MOST = float(1 << 62)
COMPONENTS = 16
#: Rows multiplied at once.
BLOCK = 4096
EPS = np.finfo(float).eps


# ---- the spectrum of a symmetric matrix ----


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor U of a = U H by QDWH: Halley's iteration with weights from a bound on the least singular value.

    Each step is a QR factorisation of the scaled matrix over the identity, so no inverse is formed."""
    n = len(a)
    top = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    x = a / top
    # A lower bound of the least singular value: that of the R factor, by its inverse's norm where it has one.
    r = np.linalg.qr(x, mode="r")
    diagonal = np.abs(np.diag(r))
    low = max(diagonal.min() / math.sqrt(n) / 10, EPS)
    eye = np.eye(n)
    for _ in range(60):
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3) if square < 1 else 0.0
        root = math.sqrt(1 + d)
        p = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        q = (p - 1) ** 2 / 4
        s = p + q - 1
        both = np.linalg.qr(np.vstack((math.sqrt(s) * x, eye)))[0]
        step = q / s * x + (p - q / s) / math.sqrt(s) * both[:n] @ both[n:].T
        step = (step + step.T) / 2
        moved = np.abs(step - x).max()
        x = step
        low = min(1.0, low * (p + q * square) / (1 + s * square))
        if moved < 1e-10 and low > 1 - 1e-8 or moved < 4 * EPS:
            break
    return x


def shifts(h: np.ndarray) -> list[float]:
    """Where to split: near the middle of the spectrum, then at other places should an eigenvalue lie there."""
    n = len(h)
    mean = np.trace(h) / n
    spread = math.sqrt(max(np.square(h - mean * np.eye(n)).sum() / n, 0.0))
    middle = float(np.median(np.diag(h)))
    return [middle, mean, *(mean + t * spread for t in (0.37, -0.37, 0.81, -0.81, 0.13, -0.13, 1.3, -1.3, 2.1, -2.1)), *(mean + t * spread * math.sqrt(n) for t in (0.5, -0.5, 0.9, -0.9))]


def bases(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthogonal matrix whose first `rank` columns span the projector's range and whose others its complement.

    The columns of largest norm, taken one after another, begin the basis; two rounds of applying the projector clean it."""
    n = len(projector)
    left = projector.copy()
    chosen = []
    for _ in range(rank):
        j = int(np.square(left).sum(axis=0).argmax())
        v = left[:, j] / np.linalg.norm(left[:, j])
        chosen.append(j)
        left -= np.outer(v, v @ left)
    first = projector[:, chosen]
    for _ in range(2):
        first = projector @ np.linalg.qr(first)[0]
    return np.linalg.qr(np.hstack((first, np.eye(n))))[0][:, :n]


def split(h: np.ndarray, norm: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first columns span an invariant subspace of h, and their number; None if h is a multiple of
    the identity up to rounding of a matrix of that norm."""
    n = len(h)
    if np.abs(h - np.trace(h) / n * np.eye(n)).max() <= 4 * EPS * norm:
        return None
    best = None
    for shift in shifts(h):
        shifted = h - shift * np.eye(n)
        if np.abs(shifted).max() <= EPS * norm:
            continue
        projector = (polar_factor(shifted) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        v = bases(projector, rank)
        off = np.abs(v[:, :rank].T @ h @ v[:, rank:]).max()
        if best is None or off < best[0]:
            best = off, v, rank
        if off <= 8 * EPS * norm * math.sqrt(n):
            break
    return None if best is None else best[1:]


def rotation(h: np.ndarray) -> np.ndarray:
    """The eigenvectors of a matrix of two rows."""
    angle = 0.5 * math.atan2(2 * h[0, 1], h[0, 0] - h[1, 1])
    return np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])


def spectrum(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by dividing its invariant subspaces."""
    h = (h + h.T) / 2
    norm = float(np.linalg.norm(h))
    vectors = np.eye(len(h))
    # (the columns of `vectors` that span a subspace, the matrix on it)
    left = [(0, len(h), h)] if norm else []
    while left:
        a, b, own = left.pop()
        if b - a < 2:
            continue
        if b - a == 2:
            vectors[:, a:b] = vectors[:, a:b] @ rotation(own)
            continue
        found = split(own, norm)
        if found is None:
            continue
        v, rank = found
        vectors[:, a:b] = vectors[:, a:b] @ v
        for x, y in ((0, rank), (rank, b - a)):
            inner = v[:, x:y].T @ own @ v[:, x:y]
            left.append((a + x, a + y, (inner + inner.T) / 2))
    vectors = refined(h, vectors)
    values = np.einsum("ij,ij->j", vectors, h @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def refined(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The eigenvectors with the rounding of the divisions taken out, to first order: what is left of the other vectors in
    each is taken away, where their eigenvalues are apart."""
    for _ in range(2):
        gram = np.eye(len(h)) - x.T @ x
        s = x.T @ h @ x
        s, gram = (s + s.T) / 2, (gram + gram.T) / 2
        values = np.diag(s) / (1 - np.diag(gram))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > 1e3 * EPS * np.abs(values).max() if len(values) else apart > 0
        step = np.where(far, (s + values[None, :] * gram) / np.where(far, apart, 1), gram / 2)
        np.fill_diagonal(step, np.diag(gram) / 2)
        if not np.isfinite(step).all() or np.abs(step).max(initial=0) > 0.1:
            break
        x = x + x @ step
    for _ in range(2):
        x = x + x @ (np.eye(len(h)) - x.T @ x) / 2
    return x


# ---- vectors ----


def whole_numbers(lists: pa.Array) -> list[np.ndarray | None]:
    """Of each list of numbers its x as an array of long; None if it takes no part."""
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
    flat = lists.flatten()
    values = np.asarray(pa.compute.fill_null(flat.cast(pa.float64()), float("nan")), np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * values)
        fit = np.abs(scaled) < MOST
    ends = np.cumsum(counts)
    good = np.concatenate(([0], np.cumsum(~fit)))
    x = np.where(fit, scaled, 0).astype(np.int64) + SHIFT
    there = np.asarray(lists.is_valid())
    return [x[e - c : e] if ok and good[e] == good[e - c] else None for e, c, ok in zip(ends.tolist(), counts.tolist(), there.tolist())]


def fit_list(rows: DataFrame, column: str) -> DataFrame:
    """(dim, x): each distinct x vector once, as bytes: in 32 bits an entry where they all fit, else in 64."""

    def run(batches):
        for batch in batches:
            own = [x for x in whole_numbers(batch.column(0)) if x is not None and len(x)]
            small = [len(x) and max(x.max(), -x.min()) < 1 << 31 for x in own]
            made = [(x.astype("<i4") if s else x.astype("<i8")).tobytes() for x, s in zip(own, small)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in own], pa.int32()), pa.array(made, pa.binary())], names=["dim", "x"])

    return rows.select(F.col(column).alias("vector")).mapInArrow(run, "dim int, x binary").distinct()


def blocks(batches):
    """(dim, matrix of long) of (dim, x) batches, some rows at a time."""
    for batch in batches:
        all_dims, raws = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        for dim in np.unique(all_dims).tolist():
            own = [raws[i] for i in np.flatnonzero(all_dims == dim).tolist()]
            for a in range(0, len(own), BLOCK):
                yield dim, np.stack([np.frombuffer(x, "<i4" if len(x) == 4 * dim else "<i8").astype(np.int64) for x in own[a : a + BLOCK]])


def added_up(rows: DataFrame, make) -> dict:
    """{dim: (n, matrix)}: the sum over all (dim, x) rows of make(dim, block), a matrix of doubles for each block.

    Each task adds up its own; their rows are added by (dim, row) and only the sums go to the driver."""

    def run(batches):
        found = {}
        for dim, block in blocks(batches):
            own = make(dim, block)
            found[dim] = (found[dim][0] + len(block), found[dim][1] + own) if dim in found else (len(block), own)
        for dim, (n, matrix) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(matrix), pa.int32()), pa.array(range(len(matrix)), pa.int32()), pa.array([n] * len(matrix), pa.int64()), pa.array(matrix.tolist(), pa.list_(pa.float64()))], names=["dim", "i", "n", "v"])

    def add(key, table):
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
        n = pa.compute.sum(table.column("n"))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([n.as_py()], pa.int64()), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    ddl = "dim int, i int, n long, v array<double>"
    out = {}
    for r in rows.mapInArrow(run, ddl).groupBy("dim", "i").applyInArrow(add, ddl).orderBy("dim", "i").toArrow().to_pylist():
        out.setdefault(r["dim"], (r["n"], []))[1].append(r["v"])
    return {dim: (n, np.array(v)) for dim, (n, v) in out.items()}


def exact_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{dim: (n, S)}: the number of vectors and the exact sum of each entry."""

    def run(batches):
        found = {}
        for dim, block in blocks(batches):
            # In two halves, whose sums stay within 64 bits.
            high, low = (block >> 31).sum(axis=0), (block & 0x7FFFFFFF).sum(axis=0)
            n, *before = found.get(dim, (0, 0, 0))
            found[dim] = (n + len(block), before[0] + high, before[1] + low)
        for dim, (n, high, low) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(high), pa.array(low)], names=["dim", "i", "n", "high", "low"])

    partial = rows.mapInArrow(run, "dim int, i int, n long, high long, low long")
    sums = partial.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("dim", "i").collect():
        out.setdefault(r.dim, (r.n, []))[1].append((int(r.high) << 31) + int(r.low))
    return out


def centred(block: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n as double: the whole part of the mean is taken away exactly."""
    whole, part = np.array([s // n for s in total], np.int64), np.array([s % n / n for s in total])
    return (block - whole) - part


def deviations(block: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over the entries of (n x - S)^2, exact; None where it has more than 63 bits."""
    whole, part = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64)
    off = block - whole
    # |n off - part| is at most n (|off| + 1).
    if n * (float(np.abs(off).max(initial=0)) + 1) < 2**31 / math.sqrt(max(1, block.shape[1])):
        return np.square(n * off - part).sum(axis=1).tolist()
    exact = np.square(n * off.astype(object) - part.astype(object)).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The key, component (from 1), n, deviation, whitened, explained and identity_error of every row and component.

    n and S: number and sums of the distinct vectors; deviation: sum of (n x - S)^2 (null beyond 63 bits); whitened: x - S / n
    on the component, over the root of its eigenvalue; explained: the eigenvalue's share of the trace; identity_error: the
    largest absolute entry of the whitened fit list's covariance minus the identity."""
    spark = rows.sparkSession
    fit = written(fit_list(rows, vector), "fit-list")
    sums = exact_sums(fit)
    sums_of = spark.sparkContext.broadcast(sums)

    def outer(dim, block):
        own = centred(block, *sums_of.value[dim])
        return own.T @ own

    model = {}
    for dim, (n, moment) in added_up(fit, outer).items():
        v = moment / n
        values, vectors = spectrum(v)
        most = min(components, dim)
        kept = values[:most] > dim * 16 * EPS * max(values[0], 0)
        if values[0] > 0 and kept.any():
            k = int(kept.sum())
            model[dim] = (*sums[dim], vectors[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(v))
    model_of = spark.sparkContext.broadcast(model)

    def white(dim, block):
        # The whitened vectors' second moments, and their sums in a last row.
        if dim not in model_of.value:
            return np.zeros((1, 1))
        n, total, project, _ = model_of.value[dim]
        z = centred(block, n, total) @ project
        return np.vstack((z.T @ z, z.sum(axis=0)))

    errors = {}
    for dim, (n, own) in added_up(fit, white).items() if model else ():
        if dim in model:
            mean = own[-1] / n
            errors[dim] = float(np.abs(own[:-1] / n - np.outer(mean, mean) - np.eye(len(own) - 1)).max())

    def apply(batches):
        for batch in batches:
            own = whole_numbers(batch.column(1))
            for dim, (n, total, project, explained) in model_of.value.items():
                at = [i for i, x in enumerate(own) if x is not None and len(x) == dim]
                for a in range(0, len(at), BLOCK):
                    some = at[a : a + BLOCK]
                    block = np.stack([own[i] for i in some])
                    z, k = centred(block, n, total) @ project, project.shape[1]
                    rows_at, m = pa.array(np.repeat(some, k)), len(some) * k
                    deviation = pa.array(deviations(block, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(len(some)), k)))
                    columns = [batch.column(0).take(rows_at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))), pa.array(np.full(m, n)), deviation, pa.array(z.reshape(-1)), pa.array(np.tile(explained, len(some))), pa.array(np.full(m, errors[dim]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    named = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    kind = named.schema["key"].dataType.simpleString()
    out = named.mapInArrow(apply, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
