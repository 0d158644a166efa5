"""SimHash near-duplicates by a generalised pigeonhole search.

A document's fingerprint has a bit for each of 64 places of its shingles' hashes. Equal fingerprints
are one class. Classes link at `most` or fewer differing bits; found without comparing all of them:

* bits are dealt into groups, correlated bits (in a bounded sample of fingerprints) to the same group;
* thresholds t (-1: group not used) with sum(t + 1) = most + 1 go to the groups by dynamic programming
  on the rows and comparisons they are estimated to cost; the number of groups is chosen likewise.
  Two fingerprints within `most` bits are then within t bits in some group;
* every class posts each value within t bits of its own in each group; classes that share a posting are
  compared whole. A posting's task only reports a spanning forest of its links, not the pairs.

Postings with very many classes are posted once more by exact runs of bits, of which one must agree;
what is still large is compared in blocks of a grid, each pair of blocks in some task. Components of the
links give each document the smallest doc_id that it reaches.

With `similar`, texts whose sets of SET_WORDS-word shingles agree by that share (Jaccard) are linked too:
those with an equal band of minima under BANDS times BAND_MINIMA hash orders are compared by their whole
sets. Texts at 0.8 share no band with probability 4e-6; what is linked has been compared. Pairs that
earlier links have already brought together are not compared.

Null and empty texts have fingerprint zero, linked like any other. Rows with a null doc_id get their
component like others and name one only if nothing else can (component null: no doc_id reaches it).
Repeated rows stay. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, Carry, hot_join, slices, text_slices, with_kept, word_parts, written
from .components import components

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
#: Shingles of one text whose hashes are held at once.
HASHES = 1 << 15
#: Fingerprints that partition and thresholds are planned on.
PLAN_SAMPLE = 4096
#: Classes of a posting compared by one task.
POSTING_ROWS = 4096
#: Keys of large postings up to which they are sent around.
BROADCAST_KEYS = 100_000
#: Relative costs: a posted row (shuffled, sorted), a comparison.
ROW_COST, COMPARE_COST = 1.0, 0.004
#: Shingles of the sets that `similar` compares; bands, and minima in each.
SET_WORDS, BANDS, BAND_MINIMA = 5, 24, 4
#: Texts of a band's posting up to which its pairs are listed; those of a larger one are first compared with STARS of
#: them, and what is left of it in blocks of about SET_ROWS.
PAIRED, STARS, SET_ROWS = 48, 3, 512


def shingle_hashes(text: bytes, width: int, seed: int):
    """The hashes of the shingles of a lower-cased text as bytes, at most HASHES shingles at once; fewer words than
    `width` are one shingle. Very long texts are taken in parts, each with the last words of the one before."""
    from xxhash import xxh64_digest

    before: list[bytes] = []
    whole = False
    for own in word_parts(text):
        words = before + own
        n = len(words)
        if n < width:
            before = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        begins, ends = np.concatenate(([0], ends[: n - width] + 1)), ends[width - 1 :]
        for i in range(0, len(begins), HASHES):
            part = zip(begins[i : i + HASHES].tolist(), ends[i : i + HASHES].tolist())
            yield b"".join(map(xxh64_digest, [joined[x:y] for x, y in part], repeat(seed)))
        before, whole = words[n - width + 1 :], True
    if before and not whole:
        yield xxh64_digest(b" ".join(before), seed)


def fingerprint(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of a lower-cased text, as an unsigned number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches):
        for part, texts in text_slices(batches):
            found = np.fromiter((fingerprint(t.lower(), width, seed) if t else 0 for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def bit_columns(fps: np.ndarray) -> np.ndarray:
    """Bit b of each fingerprint in column b."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(sample: np.ndarray, n_groups: int) -> list[list[int]]:
    """The 64 bits in groups of nearly equal size, correlated ones together."""
    bits = bit_columns(sample).astype(np.float64)
    bits -= bits.mean(axis=0)
    spread = np.maximum(np.sqrt((bits**2).mean(axis=0)), 1e-9)
    alike = np.abs(bits.T @ bits / max(1, len(bits)) / np.outer(spread, spread))
    left, groups = set(range(64)), []
    for g in range(n_groups):
        size = 64 // n_groups + (g < 64 % n_groups)
        own = [max(left, key=lambda b: (alike[b, sorted(left)].sum(), -b))]
        left -= set(own)
        while len(own) < size:
            own.append(max(left, key=lambda b: (alike[b, own].sum(), -b)))
            left.remove(own[-1])
        groups.append(sorted(own))
    return groups


def thresholds(costs: list[list[float]], most: int) -> tuple[float, list[int]]:
    """The cheapest t for each group with sum(t + 1) = most + 1; costs[g][t + 1] is that of t in group g."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        there: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, more in enumerate(own):
                if used + k <= most + 1 and cost + more < there.get(used + k, (float("inf"),))[0]:
                    there[used + k] = (cost + more, [*chosen, k - 1])
        best = there
    return best.get(most + 1, (float("inf"), []))


def plan(sample: np.ndarray, n: int, most: int = MOST_BITS) -> list[tuple[list[int], int]]:
    """(bits of a group, its threshold) for those groups that are used, for n classes."""
    best: tuple[float, list] = (float("inf"), [])
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    few = sample[:512]
    for n_groups in range(2, most + 2):
        groups, costs = bit_groups(sample, n_groups), []
        for own in groups:
            mask = np.uint64(sum(1 << b for b in own))
            apart = np.bitwise_count((few[:, None] ^ sample[None, :]) & mask)
            costs.append([0.0])
            for t in range(min(most, 3) + 1):
                posted = sum(comb(len(own), k) for k in range(t + 1))
                # The few are in the sample: each meets itself once.
                pairs = max(1, len(few) * (len(sample) - 1))
                near = max(float((apart <= t).sum() - len(few)) / pairs, posted / 2.0 ** len(own))
                costs[-1].append(posted * ROW_COST + n * near * posted * COMPARE_COST)
        cost, chosen = thresholds(costs, most)
        if cost < best[0]:
            best = (cost, [(own, t) for own, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def postings(classes: DataFrame, groups: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): the values that each class posts in each group."""
    flips = []
    for g, (own, t) in enumerate(groups):
        masks = [sum(1 << b for b in chosen) for k in range(t + 1) for chosen in combinations(range(len(own)), k)]
        flips.append((g, np.array(own), np.array(masks, np.uint64)))

    def run(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            step = max(1, (1 << 20) // sum(len(m) for _, _, m in flips))
            for a in range(0, len(fps), step):
                part = fps[a : a + step]
                columns = bit_columns(part)
                for g, own, masks in flips:
                    value = (columns[:, own].astype(np.uint64) << np.arange(len(own), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    keys = (value[:, None] ^ masks[None, :]) | np.uint64(g << 58)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these fingerprints."""
    out, left, queue = [], np.unique(fps), []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        one = queue.pop()
        near = np.bitwise_count(left ^ one) <= most
        if near.any():
            found = left[near]
            out += [(one, other) for other in found]
            queue += list(found)
            left = left[~near]
    return out


def linked(keys: np.ndarray, fps: np.ndarray, most: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key (rows sorted by it): for small postings all side by side, for others a forest each."""
    begins = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=-1))))
    ends = np.append(begins[1:], len(keys))
    sizes = ends - begins
    ones, others = [], []
    own = np.repeat(sizes <= small, sizes)
    until = np.repeat(ends, sizes)
    at = np.flatnonzero(own)
    for lag in range(1, small):
        at = at[at + lag < until[at]]
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + lag]) <= most
        ones.append(fps[at[near]])
        others.append(fps[at[near] + lag])
    for i in np.flatnonzero(sizes > small):
        pairs = np.array(forest(fps[begins[i] : ends[i]], most), np.uint64).reshape(-1, 2)
        ones.append(pairs[:, 0])
        others.append(pairs[:, 1])
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(ones or empty), np.concatenate(others or empty)


def links(classes: DataFrame, most: int = MOST_BITS, posting_rows: int = POSTING_ROWS, groups: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Edges (a, b) between fingerprints of `classes` (column fp, distinct), enough to connect all that link."""
    if groups is None:
        sample = np.array([r.fp for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()], np.int64).view(np.uint64)
        groups = plan(sample, classes.count(), most)
    posted = postings(classes, groups)
    large = written(posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > posting_rows), "large")
    if large.isEmpty():
        dealt = posted.select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    else:
        # Classes of a large posting within `most` bits agree in one of most + 1 runs of bits: they are posted by these once more.
        small = posted.join(F.broadcast(large), "key", "left_anti") if large.count() <= BROADCAST_KEYS else posted.join(large, "key", "left_anti")
        again = posted.join(F.broadcast(large.select("key")), "key") if large.count() <= BROADCAST_KEYS else posted.join(large.select("key"), "key")
        cuts = [64 * i // (most + 1) for i in range(most + 2)]
        runs = F.array(*(F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(((1 << b) - 1) ^ ((1 << a) - 1))))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))))
        finer = written(again.select(F.explode(runs).alias("key"), "fp"), "finer")
        still = written(finer.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > posting_rows), "large")
        # A row of a posting that is still large goes to all pairs of blocks that its own block is in.
        blocks = F.ceil(2 * F.coalesce("n", F.lit(1)) / posting_rows).cast("int")
        with_blocks = finer.join(still, "key", "left").withColumn("blocks", F.when(F.col("n").isNull(), 1).otherwise(blocks)).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        with_other = with_blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        blocked = with_other.where("own <> other or blocks = 1").select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
        dealt = small.select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp").unionByName(blocked)

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            if not len(rows):
                continue
            # Rows of the last key wait for the next batch.
            cut = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))[-1]) + 1 if (rows[:, :3] != rows[-1, :3]).any() else 0
            if cut:
                yield found(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield found(np.concatenate(held))

    def found(rows):
        a, b = linked(rows[:, :3], rows[:, 3].copy().view(np.uint64), most)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")


def shingle_set(text: bytes, seed: int = SEED) -> np.ndarray:
    """The hashes of the text's different shingles of SET_WORDS words, sorted."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text, SET_WORDS, seed)), np.uint64))


def set_name(text: bytes) -> int:
    """A number for the text as it is compared: its words, with one space between them."""
    from xxhash import xxh64

    name, first = xxh64(seed=1), True
    for words in word_parts(text):
        if words:
            name.update(b" ".join(words) if first else b" " + b" ".join(words))
            first = False
    return name.intdigest()


_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minima."""
    least = np.full(BANDS * BAND_MINIMA, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for i in range(0, len(own), 512):
            least = np.minimum(least, ((own[None, i : i + 512] ^ _ORDERS[0]) * _ORDERS[1]).min(axis=1))
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in least.reshape(BANDS, BAND_MINIMA).T:
            keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
    return keys


def with_sets(docs: DataFrame, key: str, text: str, width: int, seed: int, bands: bool) -> DataFrame:
    """doc_id, fp, name, size of the text's set, and its keys (with `bands`) or the set itself; texts without a word have size 0."""

    def run(batches):
        for part, texts in text_slices(batches):
            lowered = [t.lower() if t else b"" for t in texts]
            sets = [shingle_set(t, seed) for t in lowered]
            made = {
                "doc_id": part.column(0),
                "fp": pa.array(np.fromiter((fingerprint(t, width, seed) for t in lowered), np.uint64, len(texts)).view(np.int64)),
                "name": pa.array(np.fromiter(map(set_name, lowered), np.uint64, len(texts)).view(np.int64)),
                "size": pa.array(list(map(len, sets)), pa.int64()),
            }
            if bands:
                keys = np.concatenate([band_keys(x) for x in sets]).view(np.int64) if sets else np.zeros(0, np.int64)
                made["keys"] = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys))
            else:
                made["own"] = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    kinds = "doc_id long, fp long, name long, size long, " + ("keys array<long>" if bands else "own binary")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kinds)


def agree(own: np.ndarray, flat: np.ndarray, bounds: np.ndarray, similar: float) -> np.ndarray:
    """Which of the sets between successive bounds of `flat` agree with `own` by `similar`; none of them is empty."""
    met = np.concatenate(([0], np.cumsum(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat)))
    common = met[bounds[1:]] - met[bounds[:-1]]
    return common >= similar * (len(own) + np.diff(bounds) - common)


def whole_keys(batches, n_keys: int):
    """Lists of columns in which no key (of the first n_keys columns, rows sorted by them) goes on into the next."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = np.stack([np.asarray(table.column(i)) for i in range(n_keys)], axis=1)
        other = np.flatnonzero((keys != keys[-1:]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield keys[:cut], table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield np.stack([np.asarray(rest.column(i)) for i in range(n_keys)], axis=1), rest


def begins_of(keys: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))), len(keys))


def similar_links(own: DataFrame, docs: DataFrame, key: str, text: str, width: int, seed: int, similar: float, paired: int = PAIRED, set_rows: int = SET_ROWS, stars: int = STARS) -> DataFrame:
    """Edges (a, b) between the fingerprints of texts whose sets agree by `similar`; `own` is with_sets(docs) with bands.

    Pairs of a small posting are listed. In a large one all are first compared with one of them, in `stars` rounds
    with another each time; what these links have brought into one component needs no more comparing, and only
    in postings with several components those that are not in its largest one are compared with all."""
    classes = written(own.where("size > 0").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")), "sets")
    posted = written(classes.select(F.explode("keys").alias("key"), "name", "size"), "bands")
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    large = written(counts.where(F.col("n") > paired), "large")

    def list_pairs(batches):
        for keys, table in whole_keys(batches, 1):
            names, sizes = np.asarray(table.column("name")), np.asarray(table.column("size"))
            bounds = begins_of(keys)
            until = np.repeat(bounds[1:], np.diff(bounds))
            at = np.arange(len(keys))
            for lag in range(1, paired):
                at = at[at + lag < until[at]]
                if not len(at):
                    break
                # Sets that agree by that share are not further apart in size.
                near = np.minimum(sizes[at], sizes[at + lag]) >= similar * np.maximum(sizes[at], sizes[at + lag])
                one, other = names[at[near]], names[at[near] + lag]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], names=["one", "other"])

    none_large = large.isEmpty()
    small = posted if none_large else posted.join(large, "key", "left_anti")
    pairs = written(small.repartition("key").sortWithinPartitions("key").mapInArrow(list_pairs, "one long, other long").distinct(), "pairs")
    needed = pairs.select(F.col("one").alias("name")).unionByName(pairs.select(F.col("other").alias("name")))
    if not none_large:
        crowded = written(posted.join(large, "key").select("key", "name", "size", "n"), "crowded")
        needed = needed.unionByName(crowded.select("name"))
    reps = written(classes.join(needed.distinct(), "name", "left_semi").select("name", "first_id"), "needed")
    # A text for each: that of its smallest doc_id.
    those = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = those.join(reps.where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if not reps.where("first_id is null").isEmpty():
        texts = texts.unionByName(those.where("doc_id is null"))
    sets = with_sets(texts, "doc_id", "text", width, seed, False).join(reps.select("name"), "name", "left_semi")
    sets = written(sets.groupBy("name").agg(F.first("own").alias("own")), "shingles")

    def compare(batches):
        for batch in batches:
            sizes = sum(np.asarray(pa.compute.binary_length(batch.column(i)), dtype=np.int64) for i in (2, 3))
            for start, end in slices(sizes):  # so that only few sets are held twice
                part = batch.slice(start, end - start)
                one, other = ([np.frombuffer(x, np.uint64) for x in part.column(i).to_pylist()] for i in (2, 3))
                near = np.array([agree(x, y, np.array([0, len(y)]), similar)[0] for x, y in zip(one, other, strict=True)], bool)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(near)) for i in (0, 1)], names=["a", "b"])

    def agreeing(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (one, other) that agree, as edges between names."""
        total = pairs.count()
        met = pairs
        for side, held in (("one", "x"), ("other", "y")):
            once = pairs.groupBy(F.col(side)).agg(F.count("*").alias("n")).join(sets.select(F.col("name").alias(side), F.col("own").alias(held)), side)
            met = hot_join(met, once, side, "n", total)
        return met.select(F.col("one").alias("a"), F.col("other").alias("b"), "x", "y").mapInArrow(compare, "a long, b long")

    found = [written(agreeing(pairs), "agreeing")]
    if not none_large:
        # Rows of a posting with more than HOT_SHARE of all are dealt in parts, each of which meets the posting's centre.
        part_rows = HOT_SHARE * large.agg(F.sum("n")).first()[0]
        dealt = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(part_rows))).cast("int")
        left = crowded
        for turn in range(stars):
            # First one text for all postings that share it, then another of each posting's main component for those outside.
            order = F.xxhash64("name", F.lit(turn)) if turn == 0 else F.xxhash64("name", "key", F.lit(turn))
            centre = (left if turn == 0 else left.where("component = main")).groupBy("key").agg(F.min_by(F.struct(F.col("name").alias("centre"), F.col("size").alias("centre_size")), order).alias("c"), F.first("n").alias("n"))
            centre = centre.select("key", "c.*", F.explode(F.sequence(F.lit(0), dealt(F.col("n")) - 1)).alias("dealt"))
            outside = (left if turn == 0 else left.where("component <> main")).withColumn("dealt", F.pmod(F.xxhash64("name"), dealt(F.col("n"))).cast("int"))
            met = outside.join(centre, ["key", "dealt"]).where("name <> centre").where(F.least("size", "centre_size") >= similar * F.greatest("size", "centre_size"))
            star = written(met.select(F.least("name", "centre").alias("one"), F.greatest("name", "centre").alias("other")).distinct(), "stars")
            found.append(written(agreeing(star), "agreeing"))
            groups = components(all_of(found)).select(F.col("node").alias("name"), "component")
            split = crowded.join(groups, "name", "left").withColumn("component", F.coalesce("component", "name"))
            parts = split.groupBy("key", "component").agg(F.count("*").alias("own_n"))
            unlike = parts.groupBy("key").agg(F.max_by("component", F.struct("own_n", "component")).alias("main"), F.max("own_n").alias("n_main"), F.count("*").alias("n_components")).where("n_components > 1").drop("n_components")
            left = written(split.join(unlike, "key"), "left")
            if left.isEmpty():
                break
        if not left.isEmpty():
            found.append(written(spanned(left, sets, similar, set_rows), "agreeing"))
    fps = classes.select("name", "fp")
    return all_of(found).join(fps.select(F.col("name").alias("a"), F.col("fp").alias("fp_a")), "a").join(fps.select(F.col("name").alias("b"), F.col("fp").alias("fp_b")), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def all_of(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def spanned(left: DataFrame, sets: DataFrame, similar: float, set_rows: int) -> DataFrame:
    """Edges between names that connect what agrees across components in postings (key, name, component, main, n,
    n_main): those outside the posting's main component are compared with all, in blocks of about set_rows."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(2 * n / set_rows)).cast("int")
    rows = left.withColumn("x_blocks", blocks(F.col("n_main"))).withColumn("y_blocks", blocks(F.col("n") - F.col("n_main")))
    block = lambda n: F.pmod(F.xxhash64("name"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x_blocks, y_blocks = F.col("x_blocks"), F.col("y_blocks")
    # Cells (x, y): block x of the main component with block y of the others; (-1 - x, y): blocks of the others.
    main = rows.where("component = main").select("key", block(x_blocks).alias("x"), every(y_blocks).alias("y"), "name", "component", F.lit(0).alias("side"))
    others = rows.where("component <> main").withColumn("own", block(y_blocks))
    across = others.select("key", every(x_blocks).alias("x"), F.col("own").alias("y"), "name", "component", F.lit(1).alias("side"))
    among = others.withColumn("with", every(y_blocks)).select("key", (-1 - F.least("own", "with")).alias("x"), F.greatest("own", "with").alias("y"), "name", "component", F.lit(1).alias("side"))
    cells = main.unionByName(across).unionByName(among).join(sets, "name").select("key", "x", "y", "side", "name", "component", "own")

    def span(batches):
        for keys, table in whole_keys(batches, 3):
            names, groups, sides = (np.asarray(table.column(c)) for c in ("name", "component", "side"))
            bounds = begins_of(keys)
            for a, b in zip(bounds[:-1], bounds[1:]):
                of = [np.frombuffer(x, np.uint64) for x in table.column("own").slice(a, b - a).to_pylist()]
                edges = np.array(cross_links(of, groups[a:b], sides[a:b], similar), np.int64).reshape(-1, 2) + a
                yield pa.RecordBatch.from_arrays([pa.array(names[edges[:, 0]]), pa.array(names[edges[:, 1]])], names=["a", "b"])

    return cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(span, "a long, b long")


def cross_links(sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Links of the sets of side 1 with sets of other groups, by their numbers: one for each two groups is enough."""
    out: list[tuple[int, int]] = []
    joined = {int(g): int(g) for g in np.unique(groups)}

    def root(g: int) -> int:
        while joined[g] != g:
            g = joined[g]
        return g

    for one in np.flatnonzero(sides == 1).tolist():
        own = root(int(groups[one]))
        apart = [k for k in range(len(sets)) if k != one and root(int(groups[k])) != own]
        for i in range(0, len(apart), 256):  # so that no copy is large
            part = [k for k in apart[i : i + 256] if root(int(groups[k])) != root(int(groups[one]))]
            if not part:
                continue
            near = agree(sets[one], np.concatenate([sets[k] for k in part]), np.cumsum([0, *(len(sets[k]) for k in part)]), similar)
            for k in np.array(part)[near].tolist():
                a, b = root(int(groups[one])), root(int(groups[k]))
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    out.append((one, k))
    return out


def grouped(docs: DataFrame, key: str, text: str, width: int, seed: int, most: int, similar: float | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """own (doc_id, fp, ...) of every row; classes (fp, first_id, n); members (fp, root, first_id) of components with
    more than one class; and these components: root, component_id, n_members, fp (the smallest with that id)."""
    own = written(fingerprints(docs, key, text, width, seed) if similar is None else with_sets(docs, key, text, width, seed, True), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    edges = links(classes, most)
    if similar is not None:
        edges = edges.unionByName(similar_links(own, docs, key, text, width, seed, similar))
    joined = components(edges)
    roots = joined.select(F.col("component").alias("fp"), F.col("component").alias("root")).distinct()
    members = written(joined.select(F.col("node").alias("fp"), F.col("component").alias("root")).unionByName(roots).join(classes, "fp"), "members")
    order = F.struct(F.col("first_id").isNull(), "first_id", "fp")
    found = members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_members"), F.min_by("fp", order).alias("fp"))
    return own, classes, members, written(found, "smallest")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, seed: int = SEED, most: int = MOST_BITS, similar: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id of its component) of every row."""
    own, classes, members, smallest = grouped(docs, key, text, width, seed, most, similar)
    named = hot_join(members.select("fp", "root"), smallest.select("root", "component_id", "n_members"), "root", "n_members", members.count()).select("fp", "component_id")
    labels = written(classes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")), "labels")
    out = hot_join(own.select("doc_id", "fp"), labels, "fp", "n", own.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, seed: int = SEED, most: int = MOST_BITS, similar: float | None = None) -> DataFrame:
    """The documents, whatever their columns, with one row kept of each component: one with its smallest doc_id (a row
    without only where none has one); of several such, one with the smallest fingerprint, the first by a hash of the row."""
    own, classes, members, smallest = grouped(docs, key, text, width, seed, most, similar)
    single = classes.join(members.select("fp"), "fp", "left_anti").select(F.col("first_id").alias("doc_id"), "fp")
    kept = written(single.unionByName(smallest.select(F.col("component_id").alias("doc_id"), "fp")), "kept")
    # A doc_id that one row has names it; rows that share one, or have none, are told apart by their fingerprints.
    repeated = written(own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    carry = Carry(docs, key, text, docs.columns)
    rows = carry.rows
    chosen = rows.join(kept.where("doc_id is not null").join(repeated, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi").select(*carry.untouched())
    unclear = rows.where("doc_id is null")
    if not repeated.isEmpty():
        unclear = unclear.unionByName(hot_join(rows, repeated, "doc_id", "n", own.count()))
    elif unclear.isEmpty():
        return chosen
    source = carry.source

    def run(batches):
        for part, texts in text_slices(batches):
            found = np.fromiter((fingerprint(t.lower(), width, seed) if t else 0 for t in texts), np.uint64, len(texts))
            yield with_kept(part, {"doc_id": part.column(part.schema.get_field_index("doc_id")), "fp": pa.array(found.view(np.int64))}, source)

    # One row of each doc_id and fingerprint, before the shuffle already.
    order = F.xxhash64(*(F.col(f"_{i}").cast("string") for i in range(len(carry.names))))
    marked = unclear.mapInArrow(run, carry.schema("doc_id long, fp long")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy(order))).where("rank = 1").alias("r")
    return chosen.unionByName(marked.join(kept.alias("k"), F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.fp") == F.col("k.fp")), "left_semi").select(*carry.columns()))
