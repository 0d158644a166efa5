"""k-mer and hash kernels on numpy arrays, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: 2-bit codes of bases; other bytes have none. Codes order like the letters.
CODE = np.full(256, 4, np.uint8)
for _base, _number in zip(b"ACGT", range(4)):
    CODE[_base] = _number
    CODE[_base + 32] = _number
MOST_K = 31
#: k-mers of a sequence that are worked on at once.
PIECE = 1 << 17

#: Bytes that are no base become N; the bases' complements.
NORMAL = bytes(b if b in b"ACGT" else ord("N") for b in range(256))
COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")

M = np.uint64(0xC6A4A7935BD1E995)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (numpy's own way hashes them, which is slower here)."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def codes(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The 2-bit code of every k-mer of bases A, C, G, T, and their positions; k-mers with others are left out."""
    if k > MOST_K:
        raise ValueError(f"k must be at most {MOST_K}")
    n = len(seq) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = CODE[np.frombuffer(seq, np.uint8)]
    bad = np.concatenate(([0], np.cumsum(base > 3)))
    whole = np.flatnonzero(bad[k:] == bad[:-k])
    # Codes of 1, 2, 4, ... bases, then two that overlap.
    out, width = base.astype(np.uint64) & np.uint64(3), 1
    while 2 * width <= k:
        out = (out[:-width] << np.uint64(2 * width)) | out[width:]
        width *= 2
    if width < k:
        more = k - width
        out = (out[:n] << np.uint64(2 * more)) | (out[more:] & np.uint64((1 << 2 * more) - 1))
    return (out, whole) if len(whole) == n else (out[whole], whole)


def reverse_codes(values: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    out = ~values
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        out = ((out >> np.uint64(shift)) & np.uint64(mask)) | ((out & np.uint64(mask)) << np.uint64(shift))
    return out.byteswap() >> np.uint64(64 - 2 * k)


def canonical_codes(seq: bytes, k: int, step: int = 1) -> np.ndarray:
    """Canonical codes of the k-mers at positions 0, step, 2 step, ..."""
    values, at = codes(seq, k)
    if step > 1:
        values = values[at % step == 0]
    return np.minimum(values, reverse_codes(values, k))


def pieces(seq: bytes, k: int, most: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(begin, piece) of a sequence in pieces that share k - 1 letters: each k-mer is whole in just one."""
    for a in range(0, max(0, len(seq) - k + 1), most):
        yield a, seq[a : a + most + k - 1]


def canonical_windows(windows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The smaller of each row of letters and of its reverse complement, the row of `others`."""
    differ = windows != others
    first = differ.argmax(axis=1)
    rows = np.arange(len(windows))
    smaller = windows[rows, first] <= others[rows, first]
    return np.ascontiguousarray(np.where(smaller[:, None], windows, others))


def kmer_windows(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Views of all k-mers of a normalised sequence, and of their reverse complements."""
    view = lambda x: np.lib.stride_tricks.sliding_window_view(np.frombuffer(x, np.uint8), k)
    return view(seq), view(seq.translate(COMPLEMENT))[:, ::-1]


def canonical_rows(seq: bytes, k: int, step: int = 1) -> np.ndarray:
    """The letters of the canonical form of each k-mer at 0, step, 2 step, ..., a row each."""
    if len(seq) < k:
        return np.zeros((0, k), np.uint8)
    forward, backward = kmer_windows(seq.upper().translate(NORMAL), k)
    return canonical_windows(forward[::step], backward[::step])


def piece_keys(piece: bytes, k: int, step: int, begin: int) -> np.ndarray:
    """Keys of the k-mers of a piece that begins at `begin` of its sequence, those at multiples of step of the sequence."""
    normal = piece.upper().translate(NORMAL)
    n = len(piece) - k + 1
    left = (begin + np.arange(n)) % step == 0
    exact = np.zeros(0, np.uint64)
    if k <= MOST_K:
        values, at = codes(normal, k)
        values = values[left[at]]
        exact = np.minimum(values, reverse_codes(values, k))
        left[at] = False
    at = np.flatnonzero(left)
    return np.concatenate((exact, hashed_keys(normal, k, at))) if len(at) else exact


def hashed_keys(normal: bytes, k: int, at: np.ndarray) -> np.ndarray:
    """Keys of the k-mers at those places that have no code: a hash with the top bit set."""
    # k-mers of N alone have one key between them, however many there are.
    unknown = np.concatenate(([0], np.cumsum(np.frombuffer(normal, np.uint8) == ord("N"))))
    empty = unknown[at + k] - unknown[at] == k
    forward, backward = kmer_windows(normal, k)
    own = at[~empty]
    hashed = [np.zeros(0, np.uint64)]
    if len(own):
        hashed.append(murmur64a(canonical_windows(forward[own], backward[own]), 0))
    if empty.any():
        hashed.append(np.repeat(murmur64a(np.full((1, k), ord("N"), np.uint8), 0), int(empty.sum())))
    return np.concatenate(hashed) | np.uint64(1 << 63)


def key_pieces(seq: bytes, k: int, step: int = 1, most: int = PIECE) -> Iterator[np.ndarray]:
    """A 64-bit key of the canonical form of each k-mer at positions 0, step, 2 step, ..., piece by piece.

    For k up to MOST_K a k-mer of bases alone has its code, which is exact; others (with an N, or
    longer) have a hash with the top bit set."""
    for begin, piece in pieces(seq, k, most):
        yield piece_keys(piece, k, step, begin)


#: Above the mixed key of any k-mer.
NO_KMER = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(values: np.ndarray) -> np.ndarray:
    """The values in an order that has nothing to do with their letters (one to one)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * M
        values = (values ^ (values >> np.uint64(29))) * M
    return values ^ (values >> np.uint64(32))


def minimiser_pieces(seq: bytes, k: int, window: int, most: int = PIECE) -> Iterator[np.ndarray]:
    """The least of the `mixed` keys (of key_pieces) of each window of `window` k-mers, piece by piece.

    Two sequences that share window + k - 1 bases, on whichever strands, share such a key. A k-mer with an N is never
    the least: no window that is shared by its bases has one."""
    for _, piece in pieces(seq, k + window - 1, most):
        normal = piece.upper().translate(NORMAL)
        keys = np.zeros(len(piece) - k + 1, np.uint64)
        if k <= MOST_K:
            values, at = codes(normal, k)
            keys[at] = np.minimum(values, reverse_codes(values, k))
        else:
            unknown = np.concatenate(([0], np.cumsum(np.frombuffer(normal, np.uint8) == ord("N"))))
            at = np.flatnonzero(unknown[k:] == unknown[:-k])
            forward, backward = kmer_windows(normal, k)
            keys[at] = murmur64a(canonical_windows(forward[at], backward[at]), 0) | np.uint64(1 << 63)
        least = np.full(len(keys), NO_KMER)
        least[at] = np.minimum(mixed(keys[at]), NO_KMER - np.uint64(1))
        least = distinct(sliding(np.minimum, least, window))
        yield least[least != NO_KMER]


def fours(base: np.ndarray, room: int, nearest_lowest: bool = False) -> np.ndarray:
    """The code of the four bases from each place on, `room` places without bases before the first and behind the last."""
    wide = np.concatenate((np.zeros(room, np.uint8), base & 3, np.zeros(room + 3, np.uint8)))
    shifts = (0, 2, 4, 6) if nearest_lowest else (6, 4, 2, 0)
    out = np.zeros(len(wide) - 3, np.uint8)
    for i, shift in enumerate(shifts):
        out |= wide[i : len(wide) - 3 + i] << np.uint8(shift)
    return out


def codes_at(base: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k-mers at the places, all of bases."""
    four = fours(base, 0)
    out = np.zeros(len(at), np.uint64)
    for i in range(0, k, 4):
        rest = min(4, k - i)
        out = (out << np.uint64(2 * rest)) | (four[at + i] >> np.uint8(8 - 2 * rest))
    return out


def whole_at(base: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Whether the k-mers at the places are of bases alone."""
    bad = np.append(np.flatnonzero(base > 3), len(base))
    return bad[np.searchsorted(bad, at)] >= at + k


def around(base: np.ndarray, at: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the k-mers at the places: the up to `most` bases before and behind each, two bits a base with the nearest lowest,
    and how many there are up to a letter that is no base or the end. base: codes of letters, above 3 for others."""
    bad = np.concatenate(([-1], np.flatnonzero(base > 3), [len(base)]))
    last, following = bad[np.searchsorted(bad, at) - 1], bad[np.searchsorted(bad, at + k)]
    before, behind = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    room = -(-most // 4) * 4
    highest, lowest = fours(base, room), fours(base, room, nearest_lowest=True)
    for i in range(0, room, 4):
        before = (before << np.uint64(8)) | highest[at + i]
        behind |= lowest[at + room + k + i].astype(np.uint64) << np.uint64(2 * i)
    all_bases = np.uint64((1 << 2 * most) - 1)
    before, behind = (before & all_bases).view(np.int64), (behind & all_bases).view(np.int64)
    return before, behind, np.minimum(most, at - 1 - last).astype(np.int8), np.minimum(most, following - at - k).astype(np.int8)


class Bundle:
    """Pieces of sequences one behind another, an N between, so that array code runs over many short sequences at once.

    Each piece has its sequence's number (own), the places in `text` of the k-mers that are its own (from `first` to below
    `end`), and what a place in `text` lacks to the place in the sequence (shift)."""

    def __init__(self, texts: list[bytes], own: list[int], first: list[int], end: list[int], shift: list[int]):
        self.text = b"N".join(texts)
        self.own, self.first, self.end, self.shift = (np.array(x, np.int64) for x in (own, first, end, shift))

    def places(self, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text of the own k-mers at multiples of step of their sequences, and the piece of each."""
        first = self.first + -(self.first + self.shift) % step
        n = np.maximum(0, -(-(self.end - first) // step))
        piece = np.repeat(np.arange(len(n)), n)
        return first[piece] + step * (np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)), piece

    def pieces_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece in which each place of the text (in order) lies, and whether a k-mer that is the piece's own begins there."""
        piece = np.maximum(np.searchsorted(self.first, at, "right") - 1, 0)
        return piece, (at >= self.first[piece]) & (at < self.end[piece])


def bundles(seqs: Iterable[bytes], k: int, beside: int = 0, most: int = PIECE) -> Iterator[Bundle]:
    """The sequences in bundles of some `most` k-mers; longer ones in pieces, each with up to `beside` bases around its own k-mers."""
    found, length = ([], [], [], [], []), 0
    for i, seq in enumerate(seqs):
        n = len(seq) - k + 1
        for begin in range(0, max(0, n), most):
            left = max(0, begin - beside)
            piece = seq[left : begin + most + k - 1 + beside]
            for values, value in zip(found, (piece, i, length + begin - left, length + min(begin + most, n) - left, left - length), strict=True):
                values.append(value)
            length += len(piece) + 1
            if length >= most:
                yield Bundle(*found)
                found, length = ([], [], [], [], []), 0
    if length:
        yield Bundle(*found)


class Wanted:
    """A sorted array of keys with a table of bits before it, by which nearly all other keys are told at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = distinct(keys.astype(np.uint64))
        width = min(26, max(16, (32 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - width)
        self.table = np.zeros(1 << width, bool)
        self.table[self.slots(self.keys)] = True

    def slots(self, values: np.ndarray) -> np.ndarray:
        return ((values * M) >> self.shift).view(np.int64)

    def among(self, values: np.ndarray) -> np.ndarray:
        """Which of the values are wanted: their places in order."""
        at = np.flatnonzero(self.table[self.slots(values)])
        if not len(self.keys) or not len(at):
            return at[:0]
        found = values[at]
        return at[self.keys[np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)] == found]


def core_length(k: int) -> int:
    """Bases of the middle of a k-mer that a code holds: as many before as behind it, so that on both strands it is the same."""
    return k if k <= MOST_K else MOST_K - (k - MOST_K) % 2


def wanted_keys(bundle: Bundle, k: int, wanted: Wanted, cores: Wanted) -> tuple[np.ndarray, np.ndarray]:
    """piece_keys of the bundle's k-mers that are wanted, and the piece of each. cores: canonical codes of the middles of the
    wanted ones (the wanted ones themselves up to MOST_K bases), so that no other long k-mer is hashed."""
    core = core_length(k)
    text = bundle.text.upper().translate(NORMAL)
    values, at = codes(text, core)
    values = np.minimum(values, reverse_codes(values, core))
    hit = cores.among(values)
    at = at[hit] - (k - core) // 2
    piece, own = bundle.pieces_of(at)
    base = CODE[np.frombuffer(text, np.uint8)]
    keys, pieces_at = [], []
    if k <= MOST_K:
        keys.append(values[hit][own])
        pieces_at.append(piece[own])
    else:
        own[own] = whole_at(base, at[own], k)
        keys.append(hashed_keys(text, k, at[own]))
        pieces_at.append(piece[own])
    if text.count(b"N") >= len(bundle.own):
        # More than what stands between pieces: k-mers with an N have hashes of their own.
        at, piece = bundle.places()
        odd = ~whole_at(base, at, k)
        keys.append(hashed_keys(text, k, at[odd]))
        pieces_at.append(piece[odd])
    keys, piece = np.concatenate(keys), np.concatenate(pieces_at)
    hit = wanted.among(keys)
    return keys[hit], piece[hit]


#: Bases of an anchor, and those beside it that a code holds.
ANCHOR, BESIDE = 15, 31


def anchor_length(k: int) -> int:
    """Bases of the anchors of k-mers: odd, so that none is its own reverse complement; 0 where k-mers are too long for them."""
    m = max(min(k, ANCHOR), k - BESIDE)
    m += 0 if m % 2 else 1 if m < k else -1
    return m if 0 < m <= MOST_K else 0


def sliding(pick, values: np.ndarray, window: int) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window of values: windows of 1, 2, 4, ... values, then two that overlap."""
    n, width = len(values) - window + 1, 1
    while 2 * width <= window:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[:n], values[window - width :])


Anchors = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def anchors(piece: bytes, k: int, step: int = 0, begin: int = 0) -> Anchors:
    """key, before, behind, n_before, n_behind of the anchors of a piece's k-mers, which begins at `begin` of its sequence.

    The anchor of a k-mer is the shorter m-mer in it (on whichever strand) that is the least of the `mixed` canonical
    codes. Neighbours share theirs, so that an anchor with the k - m bases on both sides stands for all the k-mers around
    it. Without a step these are the places of all anchors, ties included; with one, the k-mers at multiples of step of the
    sequence one by one, each with the bases that belong to it alone. Bases are those of the strand on which the anchor is
    canonical, two bits each, the nearest lowest, and zero beyond n_before and n_behind. k-mers that have no anchor (with
    an N, or too long) have their hashed key, and no bases beside it."""
    m = anchor_length(k)
    normal = piece.upper().translate(NORMAL)
    n = len(normal) - k + 1
    base = CODE[np.frombuffer(normal, np.uint8)]
    bad = np.concatenate(([0], np.cumsum(base > 3)))
    whole = bad[k:] == bad[:-k] if m else np.zeros(n, bool)
    wanted = (begin + np.arange(n)) % step == 0 if step else np.ones(n, bool)
    rest = hashed_keys(normal, k, np.flatnonzero(wanted & ~whole))
    at, first = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (wanted & whole).any():
        # Letters that are no base stand for A here: k-mers with one take no part.
        code, _ = codes(normal.replace(b"N", b"A"), m)
        rank = np.minimum(mixed(np.minimum(code, reverse_codes(code, m))), NO_KMER - np.uint64(1)) + np.uint64(1)
        least = sliding(np.minimum, rank, k - m + 1)
        if step:
            first = np.flatnonzero(wanted & whole)
            at = first + (np.lib.stride_tricks.sliding_window_view(rank, k - m + 1)[first] == least[first][:, None]).argmax(axis=1)
        else:
            beside = np.zeros(k - m, np.uint64)
            at = np.flatnonzero(sliding(np.maximum, np.concatenate((beside, np.where(whole, least, np.uint64(0)), beside)), k - m + 1) == rank)
    if len(at):
        before, behind, n_before, n_behind = around(base, at, m, k - m)
        if step:
            n_before, n_behind = (at - first).astype(np.int8), (first + k - m - at).astype(np.int8)
        forward = code[at]
        backward = reverse_codes(forward, m)
        turned, all_bases = backward < forward, np.int64((1 << 2 * (k - m)) - 1)
        before, behind = np.where(turned, behind ^ all_bases, before), np.where(turned, before ^ all_bases, behind)
        n_before, n_behind = np.where(turned, n_behind, n_before), np.where(turned, n_before, n_behind)
        cut = lambda bases, number: bases & ((np.int64(1) << 2 * number.astype(np.int64)) - 1)
        found = (np.minimum(forward, backward), cut(before, n_before), cut(behind, n_behind), n_before, n_behind)
    else:
        found = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int8))
    return tuple(np.concatenate((x, rest if not i else np.zeros(len(rest), x.dtype))) for i, x in enumerate(found))


def kmer_keys(seq: bytes, k: int, step: int = 1) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *key_pieces(seq, k, step)])


#: The four letters of each code of four bases, as a word.
FOUR = np.frombuffer(bytes(b"ACGT"[code >> shift & 3] for code in range(256) for shift in (6, 4, 2, 0)), np.uint32)


def letters(values: np.ndarray, k: int) -> np.ndarray:
    """The k-mers' letters, a row of k bytes each."""
    words = -(-k // 4)
    values = values << np.uint64(2 * (4 * words - k))
    out = np.stack([FOUR[((values >> np.uint64(8 * (words - 1 - i))) & np.uint64(255)).astype(np.intp)] for i in range(words)], axis=1)
    return np.ascontiguousarray(out.view(np.uint8)[:, :k])


def murmur64a(rows: np.ndarray, seed: int) -> np.ndarray:
    """MurmurHash64A of each row of bytes."""
    return next(murmurs(rows, (seed,)))


def murmurs(rows: np.ndarray, seeds: Iterable[int]) -> Iterator[np.ndarray]:
    """MurmurHash64A of each row of bytes by each seed; the rows' words are mixed once for all."""
    n, length = rows.shape
    shift = np.uint64(47)
    whole = length // 8
    words = []
    with np.errstate(over="ignore"):
        if whole:
            view = np.ascontiguousarray(rows[:, : 8 * whole]).view("<u8")
            for i in range(whole):
                w = view[:, i] * M
                w ^= w >> shift
                words.append(w * M)
        if length % 8:
            tail = np.zeros((n, 8), np.uint8)
            tail[:, : length % 8] = rows[:, 8 * whole :]
            words.append(tail.view("<u8")[:, 0])
        for seed in seeds:
            h = np.full(n, np.uint64(seed) ^ (np.uint64(length) * M))
            for w in words:
                h ^= w
                h *= M
            h ^= h >> shift
            h *= M
            yield h ^ (h >> shift)
