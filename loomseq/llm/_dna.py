"""Small numpy helpers on one or two nucleotide sequences, called inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_CODE = np.full(256, 4, dtype=np.int64)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i
_COMPLEMENT = str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD")


def clean_sequence(col: Column) -> Column:
    """Upper case without gaps and white space; null and blank become null."""
    s = F.regexp_replace(F.upper(col), r"[-\s]", "")
    return F.when(F.length(s) > 0, s)


def strand_free(col: Column) -> Column:
    """The smaller of a clean sequence and its reverse complement, so that both strands of one text meet."""
    return F.least(col, F.reverse(F.translate(col, "ACGTRYKMBVDH", "TGCAYRMKVBHD")))


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


def placed_kmers(seq: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the k-mers of ``seq`` as read, the same on the other strand, and the places where they begin in ``seq``;
    those with another letter than A, C, G, T leave."""
    a = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]
    n = len(a) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bad = a == 4
    any_bad = bool(bad.any())
    if any_bad:
        a = a & 3
    fwd, rev, at = a[:n].copy(), (3 - a[:n]), np.arange(n)
    for i in range(1, k):
        part = a[i : i + n]
        fwd <<= 2
        fwd |= part
        rev |= (3 - part) << (2 * i)
    if any_bad:
        seen = np.concatenate(([0], np.cumsum(bad)))
        at = np.flatnonzero(seen[k:] == seen[:-k])
        fwd, rev = fwd[at], rev[at]
    return fwd, rev, at


def both_kmers(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of ``placed_kmers`` alone."""
    return placed_kmers(seq, k)[:2]


def kmer_set(seq: str, k: int) -> np.ndarray:
    """Strand-free k-mers: of each k-mer and its reverse complement the smaller code."""
    return np.unique(np.minimum(*both_kmers(seq, k)))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the letters of ``a``."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    m = len(a)
    back = a[::-1]
    peq = {c: int(back.translate({ord(x): "1" if x == c else "0" for x in set(a)}), 2) for c in set(a)}
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (mask & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) | 1
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv
    return score


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """``edit_distance`` of each pair, bit-parallel over all pairs at once: every pair has a lane of one long number, with
    a bit to spare that takes what an addition carries."""
    out = np.zeros(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda n: (len(b[n]), len(a[n])))
    for lo in range(0, len(order), 64):
        part = order[lo : lo + 64]
        la, lb = np.array([len(a[n]) for n in part]), np.array([len(b[n]) for n in part])
        wide, long, rows = int(la.max()) // 8 + 1, int(lb.max()), np.arange(len(part))
        ca, cb = _codes_of([a[n] for n in part], 8 * wide), _codes_of([b[n] for n in part], long)
        letters = np.unique(cb[cb > 0])
        rank = np.zeros(256, np.int64)
        rank[letters] = np.arange(len(letters))
        lanes = np.packbits(ca[:, None, :] == letters[None, :, None], axis=2, bitorder="little")
        one = lambda bits: int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")
        places = np.arange(8 * wide)[None, :]
        mask, first = one(places < la[:, None]), one(np.broadcast_to(places == 0, ca.shape))
        pv, mv, ends = mask, 0, set(lb.tolist())
        for j in range(long + 1):
            if j in ends:
                up, down = (np.frombuffer(x.to_bytes(len(part) * wide, "little"), np.uint8).reshape(len(part), wide) for x in (pv, mv))
                at = np.flatnonzero(lb == j)
                found = np.bitwise_count(up[at]).sum(axis=1, dtype=np.int64) - np.bitwise_count(down[at]).sum(axis=1, dtype=np.int64)
                out[[part[n] for n in at]] = j + found
            if j == long:
                break
            eq = int.from_bytes(lanes[rows, rank[cb[:, j]]].tobytes(), "little")
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = ((mv | (mask & ~(xh | pv))) << 1) | first
            pv = (((pv & xh) << 1) | ~(xv | ph)) & mask
            mv = ph & xv
    return out


def _codes_of(seqs: list[str], most: int) -> np.ndarray:
    out = np.zeros((len(seqs), most), np.uint8)
    for n, s in enumerate(seqs):
        out[n, : len(s)] = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
    return out


def _block_edits(a: list[str], b: list[str], jump: int) -> np.ndarray:
    """Edits of each pair on the given strands by one dynamic programme over all pairs at once.

    Columns are the letters of b, a cell is a place in a. Besides the three edits a step may jump to any place in a for
    ``jump``; the jump is a new piece and is not counted in the end. A cell carries its cost and where its piece began,
    packed in one number, so that the pieces are known without going back. Letters of a that no piece covers, or that
    several cover, count as edits.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    wide, long = int(la.max()), int(lb.max())
    bits = max(10, int(max(wide, long)).bit_length())
    # no cell of a row costs more than one insertion a column and a jump, so a barrier above that is never the least
    beyond, off = long + jump + 4, 4
    kind = np.int32 if beyond + long + jump + off + 4 < 1 << 31 - 2 * bits else np.int64
    one, low = kind(1 << 2 * bits), kind((1 << 2 * bits) - 1)
    far = kind(beyond) * one
    ca, cb = _codes_of(a, wide + 3), _codes_of(b, long)
    letters = np.unique(cb)
    rank = np.zeros(256, np.int64)
    rank[letters] = np.arange(len(letters))
    rows = np.arange(len(a))
    # a row has the places 0 to wide of one pair and two cells that keep it apart from the next row; costs by letter
    # (past the end of a, ``off`` a letter is enough: such a cell stays dearer than the last place of a)
    cost = np.full((len(a), len(letters), wide + 3), far, kind)
    cost[:, :, 1:] = np.where((ca[:, None, :-1] != letters[None, :, None]), one, kind(0))
    cost[:, :, 1:][np.broadcast_to((ca == 0)[:, None, :-1], cost[:, :, 1:].shape)] = kind(off) * one
    cost[:, :, -2:] = far
    cost = cost.reshape(-1, wide + 3)
    place = np.broadcast_to(np.arange(wide + 3, dtype=kind), (len(a), wide + 3)).copy()
    place[place > la[:, None]] += kind(off) * one
    place[:, -2:] += far
    cell, new, t1, t2 = place.copy(), np.empty_like(place), np.empty_like(place), np.empty_like(place)
    came = np.zeros((len(a), long + 1), kind)  # the cell from which a piece that begins in a column jumps
    at = np.zeros((len(a), long + 1), np.int64)
    final, final_at = np.zeros(len(a), kind), np.zeros(len(a), np.int64)
    last = set(lb.tolist())
    f1, f2 = t1.reshape(-1), t2.reshape(-1)
    for j in range(long):
        if j:
            best = cell[:, : wide + 1].argmin(axis=1)
            least = cell[rows, best]
            came[:, j], at[:, j] = least, best
            np.add(place, ((least & ~low) + kind(jump) * one + kind(j << bits))[:, None], out=t2)
            np.minimum(cell, t2, out=cell)
        flat, grown = cell.reshape(-1), new.reshape(-1)
        np.add(cell, one, out=new)
        np.take(cost, rows * len(letters) + rank[cb[:, j]], axis=0, out=t1, mode="clip")
        np.add(f1[1:], flat[:-1], out=f1[1:])
        np.minimum(grown[1:], f1[1:], out=grown[1:])
        np.add(grown[:-1], one, out=f1[1:])
        np.add(grown[:-2], one + one, out=f2[2:])
        np.minimum(grown[1:], f1[1:], out=grown[1:])
        np.minimum(grown[2:], f2[2:], out=grown[2:])
        new[:, -2:] = far
        cell, new = new, cell
        if j + 1 in last:
            ends = np.flatnonzero(lb == j + 1)
            final_at[ends] = cell[ends, : wide + 1].argmin(axis=1)
            final[ends] = cell[ends, final_at[ends]]
    return _uncovered(final, final_at, came, at, la, bits, jump)


#: Letters of the k-mers that place one text on another (every second one of a record, all of a pivot), the width of a band
#: of diagonals, and the share of the shorter text's letters that the k-mers beyond the second of each band have to reach
#: before edits are counted. Of pairs in two moved pieces (500 to 640 letters, edits spread evenly) 94 in 100 pass at a
#: similarity of 0.62, 98 at 0.64, more than 997 in 1000 at 0.67; of pseudo references from different families 3 in 10 000.
GATE_K, STEP, BAND, GATE = 7, 2, 24, 0.0095
#: Texts under so many letters hold too few k-mers for bands.
SHORT = 200


def band_excess(counts: np.ndarray) -> np.ndarray:
    """Common k-mers beyond the second of each band of diagonals (last axis); chance hits mostly stand alone in theirs."""
    return np.maximum(counts - 2, 0).sum(axis=-1)


def strand_kmers(seq: str, step: int = STEP, k: int = GATE_K) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and places of every ``step``-th k-mer (by default of the gate) of ``seq`` and of its reverse complement."""
    fwd, rev, at = placed_kmers(seq, k)
    if step > 1:
        keep = at % step == 0
        fwd, rev, at = fwd[keep], rev[keep], at[keep]
    return [(fwd, at), (rev, len(seq) - k - at)]


def _pair_bands(codes: np.ndarray, at: np.ndarray, place: np.ndarray, letters: int) -> np.ndarray:
    """Common k-mers by band of (place in the other text - place in this one + letters)."""
    there = place[codes]
    met = np.flatnonzero(there)
    return np.bincount((there[met] - 1 - at[met] + letters) // BAND, minlength=2)


def _uncovered(final: np.ndarray, final_at: np.ndarray, came: np.ndarray, at: np.ndarray, la: np.ndarray, bits: int, jump: int) -> np.ndarray:
    """Edits of each script without its jumps, plus the letters of a that no piece or several pieces cover."""
    out, low = np.zeros(len(la), np.int64), (1 << 2 * bits) - 1
    for n in range(len(la)):
        cover = np.zeros(int(la[n]) + 1, np.int64)
        now, end, jumps = int(final[n]), int(final_at[n]), 0
        edits = now >> 2 * bits
        while True:
            begin_b, begin_a = (now & low) >> bits, now & ((1 << bits) - 1)
            cover[begin_a] += 1
            cover[end] -= 1
            if not begin_b:
                break
            now, end, jumps = int(came[n, begin_b]), int(at[n, begin_b]), jumps + 1
        depth = np.cumsum(cover[:-1])
        out[n] = edits - jump * jumps + int((depth == 0).sum()) + int(np.maximum(depth - 1, 0).sum())
    return out


def _in_batches(edits: Callable[[list[str], list[str]], np.ndarray], order: list[int], a: list[str], b: list[str]) -> dict[int, int]:
    """``edits`` of the pairs in ``order``, as many at once as keep a column of cells in the cache and the tables of a
    batch small; a single pair at least."""
    out: dict[int, int] = {}
    lo = 0
    while lo < len(order):
        hi, wide, long = lo + 1, len(a[order[lo]]), len(b[order[lo]])
        while hi < len(order):
            wide, long = max(wide, len(a[order[hi]])), max(long, len(b[order[hi]]))
            if (hi + 1 - lo) * wide > 24_000 or (hi + 1 - lo) * (8 * wide + long) > 2_000_000:
                break
            hi += 1
        part = order[lo:hi]
        out.update((n, int(e)) for n, e in zip(part, edits([a[n] for n in part], [b[n] for n in part])))
        lo = hi
    return out


def script_similarities(a: list[str], b: list[str], at_least: float, jump: int = 6) -> np.ndarray:
    """1 - edits / letters of the shorter text for pairs on given strands, with whole pieces moved at no cost.

    The edits are those of a script that covers both texts, so the similarity is never overrated. Where a script falls
    short of ``at_least`` by up to 0.04, others are tried: with dearer and cheaper jumps, and from the other text's side.
    """
    short = np.array([max(1, min(len(x), len(y))) for x, y in zip(a, b)], float)
    out = np.zeros(len(a))

    def run(gap: float, price: int, swap: bool) -> None:
        x, y = (b, a) if swap else (a, b)
        near = sorted(np.flatnonzero((out < at_least) & (out >= at_least - gap)).tolist(), key=lambda n: (len(x[n]), len(y[n])))
        for n, e in _in_batches(lambda p, q: _block_edits(p, q, price), near, x, y).items():
            out[n] = max(out[n], 1 - e / short[n])

    run(1.0, jump, False)
    run(0.04, jump, True)
    run(0.04, 2 * jump, False)
    run(0.04, max(1, jump // 2), False)
    return out


def reaching_similarities(a: list[str], b: list[str], at_least: float) -> np.ndarray:
    """Like ``script_similarities``, but where the edits without any moved piece already reach ``at_least``, the similarity
    by these: cheaper by far and never overrated, but it may be below that of a script with moved pieces."""
    if not len(a):
        return np.zeros(0)
    out = 1 - edit_distances(a, b) / np.array([max(1, min(len(x), len(y))) for x, y in zip(a, b)], float)
    rest = np.flatnonzero(out < at_least)
    if len(rest):
        out[rest] = script_similarities([a[n] for n in rest], [b[n] for n in rest], at_least)
    return out


def block_similarities(a: list[str], b: list[str], at_least: float = 1.0, least: float = GATE) -> np.ndarray:
    """The similarity of each pair on the better strand, see ``script_similarities``.

    Pairs whose common k-mers stand on common bands less often than ``least`` of the shorter one's letters get 0; the
    shortest texts are compared on both strands in any case.
    """
    out, place = np.zeros(len(a)), np.zeros(4**GATE_K, np.int64)
    ready: list[tuple[int, str, str]] = []
    for n, (x, y) in enumerate(zip(a, b)):
        if len(x) > len(y):
            x, y = y, x
        if not x:
            continue
        back = reverse_complement(x)
        if len(x) < SHORT:
            out[n] = max(0.0, 1 - min(edit_distance(x, y), edit_distance(back, y)) / len(x))
            ready += [(n, x, y), (n, back, y)]
            continue
        codes, at = strand_kmers(y, 1)[0]
        place[codes] = at + 1
        fits = [int(band_excess(_pair_bands(c, p, place, len(x)))) for c, p in strand_kmers(x)]
        place[codes] = 0
        if max(fits) >= least * len(x):
            ready.append((n, back if fits[1] > fits[0] else x, y))
    for (n, *_), sim in zip(ready, script_similarities([t[1] for t in ready], [t[2] for t in ready], at_least)):
        out[n] = max(out[n], sim)
    return out


def block_similarity(a: str, b: str) -> float:
    return float(block_similarities([a], [b])[0])
