"""Problem 3: oversized items are cut into pieces under a limit, at natural boundaries where possible.

Method: prefix sums of token sizes and a sorted array of boundaries; the last boundary under the limit is found by binary
search, the next piece begins ``overlap`` earlier, and where no boundary fits a hard cut is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base sets of the IUPAC letters, as sums of A=1, C=2, G=4, T=8.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}

_MASK = np.zeros(256, np.uint8)
for _c in "ACGT":
    _MASK[ord(_c)] = _MASK[ord(_c.lower())] = IUPAC[_c]


def split_spans(ends: np.ndarray, boundaries: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces ``(from, to, how the piece ends)`` of an item in tokens.

    ``ends[t]`` is the size of the item up to and with token t (a prefix sum), ``boundaries`` are sorted token offsets
    at which a piece may begin. A piece is at most ``limit`` large; neighbours share at least ``overlap`` in size (the
    smallest number of whole tokens that reaches it), or less where the next token would not fit beside that. A token larger than the limit is a piece of its own.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else np.empty(0, np.int64)
    pieces, begin, last, n = [], 0, 0, len(ends)
    while begin < n:
        stop = int(np.searchsorted(ends, starts[begin] + limit, "right"))  # tokens that fit
        if stop >= n:
            pieces.append((begin, n, "end"))
            break
        k = int(np.searchsorted(boundaries, stop, "right")) - 1
        # a boundary inside the overlap would leave a piece without anything new
        cut, how = (int(boundaries[k]), "boundary") if k >= 0 and boundaries[k] > last else (max(stop, begin + 1), "hard")
        pieces.append((begin, cut, how))
        if cut >= n:
            break
        last = cut
        back = int(np.searchsorted(starts, ends[cut - 1] - overlap, "right")) - 1
        room = int(np.searchsorted(starts, ends[cut] - limit, "left"))  # so that the next piece gets its first new token
        begin = max(begin + 1, min(cut, max(back, room))) if overlap else cut
    return pieces


def primer_patterns(primers: DataFrame) -> list[str]:
    """Forward and reverse sequences of complete rows as written, upper case, without blanks.

    Primer tables are lists of laboratory reagents; more than 10 000 rows are refused rather than sent to all tasks.
    """
    rows = primers.select("fwd_id", "fwd_seq", "rev_id", "rev_seq").na.drop().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many primers to scan for")
    seqs = {"".join(s.upper().split()) for r in rows for s in (r["fwd_seq"], r["rev_seq"])}
    return sorted(s for s in seqs if s and all(c in IUPAC for c in s))


def pattern_starts(seq: str, patterns: list[np.ndarray], mismatches: int = 2, lead: int = 16) -> np.ndarray:
    """Sorted offsets at which a pattern (array of base sets) begins with at most so many differing letters."""
    bases = _MASK[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    found = [np.empty(0, np.int64)]
    for p in patterns:
        n = len(bases) - len(p) + 1
        if n <= 0:
            continue
        miss = np.zeros(n, np.uint8)
        head = min(lead, len(p))
        for i in range(head):
            if p[i] != 15:
                miss += (bases[i : i + n] & p[i]) == 0
        at = np.flatnonzero(miss <= mismatches)
        if len(at) and head < len(p):
            rest = p[head:]
            tail = bases[at[:, None] + np.arange(head, len(p))[None, :]]
            at = at[miss[at] + (((tail & rest) == 0) & (rest != 15)).sum(axis=1) <= mismatches]
        found.append(at)
    return np.unique(np.concatenate(found))


def oversized_reads(reads: DataFrame, limit: int = 4_000) -> DataFrame:
    """``id, sequence`` of each read longer than the limit, each id once: of rows loaded again the latest with a
    sequence. The stored ``length`` is not used; null ids and null sequences leave."""
    long = reads.where(F.col("id").isNotNull() & (F.length("sequence") > limit)).select("id", "sequence", "loaded_at")
    return long.groupBy("id").agg(F.max_by("sequence", F.struct("loaded_at", "sequence")).alias("sequence"))


def copy_boundaries(reads: DataFrame, primers: DataFrame, mismatches: int = 2) -> DataFrame:
    """``id, sequence, boundaries``: the sorted offsets above 0 at which a copy opens with a primer."""
    patterns = [np.array([IUPAC[c] for c in p], np.uint8) for p in primer_patterns(primers)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = [pattern_starts(s, patterns, mismatches) for s in pdf["sequence"]]
            yield pd.DataFrame({"id": pdf["id"], "sequence": pdf["sequence"], "boundaries": [x[x > 0].astype(np.int32) for x in at]})

    return reads.mapInPandas(scan, "id string, sequence string, boundaries array<int>")


def split_reads(reads: DataFrame, primers: DataFrame, limit: int = 4_000, overlap: int = 100, mismatches: int = 2) -> DataFrame:
    """``id, piece_no, start, stop, cut, piece, boundaries, n_boundaries`` of every read longer than ``limit``.

    Pieces have at most ``limit`` bases and share ``overlap`` bases with the next one; ``cut`` tells how a piece ends:
    at a boundary, hard, or with the read. ``boundaries`` are those that lie in the piece but not in the one before, so
    each is listed once and a read's output grows with its length; ``n_boundaries`` is their number in the read. A base is a token of size 1. Letter case is kept.
    Reads up to the limit are not in the result; an empty table gives an empty table; other columns are ignored.
    """
    found = copy_boundaries(oversized_reads(reads, limit), primers, mismatches)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, seq, at in zip(pdf["id"], pdf["sequence"], pdf["boundaries"]):
                at, seen = np.asarray(at, np.int64), 0
                for n, (a, b, how) in enumerate(split_spans(np.arange(1, len(seq) + 1), at, limit, overlap)):
                    upto = int(np.searchsorted(at, b, "left"))
                    out.append((i, n, a, b, how, seq[a:b], at[seen:upto].astype(np.int32), len(at)))
                    seen = upto
            yield pd.DataFrame(out, columns=["id", "piece_no", "start", "stop", "cut", "piece", "boundaries", "n_boundaries"])

    return found.mapInPandas(cut, "id string, piece_no int, start int, stop int, cut string, piece string, boundaries array<int>, n_boundaries int")
