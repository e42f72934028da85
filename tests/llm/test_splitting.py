import random
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomseq.llm.splitting import IUPAC, pattern_starts, split_reads, split_spans

from .test_dna import dna


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=120), st.sets(st.integers(1, 119)), st.integers(12, 60), st.integers(0, 11))
def test_spans(sizes, cuts, limit, overlap):
    ends = np.cumsum(sizes).astype(np.int64)
    spans = split_spans(ends, np.array(sorted(cuts), np.int64), limit, overlap)
    size = lambda a, b: sum(sizes[a:b])
    if not sizes:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(sizes)
    for a, b, how in spans:
        assert a < b and (size(a, b) <= limit or b == a + 1)
        if how == "boundary":
            assert b in cuts
    for (a, b, _), (c, d, _) in zip(spans, spans[1:]):
        assert a < c <= b < d  # nothing lost, always forward
        assert size(c, b) >= overlap or c == a + 1 or size(c - 1, b + 1) > limit
        assert c + 1 > b or size(c + 1, b) < overlap or overlap == 0


def test_bases_are_cut_at_the_last_boundary_that_fits():
    spans = split_spans(np.arange(1, 10_001), np.array([500, 3900, 4100, 7000]), 4000, 100)
    assert spans == [(0, 3900, "boundary"), (3800, 7000, "boundary"), (6900, 10_000, "end")]
    assert split_spans(np.arange(1, 9001), np.array([], np.int64), 4000, 100) == [(0, 4000, "hard"), (3900, 7900, "hard"), (7800, 9000, "end")]
    assert split_spans(np.arange(1, 4001), np.array([100]), 4000, 100) == [(0, 4000, "end")]


def brute_starts(seq, pattern, most):
    seq, out = seq.upper(), []
    for i in range(len(seq) - len(pattern) + 1):
        miss = sum(p != "N" and not (seq[i + k] in "ACGT" and IUPAC[seq[i + k]] & IUPAC[p]) for k, p in enumerate(pattern))
        if miss <= most:
            out.append(i)
    return out


def test_pattern_starts_against_brute_force():
    rng = random.Random(1)
    pattern = "ACRYNTGGWACCATGKMA"
    concrete = "ACGTATGGAACCATGGAA"
    for _ in range(20):
        s = dna(rng, 300)
        for _ in range(6):
            p = list(concrete)
            for _ in range(rng.randint(0, 4)):
                p[rng.randrange(len(p))] = rng.choice("ACGTN")
            at = rng.randrange(280)
            s = s[:at] + "".join(p) + s[at + len(p) :]
        s = "".join(rng.choice((c, c.lower())) for c in s)
        got = pattern_starts(s, [np.array([IUPAC[c] for c in pattern], np.uint8)])
        assert got.tolist() == brute_starts(s, pattern, 2)
    assert len(pattern_starts("ACG", [np.array([1] * 5, np.uint8)])) == 0


def test_reads(spark):
    rng = random.Random(2)
    fwd, rev = "ACGGTTACCAGTACGGA", "TTGGCCAATCGCATTAC"
    body = [dna(rng, 700) for _ in range(8)]
    long = "".join(fwd + b for b in body)
    t = datetime(2025, 1, 1)
    reads = [("r1", long, 3, t, "x"), ("r1", long, -1, datetime(2025, 1, 2), "x"), ("r2", dna(rng, 4001), None, t, "x"), ("r3", long[:4000], 9999, t, "x"), ("r4", None, 1, t, "x"), (None, long, 1, t, "x"), ("r5", "", 0, t, "x")]
    primers = [("f", fwd[:5] + " " + fwd[5:].lower(), "r", rev), ("f2", "ACGT", "r2", None)]
    df = spark.createDataFrame(reads, "id string, sequence string, length int, loaded_at timestamp, piece string")
    pr = spark.createDataFrame(primers, "fwd_id string, fwd_seq string, rev_id string, rev_seq string")
    got = split_reads(df, pr).orderBy("id", "piece_no").collect()
    assert {r["id"] for r in got} == {"r1", "r2"}
    r1 = [r for r in got if r["id"] == "r1"]
    assert [b for r in r1 for b in r["boundaries"]] == [717 * k for k in range(1, 8)] and r1[0]["n_boundaries"] == 7
    assert [(r["start"], r["stop"], r["cut"]) for r in r1] == [(0, 3585, "boundary"), (3485, len(long), "end")]
    assert r1[0]["piece"] + r1[1]["piece"][100:] == long
    r2 = [r for r in got if r["id"] == "r2"]
    assert r2[0]["boundaries"] == [] and [(r["start"], r["stop"]) for r in r2] == [(0, 4000), (3900, 4001)]
    assert split_reads(df.limit(0), pr).count() == 0
    assert split_reads(df, pr.limit(0)).where("cut = 'boundary'").count() == 0
