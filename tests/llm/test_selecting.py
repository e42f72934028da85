import random
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomseq.llm.capping import apportion, cap_contributors
from loomseq.llm.topn import latest_rows, top_n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(0, 120), st.booleans())
def test_apportion_fills_the_cap(sizes, cap, even):
    n = np.array(sizes)
    s = apportion(n, cap, np.ones(len(n)) if even else n.astype(float))
    assert s.sum() == min(cap, n.sum()) and (s <= n).all() and (s >= 0).all()
    if not even and n.sum() > cap:
        assert (np.abs(s - cap * n / n.sum()) < 1 + 1e-9).all()


def test_apportion_by_hand():
    assert apportion(np.array([50, 30, 20]), 11, np.array([50.0, 30, 20])).tolist() == [6, 3, 2]
    assert apportion(np.array([1, 100, 100]), 30, np.ones(3)).tolist() == [1, 15, 14]


ROWS = "k long, who string, day string, q double, _n long, rank int, _c string"


def sample(seed=1, n=4000):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        who = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None, "rare" if k < 5 else "d"])
        q = rng.choice([None, float("nan")]) if rng.random() < 0.05 else float(rng.randrange(30))
        out.append((k, who, rng.choice(["m", "t", "w", None]), q, 1, 1, "x"))
    return out


def key(r):
    bad = r[3] is None or r[3] != r[3]
    return (bad, 0 if bad else -r[3], r[0])


def test_top_n_against_brute_force(spark):
    rows = sample()
    for n in (1, 3, 50):
        want = set()
        for w in {r[1] for r in rows} - {None}:
            want |= {(w, r[0], i + 1) for i, r in enumerate(sorted((r for r in rows if r[1] == w), key=key)[:n])}
        df = spark.createDataFrame(rows, ROWS).repartition(5)
        got = top_n(df.drop("rank"), "who", "q", ["k"], n=n)
        assert {(r["who"], r["k"], r["rank"]) for r in got.collect()} == want
        assert "_n" in got.columns and "_c" in got.columns


def test_top_n_negative_scores_and_empty(spark):
    df = spark.createDataFrame([(1, "a", -5.0), (2, "a", -900.0), (3, "a", None), (4, "a", -5.0)], "k long, g string, s double")
    assert [r["k"] for r in top_n(df, "g", "s", ["k"], n=3).orderBy("rank").collect()] == [1, 4, 2]
    assert top_n(df.limit(0), "g", "s", ["k"]).count() == 0


def test_cap_without_strata_keeps_the_best(spark):
    rows = sample(2)
    df = spark.createDataFrame(rows, ROWS).drop("_n", "_c")
    got = cap_contributors(df, F.col("who"), F.nanvl("q", F.lit(None).cast("double")), [F.col("k")], cap=40)
    want = {r[0] for r in rows if r[1] is None}
    for w in {r[1] for r in rows} - {None}:
        want |= {r[0] for r in sorted((r for r in rows if r[1] == w), key=key)[:40]}
    assert {r["k"] for r in got.collect()} == want
    assert cap_contributors(df.limit(0), F.col("who"), F.col("q"), [F.col("k")]).count() == 0


def test_cap_with_strata(spark):
    rows = sample(3)
    df = spark.createDataFrame(rows, ROWS).drop("_n", "_c")
    got = cap_contributors(df, F.col("who"), F.nanvl("q", F.lit(None).cast("double")), [F.col("k")], cap=30, stratum=F.col("day")).collect()
    for w in {r[1] for r in rows} - {None}:
        own = [r for r in rows if r[1] == w]
        days = sorted({r[2] for r in own}, key=lambda d: (d is not None, d or ""))
        size = np.array([sum(r[2] == d for r in own) for d in days])
        slots = apportion(size, 30, size.astype(float)) if size.sum() > 30 else size
        for d, s in zip(days, slots):
            assert {r["k"] for r in got if r["who"] == w and r["day"] == d} == {r[0] for r in sorted((r for r in own if r[2] == d), key=key)[:s]}


def test_latest_rows(spark):
    t = [datetime(2025, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([(1, "a", t[0]), (1, "b", t[2]), (1, "b", t[2]), (None, "c", t[1]), (2, None, t[1])], "k long, v string, at timestamp")
    assert {(r["k"], r["v"]) for r in latest_rows(df, "k", "at", {"v": F.col("v")}).collect()} == {(1, "b"), (2, None)}
