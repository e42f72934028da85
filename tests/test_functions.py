import random

import pytest
from pyspark.sql import functions as F

from loomseq.functions import dna


def one(spark, expr, **cols):
    types = {str: "string", int: "int", float: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_revcomp_is_an_involution(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGTRYKMSWBVDHN- ") for _ in range(rng.randint(0, 40))),) for _ in range(50)] + [(None,)]
    df = spark.createDataFrame(rows, "s string")
    for r in df.select("s", dna.revcomp(dna.revcomp(F.col("s"))).alias("t")).collect():
        assert r["s"] == r["t"]
    assert one(spark, dna.revcomp(F.col("s")), s="aacgR") == "YCGTT"


def test_expand(spark):
    assert one(spark, dna.expand_iupac(F.col("s")), s="ARY") == ["AAC", "AAT", "AGC", "AGT"]
    assert len(one(spark, dna.expand_iupac(F.col("s")), s="NNB")) == 48 == one(spark, dna.expand_iupac_count(F.col("s")), s="NNB")
    assert one(spark, dna.expand_iupac(F.col("s")), s="") == [""] and one(spark, dna.expand_iupac(F.col("s")), s=None) is None


def test_phred(spark):
    assert one(spark, dna.phred(F.col("q")), q='!"I') == [0, 1, 40]
    assert one(spark, dna.phred(F.col("q")), q="") == []
    assert one(spark, dna.phred_gap(F.col("s"), F.col("q")), s="-AC--G-", q="555") == '"55""5"'


@pytest.mark.parametrize("s,want", [("--AC-G-", (2, 6)), ("ACG", (0, 3)), ("---", (-1, -1)), ("-A", (1, 2))])
def test_endgap(spark, s, want):
    assert tuple(one(spark, dna.endgap(F.col("s")), s=s)) == want


def test_cigar(spark):
    assert [tuple(x) for x in one(spark, dna.cigar_ops(F.col("c")), c="3M12I1D")] == [(3, "M"), (12, "I"), (1, "D")]
    assert one(spark, dna.cigar_total(F.col("c"), "MI"), c="3M12I1D") == 15
    assert tuple(one(spark, dna.cigar_offsets(F.col("c")), c="5S2D9M3I")) == (5, 2, 3, 0)
    a = one(spark, dna.cigar_align(F.col("q"), F.col("t"), F.col("c")), q="ACGTT", t="ACTTA", c="2M1I2M1D")
    assert (a["query"], a["target"], a["ticks"]) == ("ACGTT-", "AC-TTA", "|| || ")


def test_slices_and_scores(spark):
    x = lambda o: one(spark, dna.slice_strand(F.col("s"), F.lit(1), F.lit(4), F.lit(o)), s="AACGT")
    assert x("+") == "ACG" and x("-") == "CGT"
    assert one(spark, dna.similarity(F.lit(3), F.lit(10), F.lit(20)), s="") == pytest.approx(0.7)
    assert one(spark, dna.similarity(F.lit(30), F.lit(10), F.lit(20)), s="") == 0
    assert one(spark, dna.similarity(F.lit(1), F.lit(0), F.lit(20)), s="") is None
    assert dna.size_ranges("500-1200, 2000-3000") == [(500, 1200), (2000, 3000)] and dna.size_ranges("") == []
    assert one(spark, dna.in_size_ranges(F.lit(500), [(500, 1200)]), s="") is False
