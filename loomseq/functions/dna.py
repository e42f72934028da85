"""Scalar functions on sequences, qualities, CIGAR strings and coordinates, all as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC letters, the concrete bases they stand for (in the order of expansion), and their complements.
IUPAC_BASES = {"A": "A", "T": "T", "G": "G", "C": "C", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ATGC"}
COMPLEMENT_FROM, COMPLEMENT_TO = "ATGCRYKMBVDH", "TACGYRMKVBHD"


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case; S, W, N, gaps and blanks are their own complement. Null gives null."""
    return F.reverse(F.translate(F.upper(seq), COMPLEMENT_FROM, COMPLEMENT_TO))


def is_iupac(seq: Column) -> Column:
    """Whether a sequence has only IUPAC letters, gaps and blanks in any letter case."""
    return F.upper(seq).rlike("^[ATGCRYKMBVDHSWN -]*$")


def degap(seq: Column) -> Column:
    """Upper case without gaps and blanks."""
    return F.regexp_replace(F.upper(seq), "[- ]", "")


def expand_iupac(seq: Column) -> Column:
    """All concrete sequences of a degenerate one, left to right; other letters stay. The number of results is the
    product of the letters' choices, so this is meant for primers. Null gives null, the empty text gives itself."""
    letters = F.create_map(*[F.lit(x) for k, v in IUPAC_BASES.items() for x in (k, v)])
    chars = F.filter(F.split(F.upper(seq), ""), lambda c: c != "")

    def grow(done: Column, c: Column) -> Column:
        bases = F.split(F.coalesce(letters[c], c), "")
        return F.flatten(F.transform(done, lambda s: F.transform(F.filter(bases, lambda b: b != ""), lambda b: F.concat(s, b))))

    return F.when(seq.isNotNull(), F.aggregate(chars, F.array(F.lit("")), grow))


def expand_iupac_count(seq: Column) -> Column:
    """How many sequences ``expand_iupac`` gives."""
    n = F.create_map(*[F.lit(x) for k, v in IUPAC_BASES.items() for x in (k, len(v))])
    return F.aggregate(F.split(F.upper(seq), ""), F.lit(1).cast("bigint"), lambda a, c: a * F.coalesce(n[c], F.lit(1)))


def phred(quality: Column) -> Column:
    """Phred scores of an ASCII+33 string."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def mean_phred(quality: Column) -> Column:
    q = phred(quality)
    return F.when(F.length(quality) > 0, F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.length(quality))


def phred_gap(aligned: Column, quality: Column) -> Column:
    """A quality string stretched to an aligned sequence: every gap gets ``"`` (score 1)."""
    step = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        gap = c == "-"
        return F.struct(F.concat(acc["out"], F.when(gap, F.lit('"')).otherwise(F.substring(quality, acc["at"], F.lit(1)))).alias("out"), (acc["at"] + F.when(gap, 0).otherwise(1)).alias("at"))

    return F.when(aligned.isNotNull() & quality.isNotNull(), F.aggregate(F.filter(F.split(aligned, ""), lambda c: c != ""), step, put, lambda acc: acc["out"]))


def endgap(aligned: Column) -> Column:
    """``start, stop`` of the part without outer gaps; -1, -1 where there are only gaps."""
    n = F.length(aligned)
    lead = n - F.length(F.regexp_replace(aligned, "^-+", ""))
    trail = F.length(F.regexp_replace(aligned, "-+$", ""))
    gone = trail == 0
    return F.when(aligned.isNotNull(), F.struct(F.when(gone, -1).otherwise(lead).alias("start"), F.when(gone, -1).otherwise(trail).alias("stop")))


def cigar_ops(cigar: Column, ops: str = "MIDNSHPX=") -> Column:
    """``len, op`` of each operation among ``ops`` in a CIGAR string."""
    pattern = f"(\\d+)([{ops}])"
    pairs = F.arrays_zip(F.regexp_extract_all(cigar, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(cigar, F.lit(pattern), F.lit(2)).alias("op"))
    return F.transform(pairs, lambda x: F.struct(x["n"].cast("int").alias("len"), x["op"].alias("op")))


def cigar_total(cigar: Column, ops: str) -> Column:
    """Letters covered by the operations ``ops``; null for a null CIGAR."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def cigar_offsets(cigar: Column) -> Column:
    """Letters that the ends of an alignment leave out: ``q_start, q_tail`` from outer insertions and clips,
    ``t_start, t_tail`` from outer deletions."""
    edge = lambda rx: F.coalesce(F.nullif(F.regexp_extract(cigar, rx, 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(cigar.isNotNull(), F.struct(edge(r"^(?:\d+D)?(\d+)[IS]").alias("q_start"), edge(r"^(?:\d+[IS])?(\d+)D").alias("t_start"), edge(r"(\d+)[IS](?:\d+D)?$").alias("q_tail"), edge(r"(\d+)D(?:\d+[IS])?$").alias("t_tail")))


def cigar_align(query: Column, target: Column, cigar: Column) -> Column:
    """``query, target, ticks``: both sequences with gaps put in, and a bar under every aligned pair (``M``, ``=``)."""
    start = F.struct(F.lit("").alias("q"), F.lit("").alias("t"), F.lit("").alias("k"), F.lit(1).alias("i"), F.lit(1).alias("j"))

    def put(acc: Column, x: Column) -> Column:
        n, op = x["len"], x["op"]
        gap, both = F.repeat(F.lit("-"), n), op.isin("M", "X", "=", "S")
        q, t = F.substring(query, acc["i"], n), F.substring(target, acc["j"], n)
        qs = F.when(op == "S", F.lower(q)).when(both | (op == "I"), q).otherwise(gap)
        ts = F.when(both | (op == "D"), t).otherwise(gap)
        ks = F.repeat(F.when(op.isin("M", "="), F.lit("|")).otherwise(F.lit(" ")), n)
        return F.struct(F.concat(acc["q"], qs).alias("q"), F.concat(acc["t"], ts).alias("t"), F.concat(acc["k"], ks).alias("k"), (acc["i"] + F.when(both | (op == "I"), n).otherwise(0)).alias("i"), (acc["j"] + F.when(both | (op == "D"), n).otherwise(0)).alias("j"))

    ops = cigar_ops(cigar, "MIDSX=")
    return F.when(query.isNotNull() & target.isNotNull() & cigar.isNotNull(), F.aggregate(ops, start, put, lambda a: F.struct(a["q"].alias("query"), a["t"].alias("target"), a["k"].alias("ticks"))))


def slice_strand(seq: Column, start: Column, stop: Column, orientation: Column) -> Column:
    """Letters ``start`` up to ``stop`` (0-based, half open), as reverse complement on strand ``-``."""
    part = F.substring(seq, F.greatest(start, F.lit(0)) + 1, F.greatest(stop - F.greatest(start, F.lit(0)), F.lit(0)))
    return F.when(orientation == "-", revcomp(part)).otherwise(part)


def slice_quality(quality: Column, start: Column, stop: Column, orientation: Column) -> Column:
    part = F.substring(quality, F.greatest(start, F.lit(0)) + 1, F.greatest(stop - F.greatest(start, F.lit(0)), F.lit(0)))
    return F.when(orientation == "-", F.reverse(part)).otherwise(part)


def similarity(nm: Column, q_len: Column, t_len: Column) -> Column:
    """``1 - nm / shorter length``, at least 0; null where a length is not above 0."""
    short = F.least(q_len, t_len)
    return F.when(short > 0, F.greatest(F.lit(0.0), 1 - nm / short))


def primer_error(fwd_match: Column, fwd_tot: Column, rev_match: Column, rev_tot: Column) -> Column:
    return 1 - (fwd_match + rev_match) / (fwd_tot + rev_tot)


def size_ranges(text: str) -> list[tuple[int, int]]:
    """``"500-1200,2000-3000"`` as pairs."""
    return [(int(a), int(b)) for a, b in (x.split("-") for x in text.replace(" ", "").split(",") if x)]


def in_size_ranges(length: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a length lies strictly inside one of the ranges. A row in several ranges is one row."""
    return reduce(lambda a, b: a | b, [(length > lo) & (length < hi) for lo, hi in ranges], F.lit(False))


def is_reverse(flag: Column) -> Column:
    """Bit 16 of a SAM flag."""
    return flag.bitwiseAND(16) != 0
