"""Column types of the tables that operators exchange, and checks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


READS = _struct("id string, sequence string, quality string, read_no int, ch int, start_time timestamp, length int, header string")
SEQUENCES = _struct("id string, sequence string")
PRIMERS = _struct("fwd_id string, fwd_seq string, rev_id string, rev_seq string")
HITS = _struct(
    "query_id string, q_len int, q_start int, q_end int, orientation string, database_id string, t_len int, t_start int, t_end int, n_match int, tot int, mapq int, "
    "tp string, cm int, s1 int, s2 int, nm int, as_score int, ms int, nn int, rl int, cigar string, match_score double, similarity double"
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def sequence_set_kind(df: DataFrame) -> str:
    """What a table of sequences is by its columns: fasta, fastq, paired_fasta or paired_fastq."""
    c = set(df.columns)
    if {"id", "fwd_seq", "rev_seq"} <= c:
        return "paired_fastq" if {"fwd_quality", "rev_quality"} <= c else "paired_fasta"
    if {"id", "sequence"} <= c:
        return "fastq" if "quality" in c else "fasta"
    raise ValueError("a set of sequences needs id and sequence, or id, fwd_seq and rev_seq")
