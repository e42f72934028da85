"""Writers: FASTQ, FASTA, tables, and alignments as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.schema import require

_CODECS = {None: "none", "gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "bzip2": "bzip2"}


def write_fastq(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Four lines per row with a sequence; a missing quality is written as the lowest score."""
    require(df, "id", "sequence")
    q = F.coalesce("quality", F.regexp_replace("sequence", ".", "!")) if "quality" in df.columns else F.regexp_replace("sequence", ".", "!")
    df.where("id is not null and sequence is not null").select(F.concat(F.lit("@"), "id", F.lit("\n"), "sequence", F.lit("\n+\n"), q).alias("value")).write.option("compression", _CODECS[compression]).text(path)


def write_fasta(df: DataFrame, path: str, compression: str | None = None) -> None:
    require(df, "id", "sequence").where("id is not null and sequence is not null").select(F.concat(F.lit(">"), "id", F.lit("\n"), "sequence").alias("value")).write.option("compression", _CODECS[compression]).text(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.option("header", True).option("compression", _CODECS[compression]).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, the form between stages."""
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def wrapped(texts: list[Column], width: int = 80) -> Column:
    """Texts of one length as an array of lines: ``width`` letters of each under one another, block after block."""
    n = F.ceil(F.length(texts[0]) / width).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array(*[F.substring(t, i * width + 1, F.lit(width)) for t in texts]))
    return F.when(F.length(texts[0]) > 0, F.flatten(blocks)).otherwise(F.array().cast("array<string>"))
