"""Primer tables, alignment files, stage results, and one reader for all of them by file name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions import dna
from loomseq.schema import PRIMERS, require
from loomseq.sources.fastq import read_fasta, read_fastq

_INT_TAGS = ("cm", "s1", "s2", "nm", "as_score", "ms", "nn", "rl")
#: Tags of alignment files and the columns they become; fixed values.
TAGS = {"tp": "tp", "cm": "cm", "s1": "s1", "s2": "s2", "NM": "nm", "AS": "as_score", "ms": "ms", "nn": "nn", "rl": "rl", "cg": "cigar"}


def load_primers(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of primer pairs; rows that lack anything are dropped, missing columns are an error."""
    df = spark.read.option("header", True).csv(path)
    return require(df, *PRIMERS.names).select(*PRIMERS.names).na.drop()


def read_paf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Hits of a PAF file: twelve fixed columns and the tags in any order; a number tag that is not there is 0."""
    f = F.split(F.col("value"), "\t")
    fixed = ["query_id", "q_len", "q_start", "q_end", "orientation", "database_id", "t_len", "t_start", "t_end", "n_match", "tot", "mapq"]
    text = ("query_id", "orientation", "database_id")
    rows = spark.read.text(paths).where(F.size(f) >= 12).withColumn("f", f)
    tags = F.map_from_entries(F.transform(F.filter(F.slice("f", 13, 1000), lambda x: x.rlike("^..:.:")), lambda x: F.struct(F.substring(x, 1, 2), x.substr(F.lit(6), F.length(x)))))
    rows = rows.withColumn("tags", tags).select(
        *[(F.col("f")[i] if c in text else F.col("f")[i].cast("int")).alias(c) for i, c in enumerate(fixed)],
        *[(F.coalesce(F.col("tags")[t].cast("int"), F.lit(0)) if c in _INT_TAGS else F.col("tags")[t]).alias(c) for t, c in TAGS.items()],
    )
    return rows.withColumn("match_score", F.col("n_match") / F.nullif("tot", F.lit(0))).withColumn("similarity", dna.similarity(F.col("nm"), F.col("q_len"), F.col("t_len")))


def read_sam(spark: SparkSession, paths: str | list[str], lengths: DataFrame | None = None) -> DataFrame:
    """Mapped records of a SAM file; strand from flag bit 16, target bounds from POS and CIGAR, other tags missing as 0.

    ``lengths (database_id, t_len)`` gives the target lengths; without it they come from the ``@SQ`` lines.
    """
    lines = spark.read.text(paths)
    if lengths is None:
        sq = lines.where(F.col("value").startswith("@SQ"))
        lengths = sq.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("database_id"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("t_len")).distinct()
    f = F.split(F.col("value"), "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11)).withColumn("f", f).where(F.col("f")[2] != "*")
    tags = F.map_from_entries(F.transform(F.filter(F.slice("f", 12, 1000), lambda x: x.rlike("^..:.:")), lambda x: F.struct(F.substring(x, 1, 2), x.substr(F.lit(6), F.length(x)))))
    flag, cigar = F.col("f")[1].cast("int"), F.col("f")[5]
    tag = lambda t: F.coalesce(F.col("tags")[t].cast("int"), F.lit(0)).alias({"AS": "as_score"}.get(t, t.lower()))
    rows = rows.withColumn("tags", tags).select(
        F.col("f")[0].alias("query_id"), F.col("f")[2].alias("database_id"), F.when(dna.is_reverse(flag), "-").otherwise("+").alias("orientation"), flag.alias("flag"), (F.col("f")[3].cast("int") - 1).alias("t_start"),
        (F.col("f")[3].cast("int") - 1 + dna.cigar_total(cigar, "MDN=X").cast("int")).alias("t_end"), F.col("f")[4].cast("int").alias("mapq"), cigar.alias("cigar"), dna.cigar_total(cigar, "MIS=XH").cast("int").alias("q_len"), *[tag(t) for t in ("AS", "XS", "XN", "XM", "XO", "XG", "NM")],
    )
    return rows.join(lengths, "database_id", "left").withColumn("similarity", dna.similarity(F.col("nm"), F.col("q_len"), F.col("t_len")))


def pair_mates(sam: DataFrame) -> DataFrame:
    """One row per pair: mates (flag bits 64 and 128) joined by query, target ids and CIGARs put together, scores added."""
    first = sam.where(F.col("flag").bitwiseAND(64) != 0)
    second = sam.where(F.col("flag").bitwiseAND(128) != 0).select("query_id", *[F.col(c).alias(f"_{c}") for c in ("database_id", "cigar", "as_score", "nm", "t_start", "t_end")])
    j = first.join(second, "query_id")
    two = lambda c: F.concat_ws(",", c, f"_{c}").alias(c)
    return j.select("query_id", two("database_id"), "orientation", two("cigar"), (F.col("as_score") + F.col("_as_score")).alias("as_score"), (F.col("nm") + F.col("_nm")).alias("nm"), F.least("t_start", "_t_start").alias("t_start"), F.greatest("t_end", "_t_end").alias("t_end"))


def file_kind(path: str) -> str:
    """csv, fastq, fasta, paf, sam or parquet by the real suffix, compressed or not."""
    name = re.sub(r"\.(gz|bz2)$", "", path.rstrip("/").lower())
    for kind, suffixes in {"csv": ("csv",), "fastq": ("fq", "fastq"), "fasta": ("fa", "fasta", "fna"), "paf": ("paf",), "sam": ("sam",), "parquet": ("parquet",)}.items():
        if name.endswith(tuple("." + s for s in suffixes)):
            return kind
    raise ValueError(f"unknown kind of file: {path}")


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """Any supported file as a table."""
    kind = file_kind(path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return {"fastq": read_fastq, "fasta": read_fasta, "paf": read_paf, "sam": read_sam}[kind](spark, path)


def load_judged(spark: SparkSession, path: str, run_info: bool = False) -> DataFrame:
    """``id, sequence`` to be judged against a truth: ``consensus`` counts as ``sequence``; with ``run_info`` only rows
    marked ``T`` count and their ``haplotype`` columns are renamed; blanks in ids become ``_``."""
    df = load_file(spark, path)
    if run_info and "run_info" in df.columns:
        df = df.where(F.col("run_info") == "T")
    for old, new in (("consensus", "sequence"), ("haplotype", "id"), ("haplotype_sequence", "sequence")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return require(df, "id", "sequence").withColumn("id", F.translate("id", " ", "_"))


def exclude(reads: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Reads without a row in ``done``."""
    return reads.join(done.select(F.col(key).alias("id")), "id", "left_anti")
