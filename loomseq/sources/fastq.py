"""FASTQ and FASTA files as tables, and the header of nanopore reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def header_fields(header: Column) -> dict[str, Column]:
    """``id, read_no, ch, run_id, start_time`` of a read header ``@id runid=... read=... ch=... start_time=...``; numbers
    that are not there are -1, the rest null."""
    get = lambda key, rx: F.nullif(F.regexp_extract(header, f"(?:^| ){key}=({rx})", 1), F.lit(""))
    number = lambda key: F.coalesce(get(key, r"\d+").cast("int"), F.lit(-1))
    return {
        "id": F.regexp_extract(header, r"^@?(\S*)", 1),
        "read_no": number("read"),
        "ch": number("ch"),
        "run_id": get("runid", r"\S+"),
        "start_time": F.try_to_timestamp(F.regexp_replace(get("start_time", r"\S+"), "Z$", "")),
    }


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``id, sequence, quality, filename`` of four-line records. Plain, ``.gz`` and ``.bz2`` files, globs and folders.

    A FASTQ file can't be split safely by lines, so one file is one task's work; runs come as many files.
    """
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("filename"), F.split("value", "\r?\n").alias("lines"))
    n = F.floor(F.size("lines") / 4).cast("int")
    records = text.where(n > 0).select("filename", "lines", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    line = lambda i: F.col("lines")[F.col("k") * 4 + i]
    return records.where(line(0).startswith("@")).select(F.expr("substring(lines[k * 4], 2)").alias("id"), line(1).alias("sequence"), line(3).alias("quality"), "filename")


def load_reads(spark: SparkSession, paths: str | list[str], header: bool = False) -> DataFrame:
    """Reads of all files with the fields of their headers and ``length``; ``header=True`` keeps the raw header."""
    raw = read_fastq(spark, paths)
    f = header_fields(F.col("id"))
    out = raw.select(f["id"].alias("id"), "sequence", "quality", f["read_no"].alias("read_no"), f["ch"].alias("ch"), f["start_time"].alias("start_time"), F.length("sequence").alias("length"), F.col("id").alias("header"))
    return out if header else out.drop("header")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``id, sequence`` of multi-line records; the id is the whole header line; records without letters leave. Split at
    record starts, so a large plain file is read by many tasks."""
    rows = spark.read.option("lineSep", "\n>").text(paths)
    v = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(v, "\n", 1), "\r$", "")
    body = F.when(F.instr(v, "\n") > 0, F.regexp_replace(F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\\n') + 1)"), r"\s", "")).otherwise(F.lit(""))
    return rows.select(head.alias("id"), body.alias("sequence")).where("sequence <> ''")
