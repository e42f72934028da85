"""Reads that arrive over time: the stateless stages on a stream, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions import dna


def stream_table(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_fastq(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """``id, sequence, quality`` of FASTQ files as they are put into a folder."""
    text = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", per_trigger).text(folder, wholetext=True)
    lines = text.select(F.split("value", "\r?\n").alias("lines"))
    n = F.floor(F.size("lines") / 4).cast("int")
    records = lines.where(n > 0).select("lines", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    at = lambda i: F.col("lines")[F.col("k") * 4 + i]
    return records.select(F.expr("substring(lines[k * 4], 2)").alias("header"), at(1).alias("sequence"), at(3).alias("quality"))


def first_loads(reads: DataFrame, late: str = "7 days") -> DataFrame:
    """Each read id once within the watermark on ``loaded_at``: the load that comes first."""
    return reads.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["id"])


def sized(reads: DataFrame, ranges: str) -> DataFrame:
    """The size filter, as on a table."""
    return reads.where(dna.in_size_ranges(F.length("sequence"), dna.size_ranges(ranges)))


def yield_per_window(reads: DataFrame, width: str = "1 hour", late: str = "2 days", time: str = "start_time") -> DataFrame:
    """Reads and bases per window of event time and run; windows close ``late`` after the newest read."""
    rows = reads.where(F.col(time).isNotNull()).withColumn("_t", F.col(time).cast("timestamp"))
    counted = rows.withWatermark("_t", late).groupBy(F.window("_t", width), "run_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("sequence")).alias("n_bases"))
    return counted.select(F.col("window.start").alias("window_start"), "run_id", "n_reads", "n_bases")
