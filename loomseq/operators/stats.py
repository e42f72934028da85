"""Aggregates, histograms and seeded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def portable_hash(key: Column, seed: int = 0) -> Column:
    """A multiplicative hash of a non-negative whole number, between 0 and 1, that any SQL engine can repeat."""
    return F.pmod((key.cast("bigint") % 1_000_003 + seed) * 2654435761, F.lit(4294967296).cast("bigint")) / F.lit(4294967296.0)


def contingency(df: DataFrame, x: str, y: str, ys: list) -> DataFrame:
    """Counts of ``y`` labels (columns) per ``x`` label (rows)."""
    return df.where(F.col(y).isin(ys)).groupBy(x).pivot(y, ys).count().na.fill(0)


def group_values(df: DataFrame, group: str, value: str, wanted: DataFrame | None = None) -> DataFrame:
    """``group, n, total, values``: the sorted distinct values of each group; a wanted group without rows has ``[-1]``."""
    got = df.groupBy(group).agg(F.count(value).alias("n"), F.sort_array(F.collect_set(value)).alias("values"))
    if wanted is None:
        return got
    return wanted.select(group).distinct().join(got, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("values", F.array(F.lit(-1))).alias("values"))


def group_percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """10, 25, 50, 75 and 90 % (linear interpolation) and the number of values of each group."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    q = df.groupBy(group).agg(p.alias("p"), F.count(value).alias("n"))
    return q.select(group, *[F.col("p")[i].alias(f"p{n}") for i, n in enumerate((10, 25, 50, 75, 90))], "n")


def length_histogram(df: DataFrame, length: Column, width: int = 100, most: int = 50_000) -> DataFrame:
    """``bin, n, mb``: rows and millions of letters by length in steps of ``width`` from 0 to ``most``."""
    rows = df.select(length.alias("n")).where((F.col("n") >= 0) & (F.col("n") < most))
    return rows.groupBy((F.floor(F.col("n") / width) * width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), (F.sum("n") / 1e6).alias("mb"))


def sample_per_group(df: DataFrame, group: str, key: Column, n: int, seed: int = 0, tie: str | None = None) -> DataFrame:
    """``n`` rows of each group by hash of ``key``: the same rows whenever and wherever it runs."""
    order = [portable_hash(key, seed), *([F.col(tie)] if tie else [])]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def sample_by_weight(df: DataFrame, group: str, weight: Column, key: Column, metric: str, n: int, mode: str = "sorted", seed: int = 0, tie: str = "hit_id") -> DataFrame:
    """Members of each group for a recomputation: ``rand`` takes any ``n``; ``semi`` keeps a row with probability
    ``weight`` (1 from 0.5 on), then any ``n``; ``sorted`` the same, then the ``n`` highest by ``metric``."""
    kept = df if mode == "rand" else df.where((weight >= 0.5) | (portable_hash(key, seed + 1) < weight))
    order = [F.col(metric).desc_nulls_last(), F.col(tie)] if mode == "sorted" else [portable_hash(key, seed), F.col(tie)]
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def replicate(df: DataFrame, weight: Column) -> DataFrame:
    """Every row as often as its whole-number weight says; not at all for 0, less or null."""
    return df.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.greatest(F.coalesce(weight.cast("int"), F.lit(0)), F.lit(0))))).drop("_n")


def key_overlap(df: DataFrame, file: str, key: str) -> DataFrame:
    """``file1 < file2``, their sizes, the keys only one of them has, and the keys both have, for pairs that share any.

    Keys per file are made distinct first; pairs come from an equi-join on the key, so files that share nothing cost
    nothing. A key that many files hold gives a pair for each two of them.
    """
    rows = df.select(F.col(file).alias("file"), F.col(key).alias("key")).where("file is not null and key is not null").distinct()
    size = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    shared = rows.withColumnRenamed("file", "file1").join(rows.withColumnRenamed("file", "file2"), "key").where("file1 < file2").groupBy("file1", "file2").agg(F.count(F.lit(1)).alias("intersection"))
    a, b = size.select(F.col("file").alias("file1"), F.col("n").alias("len1")), size.select(F.col("file").alias("file2"), F.col("n").alias("len2"))
    out = shared.join(a, "file1").join(b, "file2")
    return out.select("file1", "len1", (F.col("len1") - F.col("intersection")).alias("len1_only"), "file2", "len2", (F.col("len2") - F.col("intersection")).alias("len2_only"), "intersection")
