"""Problem 6: the N best items of every group, with one fixed order among equal scores.

Method: score histograms per group give a threshold with at least N items at or above it; rows below are dropped before
anything is sorted; what is left is ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.session import materialize


def latest_rows(df: DataFrame, key: str, loaded: str, columns: dict[str, Column]) -> DataFrame:
    """One row per non-null ``key``: of rows loaded more than once the latest (then the largest by its columns)."""
    cols = F.struct(*[c.alias(n) for n, c in columns.items()])
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.max(F.struct(F.col(loaded).alias("_at"), cols.alias("_row"))).alias("_m"))
    return rows.select(key, *[F.col(f"_m._row.{n}").alias(n) for n in columns])


def canonical_database_id(col: str = "database_id") -> Column:
    """Ids of the truth database come in any letter case and with outer blanks; they count as one."""
    return F.upper(F.trim(F.col(col)))


def top_n(df: DataFrame, group: str, score: str, ties: list[str], n: int = 3, bin_width: float = 16.0, hot: int = 200_000) -> DataFrame:
    """The first ``n`` rows of each ``group``: higher ``score`` first, null (and NaN) scores last, then ``ties`` ascending.

    Rows with a null group are no group and leave; groups with fewer than ``n`` rows stay whole; rows equal in score and
    all ties are told apart by no rule, so ``ties`` should end in a key; an empty table gives an empty table; all columns
    are kept. Adds ``rank`` (1 is best).

    The histogram has one row per group and bin, made before the shuffle. Groups of more than ``hot`` rows, or of more
    than one in 100 000 of all rows if that is more, so 100 000 groups at most, have their thresholds sent to every task:
    their rows are filtered where they are, and what is left of them is small before it is brought together. The rows
    of the other groups meet their thresholds, and are ranked, under one shuffle by group. Where a threshold bin itself
    holds millions of rows, the window's group limit cuts each task's part to ``n`` rows.
    """
    s = F.col(score).cast("double")
    s = F.when(F.isnan(s), None).otherwise(s)
    binned = df.where(F.col(group).isNotNull()).withColumn("_bin", F.coalesce(F.floor(s / bin_width), F.lit(-(2**62)).cast("bigint")))
    hist = binned.groupBy(F.col(group).alias("_group"), "_bin").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("_group").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    # the lowest bin that is still needed: fewer than n rows lie in the bins above it
    needed = F.when(F.coalesce(F.sum("_n").over(above), F.lit(0)) < n, F.col("_bin"))
    least = materialize(hist.withColumn("_need", needed).groupBy("_group").agg(F.min("_need").alias("_least"), F.sum("_n").alias("_rows")), "thresholds")
    rows = least.agg(F.sum("_rows")).first()[0] or 0
    few = F.broadcast(least.where(F.col("_rows") > max(hot, rows // 100_000)).select(F.col("_group").alias("_hot"), F.col("_least").alias("_floor")))
    cool = binned.join(few, F.col(group) == F.col("_hot"), "left").where("_floor is null or _bin >= _floor").drop("_hot", "_floor")
    left = cool.join(least.drop("_rows"), F.col(group) == F.col("_group")).where("_bin >= _least")
    order = Window.partitionBy(group).orderBy(s.desc_nulls_last(), *[F.col(t).asc() for t in ties])
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_bin", "_least", "_group")
