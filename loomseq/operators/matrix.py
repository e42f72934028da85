"""Pairwise matrices in long form: ``row_id, col_id, value``; a wide table only at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_long(hits: DataFrame, metric: str, tie: str = "hit_id") -> DataFrame:
    """One value per query and target: of several hits the one with the largest ``tie``; missing cells are not listed."""
    rows = hits.where(F.col(metric).isNotNull())
    return rows.groupBy(F.col("query_id").alias("row_id"), F.col("database_id").alias("col_id")).agg(F.max_by(F.col(metric).cast("double"), F.col(tie)).alias("value"))


def feature_wide(long: DataFrame, columns: list[str]) -> DataFrame:
    """The matrix with one column per given target, 0 where there is no value."""
    return long.where(F.col("col_id").isin(columns)).groupBy("row_id").pivot("col_id", columns).agg(F.first("value")).na.fill(0.0)


def symmetric(long: DataFrame, larger: bool = False) -> DataFrame:
    """Both directions of each pair with one value: the larger of the two, or the smaller that is not 0."""
    a, b = F.least("row_id", "col_id"), F.greatest("row_id", "col_id")
    v = F.max("value") if larger else F.min(F.when(F.col("value") != 0, F.col("value")))
    half = long.groupBy(a.alias("a"), b.alias("b")).agg(F.coalesce(v, F.lit(0.0)).alias("value"))
    return half.select("a", "b", "value", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("_s")).select(
        F.when(F.col("_s") == 0, F.col("a")).otherwise(F.col("b")).alias("row_id"), F.when(F.col("_s") == 0, F.col("b")).otherwise(F.col("a")).alias("col_id"), "value"
    )


def to_distance(long: DataFrame) -> DataFrame:
    """``1 - value``, 0 on the diagonal. Cells that are not listed are at distance 1."""
    return long.select("row_id", "col_id", F.when(F.col("row_id") == F.col("col_id"), F.lit(0.0)).otherwise(1 - F.col("value")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_columns(long: DataFrame) -> DataFrame:
    """Cosine distance of the columns of a sparse matrix that share a row, ``col_a < col_b``: an equi-join on the row and
    one aggregation; columns without a common row are at distance 1 and not listed. At most 1 - 1 = 0 from rounding."""
    rows = long.where("value <> 0").select("row_id", "col_id", "value")
    norm = rows.groupBy("col_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    a, b = rows.select("row_id", F.col("col_id").alias("col_a"), F.col("value").alias("x")), rows.select("row_id", F.col("col_id").alias("col_b"), F.col("value").alias("y"))
    dots = a.join(b, "row_id").where("col_a < col_b").groupBy("col_a", "col_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na, nb = norm.select(F.col("col_id").alias("col_a"), F.col("norm").alias("na")), norm.select(F.col("col_id").alias("col_b"), F.col("norm").alias("nb"))
    return dots.join(na, "col_a").join(nb, "col_b").select("col_a", "col_b", (1 - F.least(F.lit(1.0), F.col("dot") / (F.col("na") * F.col("nb")))).alias("value"))
