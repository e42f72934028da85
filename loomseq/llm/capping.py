"""Problem 4: a cap on the records of each contributor.

Method: a contributor's cap is split over its strata (topics, periods) by largest-remainder apportionment; slots that a
stratum can't fill go to the others; inside each stratum the best records by quality stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apportion(sizes: np.ndarray, cap: int, weights: np.ndarray) -> np.ndarray:
    """Slots of each stratum: shares of ``cap`` by whole-number ``weights``, the remainder to the largest fractions (then
    to the first), never above ``sizes``; spare slots are shared out again among strata with room."""
    slots = np.zeros(len(sizes), np.int64)
    left = int(min(cap, sizes.sum()))
    while left > 0:
        room = sizes - slots
        w = np.where(room > 0, np.maximum(weights, 1), 0).astype(np.int64)
        give, fraction = np.divmod(left * w, int(w.sum()))
        rest = left - int(give.sum())
        give[np.lexsort((np.arange(len(sizes)), -fraction))[:rest]] += 1
        give = np.minimum(give, room)
        slots += give
        left -= int(give.sum())
    return slots


def cap_contributors(df: DataFrame, contributor: Column, quality: Column, ties: list[Column], cap: int = 40, stratum: Column | None = None, even: bool = False, share: float | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with ``contributor_rows`` (rows of the contributor before) and ``stratum_rank``.

    ``stratum``: null strata are one stratum; without it each contributor is one stratum, so its best ``cap`` rows
    stay. ``even`` gives all strata of a contributor the same weight instead of their sizes. ``share`` lowers the cap to
    that share of all rows (at least 1). Higher ``quality`` first, null last, then ``ties`` ascending. Rows with a null
    contributor belong to nobody and all stay. All columns are kept, repeated rows count as often as they occur, an
    empty table gives an empty table.

    Strata are few per contributor (periods or topics), so the slots of one contributor are a small group of counts.
    Rows are ranked with a constant limit first, which Spark applies in every task before the shuffle: a contributor or
    stratum with a third of all rows sends at most ``cap`` rows per task.
    """
    rows = df.withColumns({"_c": contributor, "_s": (stratum if stratum is not None else F.lit("")).cast("string")})
    sizes = rows.where("_c is not null").groupBy("_c", "_s").agg(F.count("*").alias("_n"))
    if share is not None:
        cap = max(1, min(cap, int(share * df.count())))

    def slots(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s", na_position="first", kind="stable")
        n = pdf["_n"].to_numpy()
        return pd.DataFrame({"_c": pdf["_c"], "_s": pdf["_s"], "_slots": apportion(n, cap, np.ones(len(n), np.int64) if even else n)})

    totals = sizes.groupBy(F.col("_c").alias("_pc")).agg(F.sum("_n").alias("contributor_rows"))
    # only contributors above the cap need their slots shared out
    plan = sizes.join(totals.where(F.col("contributor_rows") > cap), F.col("_c") == F.col("_pc"), "left_semi")
    plan = plan.groupBy("_c").applyInPandas(slots, "_c string, _s string, _slots long").select(F.col("_c").alias("_sc"), F.col("_s").alias("_ps"), "_slots")
    order = Window.partitionBy("_c", "_s").orderBy(quality.desc_nulls_last(), *[t.asc() for t in ties])
    best = rows.where("_c is not null").withColumn("stratum_rank", F.row_number().over(order)).where(F.col("stratum_rank") <= cap)
    kept = best.join(totals, F.col("_c") == F.col("_pc")).join(plan, (F.col("_c") == F.col("_sc")) & F.col("_s").eqNullSafe(F.col("_ps")), "left")
    kept = kept.where((F.col("contributor_rows") <= cap) | (F.col("stratum_rank") <= F.col("_slots"))).drop("_pc", "_sc", "_ps", "_slots")
    free = rows.where("_c is null").withColumns({"stratum_rank": F.lit(None).cast("int"), "contributor_rows": F.lit(None).cast("bigint")})
    return kept.unionByName(free).drop("_c", "_s")
