"""Selection and annotation of alignment hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions.dna import similarity


def clean_hits(raw: DataFrame) -> DataFrame:
    """Each ``hit_id`` once (the latest load, of equal ones the higher ``as_score``, then the smaller ``nm``), database ids
    trimmed and in upper case, ``similarity`` between 0 and 1 (percentages divided, null taken from ``nm`` and the lengths)."""
    order = Window.partitionBy("hit_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("as_score").desc_nulls_last(), F.col("nm").asc_nulls_last())
    once = raw.where("hit_id is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    sim = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.coalesce("similarity", similarity(F.col("nm"), F.col("q_len"), F.col("t_len"))))
    return once.withColumn("database_id", F.upper(F.trim("database_id"))).withColumn("similarity", sim)


def best_hits(df: DataFrame, by: list[str], metric: str = "as_score", tie: str = "hit_id", smallest: bool = False) -> DataFrame:
    """The row of each group with the highest (or smallest) metric, the smallest tie first; null metrics last."""
    m = F.col(metric).asc_nulls_last() if smallest else F.col(metric).desc_nulls_last()
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(m, tie))).where("_r = 1").drop("_r")


def rank_hits(df: DataFrame, metric: str = "as_score", group: str = "query_id", tie: str = "hit_id") -> DataFrame:
    """Adds ``rank`` from 0 by ascending metric: the best hit of a query has the highest rank. Null metrics first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(metric).asc_nulls_first(), tie)) - 1)


def flag_chimeras(df: DataFrame, group: str = "query_id") -> DataFrame:
    """Adds ``chimeric``: the query has more than one of the (non-overlapping) hits given."""
    return df.withColumn("chimeric", F.count(F.lit(1)).over(Window.partitionBy(group)) > 1)


def annotate_reads(df: DataFrame, tie: str = "hit_id") -> DataFrame:
    """One row per query: hits, changes of strand between neighbours, unmapped letters, coverage of the targets, means
    and population deviation of the scores."""
    order = Window.partitionBy("query_id").orderBy("q_start", tie)
    turned = df.withColumn("_turn", F.when(F.lag("orientation").over(order) != F.col("orientation"), 1).otherwise(0))
    span = F.sum(F.col("q_end") - F.col("q_start"))
    return turned.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_frags"),
        F.sum("_turn").alias("n_inversions"),
        F.max("q_len").alias("q_len"),
        (F.max("q_len") - span).alias("q_unmapped"),
        F.sum("t_start").alias("db_fwd_cover"),
        F.sum(F.col("t_len") - F.col("t_end")).alias("db_rev_cover"),
        F.sum(F.col("t_end") - F.col("t_start")).alias("match_size"),
        F.avg("match_score").alias("avg_match"),
        F.avg("as_score").alias("avg_as"),
        F.stddev_pop("as_score").alias("std_as"),
    )


def primer_pairs(df: DataFrame, group: str = "query_id", tie: str = "hit_id") -> DataFrame:
    """The best primer pair or single primer of each read.

    ``df`` has one row per primer hit with ``pdir`` (fwd, rev), ``orientation``, ``database_id``, ``q_start``, ``q_end``,
    ``n_match``, ``tot``, ``as_score``, ``cigar``. In order of start, a forward hit on ``+`` right before a reverse hit
    on ``-`` is a pair, and so is reverse ``+`` before forward ``-``; any other hit is a single. The highest sum of
    scores wins, the earliest on ties. The missing side is null.
    """
    order = Window.partitionBy(group).orderBy("q_start", tie)
    cols = ["pdir", "database_id", "orientation", "q_start", "q_end", "n_match", "tot", "as_score", "cigar"]
    one = F.struct(*cols)
    rows = df.select(group, F.col(tie), *cols, one.alias("_x"), F.lead(one).over(order).alias("_y"), F.lag("pdir").over(order).alias("_pd"), F.lag("orientation").over(order).alias("_po"))
    opens = (F.col("orientation") == "+") & (F.col("_y.orientation") == "-") & (F.col("_y.pdir") != F.col("pdir"))
    closes = (F.col("orientation") == "-") & (F.col("_po") == "+") & (F.col("_pd") != F.col("pdir"))
    rows = rows.withColumn("_pair", F.coalesce(opens, F.lit(False))).where(~F.coalesce(closes, F.lit(False)))
    rows = rows.withColumn("_score", F.coalesce("as_score", F.lit(0)) + F.when(F.col("_pair"), F.coalesce("_y.as_score", F.lit(0))).otherwise(0))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_score"), "q_start", tie))).where("_r = 1")
    first_fwd = F.col("pdir") == "fwd"
    other = F.when(F.col("_pair"), F.col("_y"))
    fwd, rev = F.when(first_fwd, F.col("_x")).otherwise(other), F.when(first_fwd, other).otherwise(F.col("_x"))
    names = {"database_id": "primer"}
    side = lambda s, p: [s[c].alias(f"{p}_{names.get(c, c)}") for c in cols if c != "pdir"]
    return best.select(F.col(group).alias("id"), *side(fwd, "fwd"), *side(rev, "rev"))


def primer_slice_bounds(pairs: DataFrame) -> DataFrame:
    """``start, stop`` of the part between and with both primers; needs both sides."""
    plus = F.col("fwd_orientation") == "+"
    both = pairs.where(F.col("fwd_primer").isNotNull() & F.col("rev_primer").isNotNull())
    return both.withColumn("start", F.when(plus, F.col("fwd_q_start")).otherwise(F.col("rev_q_start"))).withColumn("stop", F.when(plus, F.col("rev_q_end")).otherwise(F.col("fwd_q_end"))).withColumn("orientation", F.col("fwd_orientation"))


def hit_weights(df: DataFrame, metric: str = "s1", group: str = "query_id") -> DataFrame:
    """Adds ``weight``: metric / (metric + best metric of the query); 0.5 for the best hit."""
    return df.withColumn("weight", F.col(metric) / (F.col(metric) + F.max(metric).over(Window.partitionBy(group))))


def relative_to_target(df: DataFrame, metric: str = "s1", group: str = "database_id") -> DataFrame:
    """Adds ``relative``: the metric as a share of the best of its target."""
    return df.withColumn("relative", F.col(metric) / F.max(metric).over(Window.partitionBy(group)))


def first_members(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
