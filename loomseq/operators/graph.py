"""Groups of linked keys, for single linkage at a threshold and density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.session import materialize


def linked_groups(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``, ``root`` the smallest node of its group.

    Each round moves every node to the smallest of its neighbourhood by hash and keeps the links between different
    places, so the links shrink by about half or more; aggregations and joins only, no group is gathered.
    """
    links = materialize(edges.where("a is not null and b is not null").select("a", "b").distinct(), "edges")
    moves: list[DataFrame] = []
    for _ in range(max_rounds):
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        move = materialize(ends.groupBy("a").agg(F.min(F.least(rank("a"), rank("b")))["v"].alias("root")).withColumnRenamed("a", "node"), "moves")
        moves.append(move)
        x, y = move.select(F.col("node").alias("a"), F.col("root").alias("x")), move.select(F.col("node").alias("b"), F.col("root").alias("y"))
        links = materialize(links.join(x, "a").join(y, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if not links.take(1):
            break
    else:
        raise RuntimeError("groups did not settle")
    out = moves[-1]
    for move in reversed(moves[:-1]):
        up = out.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        out = move.join(up, move["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
    out = materialize(out, "groups")
    least = out.groupBy("root").agg(F.min("node").alias("least"))
    return out.join(least, "root").select("node", F.col("least").alias("root"))


def single_linkage(distances: DataFrame, thresh: float) -> DataFrame:
    """``id, cluster_id, size``: single-linkage clusters of the pairs ``row_id, col_id, value`` cut at ``thresh``; ids
    linked to nothing else are clusters of one, marked -1 by ``size = 1``."""
    ids = distances.select(F.explode(F.array("row_id", "col_id")).alias("id")).where("id is not null").distinct()
    near = distances.where((F.col("value") <= thresh) & (F.col("row_id") != F.col("col_id"))).select(F.col("row_id").alias("a"), F.col("col_id").alias("b"))
    g = linked_groups(near)
    out = ids.join(g, ids["id"] == g["node"], "left").select("id", F.coalesce("root", "id").alias("cluster_id"))
    size = out.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return out.join(size, "cluster_id").select("id", "cluster_id", "size")


def density_clusters(distances: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``id, cluster_id, core``: density clusters of a symmetric pair table at radius ``eps``.

    An id with at least ``min_samples`` ids within ``eps`` (itself included) is a core; cores within ``eps`` of each
    other share a cluster (its smallest core); another id joins its closest core, the smallest on ties, or is noise
    (null cluster). This is the clustering that a density ordering gives when it is cut at ``eps``.
    """
    ids = distances.select(F.explode(F.array("row_id", "col_id")).alias("id")).distinct()
    near = distances.where((F.col("value") <= eps) & (F.col("row_id") != F.col("col_id"))).groupBy("row_id", "col_id").agg(F.min("value").alias("value"))
    cores = materialize(near.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("row_id").alias("id")), "cores")
    from_core = near.join(cores.withColumnRenamed("id", "row_id"), "row_id", "left_semi")
    inner = from_core.join(cores.withColumnRenamed("id", "col_id"), "col_id", "left_semi")
    g = linked_groups(inner.select(F.col("row_id").alias("a"), F.col("col_id").alias("b")))
    of_core = cores.join(g, cores["id"] == g["node"], "left").select("id", F.coalesce("root", "id").alias("cluster_id"))
    border = from_core.join(cores.withColumnRenamed("id", "col_id"), "col_id", "left_anti").join(of_core.withColumnRenamed("id", "row_id"), "row_id")
    of_border = border.groupBy(F.col("col_id").alias("id")).agg(F.min(F.struct("value", "row_id", "cluster_id"))["cluster_id"].alias("cluster_id"))
    known = of_core.select("id", "cluster_id", F.lit(True).alias("core")).unionByName(of_border.select("id", "cluster_id", F.lit(False).alias("core")))
    return ids.join(known, "id", "left").select("id", "cluster_id", F.coalesce("core", F.lit(False)).alias("core"))
