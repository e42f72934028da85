"""Problem 2: one group id for everything that is linked directly or through others.

Method: union-find inside each edge partition keeps a spanning forest only; the forests are merged level by level in
partitions of bounded size until the global components remain. Between two levels the trees are contracted to their
roots, so only vertices that several partitions hold (the places where trees can still meet) travel on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.session import materialize


def strong_links(hits: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Links ``a, b`` of hits whose similarity is at least ``threshold``.

    A similarity above 1 is a percentage; a null (or NaN) one is replaced by ``1 - nm / min(q_len, t_len)``. Hits of an
    id on itself, with a null id, or with neither similarity nor a usable ``nm`` and length, link nothing. Extra columns
    are ignored.
    """
    sim = F.when(F.isnan("similarity"), None).otherwise(F.col("similarity"))
    sim = F.when(sim > 1, sim / 100).otherwise(sim)
    short = F.least("q_len", "t_len")
    sim = F.coalesce(sim, F.when(F.col("q_len").isNotNull() & F.col("t_len").isNotNull() & (short > 0), 1 - F.col("nm") / short))
    return hits.where((F.col("query_id") != F.col("database_id")) & (sim >= threshold)).select(F.col("query_id").alias("a"), F.col("database_id").alias("b"))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition; out comes each vertex with the smallest vertex of its tree."""
    number: dict[str, int] = {}
    names: list[str] = []
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        n = len(pdf)
        codes, labels = pd.factorize(pd.concat([pdf["a"], pdf["b"]], ignore_index=True))
        at = np.empty(len(labels), np.int64)
        for i, name in enumerate(labels):
            x = number.get(name)
            if x is None:
                x = number[name] = len(names)
                names.append(name)
                parent.append(x)
            at[i] = x
        for x, y in zip(at[codes[:n]].tolist(), at[codes[n:]].tolist()):
            x, y = find(x), find(y)
            if x != y:
                if names[y] < names[x]:
                    x, y = y, x
                parent[y] = x
    for lo in range(0, len(names), 20_000):
        hi = min(len(names), lo + 20_000)
        yield pd.DataFrame({"node": names[lo:hi], "root": [names[find(x)] for x in range(lo, hi)]})


def connected_components(edges: DataFrame, partition_rows: int = 100_000, max_levels: int = 60) -> DataFrame:
    """``node, root`` of every vertex of ``edges (a, b)``; ``root`` is the smallest vertex linked to it.

    Edges with a null end are dropped, loops keep their vertex as a group of one, repeated edges and both directions
    are one link, an empty table gives an empty table. Strings compare by code points. Ids must be strings.

    ``partition_rows`` bounds the edges that one task of a later level merges. The first level takes the partitions
    as they are read. Where a level hardly shrinks the links (long chains over many partitions), every vertex is also
    moved to a neighbour, so the number of levels grows with the logarithm of the data. A vertex occurs at most once per partition of a level, so no group of its trees grows with the
    data, however large one component is.
    """
    level = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").cast("string"), F.col("b").cast("string"))
    below: list[DataFrame] = []
    parts, before, hooked = None, None, False
    for _ in range(max_levels):
        trees = level.mapInPandas(_forest, "node string, root string")
        if parts == 1:
            top = trees
            break
        # per vertex its smallest root, and all its roots where trees meet
        met = materialize(trees.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "trees")
        below.append(met.select("node", "root"))
        level = met.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        level = materialize(level, "links")
        left = level.count()
        if before is not None and left > 0.6 * before and left > partition_rows:
            # trees that hardly share a partition: every vertex moves to its first neighbour by hash
            move, level = _hook(level)
            below.append(move)
            left, hooked = level.count(), True
        before = left
        parts = max(1, -(-left // partition_rows))
        level = level.coalesce(1) if parts == 1 else level.repartition(parts, "b")
    else:
        raise RuntimeError("components did not settle")
    # downwards again: each level's roots are vertices of the next
    for lower in reversed(below):
        up = top.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        top = lower.join(up, lower["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
    if hooked:  # roots are then any vertex of a component
        top = materialize(top, "roots")
        least = top.groupBy("root").agg(F.min("node").alias("least"))
        top = top.join(least, "root").select("node", F.col("least").alias("root"))
    return top


def _hook(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move every vertex to the first of itself and its neighbours by hash; the links of where they moved to.

    On a chain, the slowest case, about half the vertices are left. A hub is only ever aggregated and joined to, not
    gathered.
    """
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
    own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
    move = materialize(first.select(F.col("a").alias("node"), F.least("m", own)["v"].alias("root")), "moves")
    at, bt = move.select(F.col("node").alias("a"), F.col("root").alias("x")), move.select(F.col("node").alias("b"), F.col("root").alias("y"))
    return move, materialize(links.join(at, "a").join(bt, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")


def match_groups(hits: DataFrame, threshold: float = 0.92, partition_rows: int = 100_000) -> DataFrame:
    """``record_id, group_id`` of every id with at least one strong link (see ``strong_links``)."""
    found = connected_components(strong_links(hits, threshold), partition_rows)
    return found.select(F.col("node").alias("record_id"), F.col("root").alias("group_id"))
