"""Clustering of vectors and of small distance matrices, and the iterative clustering of sequences into centres."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions import dna
from loomseq.operators import hits as H
from loomseq.operators import matrix, stats
from loomseq.operators.align import CLUSTERING, AlignConf, _clean, align, strand_free_conf
from loomseq.operators.consensus import consensus_per_group
from loomseq.session import materialize


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 0, max_iter: int = 50) -> DataFrame:
    """Adds ``cluster_id`` and ``inertia`` (distance to the centre) for an array column; null vectors leave."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="cluster_id").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])  # k centres
    out = model.transform(rows).drop("_v")
    gap = F.zip_with(F.col(vector), centres[F.col("cluster_id")], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return out.withColumn("inertia", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)))


def kmeans_bins(df: DataFrame, value: str, k: int, seed: int = 0) -> DataFrame:
    """Adds ``bin`` from 0: 1-D clusters numbered by their means."""
    from pyspark.sql.types import IntegerType

    rows = kmeans(df.where(F.col(value).isNotNull()).withColumn("_x", F.array(F.col(value).cast("double"))), "_x", k, seed)
    means = [r[0] for r in rows.groupBy("cluster_id").agg(F.avg(value).alias("m")).orderBy("m").collect()]  # k rows
    rank = F.create_map(*[F.lit(int(x)) for pair in ((c, i) for i, c in enumerate(means)) for x in pair])
    return rows.withColumn("bin", rank[F.col("cluster_id")].cast(IntegerType())).drop("_x", "cluster_id", "inertia")


def pca(df: DataFrame, vector: str, n: int = 2) -> DataFrame:
    """Adds ``components``: the first principal components of a centred array column (sign: largest loading positive)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    scaled = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=n, inputCol="_c", outputCol="_p").fit(scaled)
    pc = model.pc.toArray()
    sign = [1.0 if pc[np.abs(pc[:, i]).argmax(), i] >= 0 else -1.0 for i in range(n)]
    out = model.transform(scaled).withColumn("_p", vector_to_array("_p"))
    return out.withColumn("components", F.array(*[F.col("_p")[i] * F.lit(s) for i, s in enumerate(sign)])).drop("_v", "_c", "_p")


def reachability(d: np.ndarray, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """The density ordering of a distance matrix: order of visit and reachability distances (the first of a part: inf)."""
    n = len(d)
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        left = np.where(done, np.inf, reach)
        i = int(np.argmin(left)) if np.isfinite(left).any() else int(np.flatnonzero(~done)[0])
        done[i] = True
        order.append(i)
        new = np.maximum(core[i], d[i])
        reach = np.where(~done & (new < reach), new, reach)
    return np.array(order), reach


def density_labels(d: np.ndarray, min_samples: int | None = None, max_eps: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels (-1 noise), place in the ordering, and reachability, cut at ``max_eps`` (half way between the largest and
    smallest value by default). Fewer than three rows are clusters of one.

    Without ``min_samples`` it is searched by halving: the setting with most clusters, then with fewest outliers.
    """
    n = len(d)
    if n < 3:
        return np.arange(n), np.arange(n), np.full(n, -1.0)
    eps = (np.abs(d).max() + np.abs(d).min()) / 2 if max_eps is None else max_eps

    def cut(m: int):
        order, reach = reachability(d, m)
        core = np.sort(d, axis=1)[:, min(m, n) - 1]
        labels, c = np.full(n, -1), -1
        for i in order:
            if reach[i] > eps:
                if core[i] <= eps:
                    c += 1
                    labels[i] = c
            elif c >= 0:
                labels[i] = c
        return labels, order, reach

    if min_samples is not None and min_samples <= n:
        labels, order, reach = cut(max(1, min_samples))
    else:
        best, m = None, -(-n // 2)
        while m >= 2:
            labels, order, reach = cut(m)
            rank = (int(labels.max() + 1), -int((labels < 0).sum()))
            if best is None or rank > best[0]:
                best = (rank, labels, order, reach)
            if m == 2 or rank[1] == 0:
                break
            m = max(2, m // 2)
        _, labels, order, reach = best
    top = reach[np.isfinite(reach)].max() if np.isfinite(reach).any() else -1.0
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return labels, place, np.where(np.isfinite(reach), reach, top)


def density_order(long: DataFrame, group: str, min_samples: int | None = None, max_eps: float | None = None, most: int = 2000) -> DataFrame:
    """``<group>, id, cluster_id, ordering, reachability``: the density ordering inside each group of a pair table.

    The ordering needs its whole matrix, so of a group of more than ``most`` ids that many are drawn by hash and ordered;
    every other id gets the cluster of the drawn id it is closest to (the smallest on ties; noise where it has none), its
    distance to it as reachability, and no place in the ordering. ``graph.density_clusters`` is the clustering of whole
    groups. Pairs that are not listed are at distance 1.
    """
    long = materialize(long.select(group, "row_id", "col_id", F.col("value").cast("double").alias("value")), "pairs")
    ids = long.select(group, F.explode(F.array("row_id", "col_id")).alias("id")).distinct()
    ranked = materialize(ids.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64("id"), "id"))), "ranked")
    few = ranked.where(F.col("_k") <= most)
    a = few.select(group, F.col("id").alias("row_id"), (F.col("_k") - 1).alias("_i"))
    b = few.select(group, F.col("id").alias("col_id"), (F.col("_k") - 1).alias("_j"))
    cells = long.join(a, [group, "row_id"]).join(b, [group, "col_id"]).select(group, "row_id", "col_id", "_i", "_j", "value")
    kind = dict(long.dtypes)[group]

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pd.concat([pdf[["_i", "row_id"]].set_axis(["k", "id"], axis=1), pdf[["_j", "col_id"]].set_axis(["k", "id"], axis=1)]).drop_duplicates("k").sort_values("k")
        names = names.sort_values("id")
        at = {k: n for n, k in enumerate(names["k"])}
        d = np.ones((len(names), len(names)))
        i, j = pdf["_i"].map(at).to_numpy(), pdf["_j"].map(at).to_numpy()
        np.minimum.at(d, (i, j), pdf["value"].to_numpy())
        d = np.minimum(d, d.T)
        np.fill_diagonal(d, 0.0)
        labels, place, reach = density_labels(d, min_samples, max_eps)
        return pd.DataFrame({group: pdf[group].iloc[0], "id": names["id"].to_numpy(), "cluster_id": labels, "ordering": place, "reachability": reach})

    done = cells.groupBy(group).applyInPandas(order, f"{group} {kind}, id string, cluster_id int, ordering int, reachability double")
    if not ranked.where(F.col("_k") > most).take(1):
        return done
    done = materialize(done, "ordered")
    # drawn ids without a drawn neighbour are not in the matrix; they stay noise like the rest that has none
    rest = ranked.select(group, "id").join(done.select(group, "id"), [group, "id"], "left_anti")
    ways = long.unionByName(long.select(group, F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value"))
    near = ways.join(done.select(group, F.col("id").alias("col_id"), "cluster_id"), [group, "col_id"]).groupBy(group, F.col("row_id").alias("id")).agg(F.min(F.struct("value", "col_id", "cluster_id")).alias("m"))
    rest = rest.join(near, [group, "id"], "left").select(group, "id", F.coalesce("m.cluster_id", F.lit(-1)).alias("cluster_id"), F.lit(None).cast("int").alias("ordering"), F.coalesce("m.value", F.lit(1.0)).alias("reachability"))
    return done.unionByName(rest)


@dataclass(frozen=True)
class ClusterConf:
    """csize: members of a cluster that make its centre. sample: uncovered sequences that a sweep clusters, and the
    most members of a centre that a split looks at. seeds: start centres. th_s: bins of relative scores, of which the lowest is uncovered.
    th_m: cosine distance below which centres are merged."""

    csize: int = 20
    sample: int = 2000
    seeds: int = 5
    th_s: int = 2
    th_m: float = 0.9
    max_iter: int = 1
    align: AlignConf = field(default_factory=lambda: strand_free_conf(CLUSTERING))


def pairwise_distance(seqs: DataFrame, group: str, conf: ClusterConf, clean: bool = False) -> DataFrame:
    """``<group>, row_id, col_id, value``: distances of the sequences inside each group, by alignment of ids ``group/id``
    so that one seed join serves all groups; only seeds of one group meet. ``clean`` as in ``align``."""
    named = seqs.select(F.concat_ws("\x1f", F.col(group).cast("string"), "id").alias("id"), "sequence")
    part = lambda c, i: F.split(c, "\x1f")[i]
    best = H.best_hits(align(named, named, conf.align, lambda c: part(c, 0), True, clean), ["query_id", "database_id"])
    long = matrix.to_distance(matrix.symmetric(matrix.feature_long(best, "similarity")))
    return long.select(part("row_id", 0).alias(group), part("row_id", 1).alias("row_id"), part("col_id", 1).alias("col_id"), "value")


def cluster_groups(seqs: DataFrame, group: str, conf: ClusterConf, min_samples: int | None = None, max_eps: float | None = None) -> DataFrame:
    """``<group>, cluster_id, id, sequence, n_frags``: the clusters inside each group of sequences and their centres, the
    consensus of the first ``csize`` members in density order. All groups are one job."""
    rows = seqs.select(F.col(group).cast("string").alias(group), F.col("id").cast("string").alias("id"), dna.degap(F.col("sequence")).alias("sequence"))
    seqs = materialize(rows.where("id is not null and sequence <> ''").groupBy(group, "id").agg(F.min("sequence").alias("sequence")), "groups")
    dist = pairwise_distance(seqs, group, conf, True)
    order = density_order(dist, group, min_samples, max_eps, conf.sample).where("cluster_id >= 0")
    order = order.withColumn("_c", F.concat_ws("\x1f", group, "cluster_id"))
    first = H.first_members(order, "_c", [F.col("ordering"), F.col("id")], conf.csize)
    members = first.join(seqs, [group, "id"]).select("_c", "sequence")
    made = consensus_per_group(members, "_c", "sequence", None)
    return made.select(F.split("_c", "\x1f")[0].alias(group), F.split("_c", "\x1f")[1].cast("int").alias("cluster_id"), "sequence", "n_frags")


def cover_sample(seqs: DataFrame, n: int, conf: ClusterConf, th: float = 0.9, seed: int = 0, rounds: int = 20) -> DataFrame:
    """Start centres ``id, sequence``: drawn by hash from what no centre covers yet (no hit of match score over ``th``),
    until there are ``n`` or nothing is left.

    A round draws twice as many as the one before; of those drawn that cover each other the first stays. So the rare
    sequences that the first draws miss are drawn later, in a few rounds of joins.
    """
    free = materialize(_clean(seqs).select("id", "sequence", F.xxhash64("id", F.lit(seed)).alias("_r")), "free")
    made: list[DataFrame] = []
    have, draw = 0, max(1, n // 8)
    for _ in range(rounds):
        new = drawn = materialize(free.orderBy("_r", "id").limit(min(draw, n - have)), "drawn")
        many = drawn.count()
        if not many:
            break
        if many > 1:
            own = drawn.select("id", "sequence")
            found = align(own, own, conf.align, clean=True).where(F.col("match_score") > th)
            rank = drawn.select("id", "_r")
            later = found.join(rank.select(F.col("id").alias("query_id"), F.col("_r").alias("_q")), "query_id").join(rank.select(F.col("id").alias("database_id"), F.col("_r").alias("_d")), "database_id").where("_d < _q")
            new = materialize(drawn.join(later.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti"), "new")
        made.append(new)
        have, draw = have + new.count(), 2 * draw
        if have >= n:
            break
        covered = align(free.select("id", "sequence"), new.select("id", "sequence"), conf.align, clean=True).where(F.col("match_score") > th).select(F.col("query_id").alias("id"))
        free = materialize(free.join(covered.unionByName(new.select("id")).distinct(), "id", "left_anti"), "free")
    out = made[0] if made else free
    for more in made[1:]:
        out = out.unionByName(more)
    return out.select("id", "sequence")


def _number(rows: DataFrame) -> DataFrame:
    """Centres named by a hash of their sequence, each sequence once."""
    return rows.groupBy("sequence").agg(F.max("split").alias("split")).select(F.concat(F.lit("cluster"), F.lower(F.hex(F.xxhash64("sequence")))).alias("id"), "sequence", "split")


def cluster_eval(seqs: DataFrame, centres: DataFrame, conf: ClusterConf = ClusterConf()) -> tuple[DataFrame, DataFrame]:
    """The best hit of each sequence on each centre, on the forward strand, and the centres that got any."""
    found = materialize(_hits(seqs, centres, conf, False), "hits")
    return found, centres.join(found.select(F.col("database_id").alias("id")).distinct(), "id", "left_semi")


def perform_cluster(seqs: DataFrame, centres: DataFrame | None = None, conf: ClusterConf = ClusterConf()) -> DataFrame:
    """Cluster centres ``id, sequence, split`` of ``seqs (id, sequence)``: draw or take start centres, then per round
    split centres with several clusters among their hits, sweep what no centre covers, and merge like centres; at the end
    those still marked are split, and all merged, once more.

    Every round is a fixed number of jobs whatever the number of centres; what is clustered inside one centre, or swept,
    is a sample by hash of at most ``sample`` sequences, as the method asks for.
    """
    seqs = materialize(_clean(seqs), "seqs")
    now = materialize((cover_sample(seqs, conf.seeds, conf, 0.8) if centres is None else _clean(centres)).withColumn("split", F.lit(True)), "centres")
    for turn in range(conf.max_iter):
        now = materialize(_number(_merge(seqs, _sweep(seqs, _split(seqs, now, conf, turn), conf, turn), conf)), "centres")
    last = _split(seqs, now, conf, conf.max_iter)
    now = materialize(_number(_merge(seqs, last, conf)), "centres")
    return cluster_eval(seqs, now, conf)[1]


def _hits(seqs: DataFrame, centres: DataFrame, conf: ClusterConf, clean: bool = True) -> DataFrame:
    return H.best_hits(align(seqs, centres.select("id", "sequence"), conf.align, best=True, clean=clean), ["query_id", "database_id"])


def _split(seqs: DataFrame, now: DataFrame, conf: ClusterConf, turn: int) -> DataFrame:
    found = H.hit_weights(_hits(seqs, now.where("split"), conf))
    picked = stats.sample_by_weight(found, "database_id", F.col("weight"), F.abs(F.xxhash64("query_id")), "as_score", conf.csize * 10, "semi", turn)
    groups = picked.select(F.col("database_id").alias("centre"), F.col("query_id").alias("id")).join(seqs, "id")
    made = materialize(cluster_groups(groups, "centre", conf), "children")
    n = made.groupBy("centre").agg(F.count(F.lit(1)).alias("_n"))
    children = made.join(n, "centre").select("sequence", (F.col("_n") > 1).alias("split"))
    kept = now.join(n.select(F.col("centre").alias("id")), "id", "left_anti").select("sequence", F.lit(False).alias("split"))
    return materialize(_number(children.unionByName(kept)), "split")


def _sweep(seqs: DataFrame, now: DataFrame, conf: ClusterConf, turn: int) -> DataFrame:
    found = H.best_hits(H.relative_to_target(_hits(seqs, now, conf)), ["query_id"], "relative")
    found = materialize(found.select("query_id", "relative"), "relative")
    low = None
    if found.select("relative").distinct().limit(conf.th_s).count() >= conf.th_s:
        low = kmeans_bins(found, "relative", conf.th_s).where("bin = 0").agg(F.max("relative")).first()[0]
    covered = found if low is None else found.where(F.col("relative") > low)
    free = seqs.join(covered.select(F.col("query_id").alias("id")), "id", "left_anti")
    drawn = free.withColumn("_r", F.xxhash64("id", F.lit(turn))).orderBy("_r", "id").limit(conf.sample).select(F.lit("sweep").alias("centre"), "id", "sequence")
    new = cluster_groups(drawn, "centre", conf).select("sequence", F.lit(True).alias("split"))
    return materialize(_number(now.select("sequence", "split").unionByName(new)), "sweep")


def _merge(seqs: DataFrame, now: DataFrame, conf: ClusterConf) -> DataFrame:
    found = materialize(_hits(seqs, now, conf), "hits")
    far = matrix.cosine_columns(matrix.feature_long(found, "as_score")).select(F.lit("all").alias("g"), F.col("col_a").alias("row_id"), F.col("col_b").alias("col_id"), "value")
    from loomseq.operators.graph import density_clusters

    pairs = far.select("row_id", "col_id", "value").unionByName(far.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value"))
    groups = materialize(density_clusters(pairs, conf.th_m * 0.5, 2).where("cluster_id is not null").select(F.col("id").alias("database_id"), F.col("cluster_id").alias("centre")), "merge")
    picked = stats.sample_by_weight(H.hit_weights(found.join(groups, "database_id")), "centre", F.col("weight"), F.abs(F.xxhash64("query_id")), "as_score", conf.csize * 5)
    members = picked.select("centre", F.col("query_id").alias("id")).distinct().join(seqs, "id")
    made = cluster_groups(members, "centre", conf).select("sequence", F.lit(False).alias("split"))
    alone = now.join(groups.select(F.col("database_id").alias("id")), "id", "left_anti").select("sequence", "split")
    return made.unionByName(alone)
