"""Problem 1: records that are equal but for small edits, moved pieces or strand.

Method: circulant MinHash. One permutation spreads the k-mers, a second one, circularly shifted by 1, 2, 3, ..., gives
every signature coordinate. Signatures are cut into bands; records that share enough bands are compared by the exact
Jaccard similarity of their k-mer sets, and the survivors by a count of edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm._dna import block_similarities, clean_sequence, kmer_set, strand_free
from loomseq.llm.components import connected_components
from loomseq.session import materialize, spread


@dataclass(frozen=True)
class NearDupConf:
    """k: letters of a shingle; the permutations are of its 4 ** k codes. bands x rows: signature coordinates. agree: bands
    that two records share at least.

    A pair of Jaccard J shares a band with probability J ** rows. With edits spread evenly the Jaccard at the limit 0.90 is
    0.115 on average and spreads from 0.03 on; over that spread a pair at 0.90 is found with probability 0.9991 (640
    letters), 0.9985 (500) and 0.993 (300), at 0.92 with 0.9995 or more from 300 letters on. Edits in clusters leave more
    shingles whole. One long shingle a band keeps the bands few and chance meetings rare; that several of them agree
    takes the place of rows. test_pairs_at_the_limit has the sum.
    jaccard: least similarity of the sets of ``jaccard_k`` letters, compared exactly before the edits are counted. With
    edits spread evenly at random a pair at 0.90 of 500 letters reaches it with probability 0.9995, hardly any at 0.80 does.
    similarity: least 1 - edits / letters.
    block: rows of one bucket that a task compares with as many others.
    """

    k: int = 15
    bands: int = 176
    rows: int = 1
    agree: int = 3
    jaccard_k: int = 8
    jaccard: float = 0.20
    similarity: float = 0.90
    block: int = 256
    seed: int = 7


def _permute(codes: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """A permutation of the numbers below 2 ** bits: odd multipliers and shifts, each of which can be undone."""
    kind = np.uint32 if bits <= 32 else np.uint64
    mask = kind((1 << bits) - 1)
    x = codes.astype(kind)
    for factor in np.random.default_rng(seed).integers(1 << 20, 1 << 30, 2, np.uint32):
        x *= kind(factor | 1)
        x &= mask
        x ^= x >> kind(bits // 2)
    return x


def circulant_signature(codes: np.ndarray, conf: NearDupConf) -> np.ndarray:
    """Signature coordinate s is the least second-permutation value over the set, read s places further round."""
    bits = 2 * conf.k
    first = _permute(codes, bits, conf.seed)
    at = (first[None, :] + np.arange(1, conf.bands * conf.rows + 1, dtype=first.dtype)[:, None]) & first.dtype.type((1 << bits) - 1)
    return _permute(at, bits, conf.seed + 1).min(axis=1).astype(np.int64)


def _band_keys(conf: NearDupConf):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mix = np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            out = []
            for seq in pdf["seq"]:
                codes = kmer_set(seq, conf.k)
                if not len(codes):  # too short for a shingle, or without letters: only exact copies are found
                    out.append(np.empty(0, np.int64))
                    continue
                sig = circulant_signature(codes, conf).reshape(conf.bands, conf.rows).astype(np.uint64)
                key = np.arange(conf.bands, dtype=np.uint64)
                for r in range(conf.rows):
                    key = (key ^ sig[:, r]) * mix
                    key ^= key >> np.uint64(29)
                out.append(key.astype(np.int64))
            yield pd.DataFrame({"rep": pdf["rep"], "keys": out})

    return keys


def distinct_texts(df: DataFrame, id_col: str = "id", seq_col: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """Members ``id, rep`` and texts ``rep, seq``, one for each different strand-free text; blank and null ones leave.

    ``rep`` numbers the texts as they are written. Members find their text by two 64-bit hashes, which of 1e12 texts no
    two share but by a chance of 1e-15.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), strand_free(clean_sequence(F.col(seq_col))).alias("seq")).where("id is not null and seq is not null")
    rows = rows.select("id", "seq", F.xxhash64("seq").alias("h1"), F.xxhash64(F.lit("2"), F.col("seq")).alias("h2"))
    texts = materialize(rows.groupBy("h1", "h2").agg(F.min("seq").alias("seq")).withColumn("rep", F.monotonically_increasing_id()), "texts")
    members = rows.select("id", "h1", "h2").distinct().join(texts.select("rep", "h1", "h2"), ["h1", "h2"])
    return materialize(members.select("id", "rep"), "members"), texts.select("rep", "seq")


def _bucket_pairs(keyed: DataFrame, conf: NearDupConf) -> DataFrame:
    """Pairs of different texts that share ``agree`` buckets. The rows of one bucket are gathered in blocks of about
    ``block`` rows; blocks meet each other in different tasks, so that no task holds a whole hot bucket."""
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / conf.block).cast("int")
    rows = keyed.join(size, "key").select("key", parts.alias("parts"), F.pmod(F.xxhash64("rep", F.lit(1)), parts).cast("int").alias("part"), "rep")
    blocks = rows.groupBy("key", "parts", "part").agg(F.collect_list("rep").alias("reps"))
    inside = blocks.where("size(reps) > 1").select(F.explode("reps").alias("l"), "reps").select("l", F.explode("reps").alias("r")).where("l < r")
    crowd = materialize(blocks.where("parts > 1"), "crowd")
    left = crowd.where("part < parts - 1").select("key", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("y"), "part", F.col("reps").alias("ls"))
    met = left.join(crowd.select("key", F.col("part").alias("y"), F.col("reps").alias("rs")), ["key", "y"])
    across = met.select(F.explode("ls").alias("l"), "rs").select("l", F.explode("rs").alias("r")).select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"))
    both = inside.unionByName(across).groupBy(F.col("l").alias("rep_a"), F.col("r").alias("rep_b")).agg(F.count("*").alias("agree"))
    return both.where(F.col("agree") >= conf.agree).select("rep_a", "rep_b")


def _verify(conf: NearDupConf):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(4**conf.jaccard_k, bool)
        for pdf in batches:
            a, b = pdf["seq_a"].tolist(), pdf["seq_b"].tolist()
            jac, sim = np.zeros(len(pdf)), np.zeros(len(pdf))
            sets: dict[str, np.ndarray] = {}
            for n, pair in enumerate(zip(a, b)):
                for s in pair:
                    if s not in sets:
                        sets[s] = kmer_set(s, conf.jaccard_k)
                x, y = sets[pair[0]], sets[pair[1]]
                held[x] = True
                both = int(held[y].sum())
                held[x] = False
                jac[n] = both / max(1, len(x) + len(y) - both)
            near = np.flatnonzero(jac >= conf.jaccard)
            sim[near] = block_similarities([a[n] for n in near], [b[n] for n in near], conf.similarity)
            keep = sim >= conf.similarity
            yield pd.DataFrame({"rep_a": pdf["rep_a"][keep], "rep_b": pdf["rep_b"][keep], "jaccard": jac[keep], "similarity": sim[keep]})

    return verify


def similar_texts(texts: DataFrame, conf: NearDupConf = NearDupConf()) -> DataFrame:
    """``rep_a, rep_b, jaccard, similarity`` of every pair of different ``texts (rep, seq)`` over the thresholds."""
    keyed = materialize(spread(texts, texts.count(), 500).mapInPandas(_band_keys(conf), "rep long, keys array<long>").select("rep", F.explode("keys").alias("key")), "bands")
    pairs = materialize(_bucket_pairs(keyed, conf), "candidates")
    a = texts.select(F.col("rep").alias("rep_a"), F.col("seq").alias("seq_a"))
    b = texts.select(F.col("rep").alias("rep_b"), F.col("seq").alias("seq_b"))
    both = pairs.join(a, "rep_a").join(b, "rep_b")
    return spread(both, pairs.count(), 2000).mapInPandas(_verify(conf), "rep_a long, rep_b long, jaccard double, similarity double")


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", seq_col: str = "sequence", conf: NearDupConf = NearDupConf()) -> DataFrame:
    """``id_a < id_b`` of every pair of different ids whose texts are near duplicates, exact copies included.

    Letter case, gaps and white space do not count, either strand may be taken. Rows with a null id or without letters
    are no case; repeated rows count once; an id with several texts has the links of all of them; texts shorter than a
    shingle only match exact copies; an empty table gives an empty table; other columns are ignored.
    """
    members, texts = distinct_texts(df, id_col, seq_col)
    near = materialize(similar_texts(texts, conf).select("rep_a", "rep_b"), "near")
    a, b = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    far = near.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    same = a.join(b, a["rep_a"] == b["rep_b"]).where("x < y").select("x", "y")
    return far.unionByName(same).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "id", seq_col: str = "sequence", conf: NearDupConf = NearDupConf()) -> DataFrame:
    """One row per id and text: ``id, class_id`` (smallest id with the same text), ``group_id`` (smallest id linked to
    it directly or through others), ``n_links`` (other texts it is a near duplicate of). Copies are not paired."""
    members, texts = distinct_texts(df, id_col, seq_col)
    named = materialize(members.groupBy("rep").agg(F.min("id").alias("class_id")), "classes")
    near = materialize(similar_texts(texts, conf), "near")
    a, b = named.select(F.col("rep").alias("rep_a"), F.col("class_id").alias("a")), named.select(F.col("rep").alias("rep_b"), F.col("class_id").alias("b"))
    edges = near.join(a, "rep_a").join(b, "rep_b").select("a", "b")
    groups = connected_components(edges).withColumnRenamed("root", "group_id")
    links = near.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = named.join(groups, named["class_id"] == groups["node"], "left").join(links, "rep", "left")
    out = members.join(classes, "rep")
    return out.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
