"""Problem 7: items of varying size in containers of fixed capacity, whole unless larger than a container.

Method: pattern packing by non-negative least squares. Sizes are gathered in classes; patterns of few different classes
that fill a container are enumerated; how often each pattern repeats is fitted to the histogram of sizes; the counts are
rounded to what the histogram holds, and what no pattern takes is packed by best fit.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.session import materialize


@dataclass(frozen=True)
class PackConf:
    """tokenizer: file of ranks of a public byte-level tokenizer; pattern: how it splits a text. None: where the
    package of public tokenizers keeps them. group: items of one task's ranking group. block: items left by the patterns
    that one task packs."""

    capacity: int = 2048
    tokenizer: str | None = None
    pattern: str | None = None
    group: int = 100_000
    block: int = 20_000


@lru_cache(maxsize=2)
def _encoder(path: str | None, pattern: str | None):
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _count(text: str, encode: Callable[[str], list[int]], part: int = 200_000) -> int:
    """Tokens of a text. Very long ones are encoded in parts, so that the splitter's stack is bounded; a part ends before a
    single blank between other letters, where the tokenizer's pattern begins a new piece in any case, so the sum is exact."""
    total, at = 0, 0
    while at < len(text):
        gap = _SAFE.search(text, at + part)
        end = gap.start() if gap else len(text)
        total += len(encode(text[at:end]))
        at = end
    return total


def token_sizes(docs: DataFrame, conf: PackConf = PackConf()) -> DataFrame:
    """``doc_id, n_tokens`` of every document with a non-null id; a null text has none."""
    path, pattern = conf.tokenizer, conf.pattern

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path, pattern).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [_count(t, encode) if t else 0 for t in pdf["text"]]})

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(sizes, "doc_id long, n_tokens int")


def size_classes(capacity: int) -> np.ndarray:
    """Upper edges of the size classes: every size up to 16, then steps of 2, 4 and 8 (of more for a large capacity)."""
    wide = max(8, -(-capacity // 256))
    edges = [*range(1, 17), *range(18, 33, 2), *range(36, 65, 4), *range(64 + wide, capacity, wide), capacity]
    return np.array(sorted({e for e in edges if e <= capacity}))


def patterns(edges: np.ndarray, present: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns as classes (n, 3) and how many items of each: one item of a class, as many of a second class as fit
    beside it, and the largest item of a third class that the rest takes."""
    use = np.flatnonzero(present)
    b, a = (x.ravel() for x in np.meshgrid(use, use, indexing="ij"))
    times = (capacity - edges[b]) // edges[a]
    rest = capacity - edges[b] - times * edges[a]
    c = use[np.maximum(0, np.searchsorted(edges[use], rest, "right") - 1)]
    fits = edges[c] <= rest
    cls = np.stack([b, a, c], axis=1)
    n = np.stack([np.ones_like(a), times, fits.astype(int)], axis=1)
    key = np.sort(np.where(n > 0, cls * 4096 + n, 0), axis=1)
    _, first = np.unique(key, axis=0, return_index=True)
    return cls[first], n[first]


def nnls(cls: np.ndarray, n: np.ndarray, target: np.ndarray, most: int | None = None) -> np.ndarray:
    """Non-negative least squares (active set): weights of the patterns whose items come closest to ``target``."""
    weight = np.zeros(len(cls))
    if not len(cls):
        return weight
    scale = max(1.0, float(np.abs(target).max()))
    h = target / scale
    cols: list[np.ndarray] = []
    passive: list[int] = []
    x = np.empty(0)
    for _ in range(most or 3 * len(target)):
        r = h - (np.stack(cols, axis=1) @ x if passive else 0)
        gain = (r[cls] * n).sum(axis=1) / np.sqrt((n * n).sum(axis=1))
        gain[passive] = -1
        j = int(np.argmax(gain))
        if gain[j] < 1e-7:
            break
        col = np.zeros(len(target))
        np.add.at(col, cls[j], n[j])
        cols.append(col)
        passive.append(j)
        x = np.append(x, 0.0)
        while True:
            m = np.stack(cols, axis=1)
            z = np.linalg.solve(m.T @ m + 1e-10 * np.eye(len(cols)), m.T @ h)
            if (z > 0).all():
                x = z
                break
            neg = z <= 0
            step = float(np.min(x[neg] / np.maximum(x[neg] - z[neg], 1e-300)))
            x = x + step * (z - x)
            keep = x > 1e-12
            if keep.all():  # nothing to take out but rounding
                keep = ~neg
            cols = [c for c, k in zip(cols, keep) if k]
            passive = [p for p, k in zip(passive, keep) if k]
            x = x[keep]
            if not passive:
                break
    weight[passive] = x * scale
    return weight


def plan_containers(hist: np.ndarray, edges: np.ndarray, capacity: int) -> pd.DataFrame:
    """Which ranks of each class go to which pattern: ``cls, first, last, per, base``; an item of rank r with first <= r
    < last goes to container ``base + (r - first) // per``."""
    cls, n = patterns(edges, hist > 0, capacity)
    times = np.rint(nnls(cls, n, hist.astype(float))).astype(np.int64)
    left, taken, base, out = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64), 0, []
    for p in np.argsort(-times, kind="stable"):
        if times[p] <= 0:
            break
        need = np.zeros(len(hist), np.int64)
        np.add.at(need, cls[p], n[p])
        used = np.flatnonzero(need)
        t = int(min(times[p], (left[used] // need[used]).min()))
        if t <= 0:
            continue
        for c in used:
            out.append((int(c), int(taken[c]), int(taken[c] + t * need[c]), int(need[c]), base))
            taken[c] += t * need[c]
            left[c] -= t * need[c]
        base += t
    return pd.DataFrame(out, columns=["cls", "first", "last", "per", "base"])


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers by best fit, largest first: each item goes where it leaves the least room."""
    out, room, names, opened = np.zeros(len(sizes), np.int64), [], [], 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        k = bisect.bisect_left(room, s)
        if k < len(room):
            free, name = room.pop(k) - s, names.pop(k)
        else:
            free, name, opened = capacity - s, opened, opened + 1
        out[i] = name
        k = bisect.bisect_left(room, free)
        room.insert(k, free)
        names.insert(k, name)
    return out


def pack(sizes: DataFrame, conf: PackConf = PackConf()) -> DataFrame:
    """``doc_id, piece_no, token_start, n_tokens, container_id`` for ``sizes (doc_id, n_tokens)``.

    An item up to the capacity is one piece; a larger one is cut into full containers and a rest that is packed like an
    item. Items without tokens (null and empty texts) take the room of one token, so that no container holds an
    unbounded number of them. Null sizes count as 0, null ids leave, repeated ids are packed as often as they occur, an
    empty table gives an empty table.

    The driver sees the histogram of at most some 300 classes and the plan made from it. Items are ranked inside a class
    in groups of about ``group`` by hash, so a class with a third of all items is spread over many tasks.
    """
    cap = conf.capacity
    edges = size_classes(cap)
    whole = F.floor(F.col("n_tokens") / cap).cast("int")
    whole = F.when(F.col("n_tokens") % cap == 0, F.greatest(whole - 1, F.lit(0))).otherwise(whole)  # the last full piece is the rest
    rows = sizes.where("doc_id is not null").select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    pieces = rows.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece_no")).select("doc_id", "piece_no", (F.col("piece_no").cast("long") * cap).alias("token_start"), F.least(F.lit(cap).cast("long"), F.col("n_tokens") - F.col("piece_no").cast("long") * cap).cast("int").alias("n_tokens"))
    upper = F.array(*[F.lit(int(e)) for e in edges])
    cls = F.size(F.filter(upper, lambda e: e < F.greatest(F.col("n_tokens"), F.lit(1))))
    items = materialize(pieces.withColumn("cls", cls), "items")
    n = items.count()
    salts = max(1, -(-n // conf.group))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(3)), F.lit(salts)).cast("int"))
    counts = materialize(items.groupBy("cls", "salt").agg(F.count("*").alias("n")), "counts")
    hist = np.zeros(len(edges), np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # one row per class
        hist[r["cls"]] = r["n"]
    plan = plan_containers(hist, edges, cap)
    before = Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("cls", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("cls", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = items.withColumn("r", rank).join(offset, ["cls", "salt"]).withColumn("r", F.col("r") + F.col("offset"))
    schema = "cls int, first long, last long, per long, base long"
    steps = items.sparkSession.createDataFrame(plan, schema) if len(plan) else items.sparkSession.createDataFrame([], schema)
    # at most three rows of the plan per pattern, a few hundred patterns
    placed = ranked.join(F.broadcast(steps.withColumnRenamed("cls", "_cls")), (F.col("cls") == F.col("_cls")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("last")), "left")
    placed = materialize(placed.select("doc_id", "piece_no", "token_start", "n_tokens", (F.col("base") + F.floor((F.col("r") - F.col("first")) / F.col("per"))).alias("box")), "placed")
    done = placed.where("box is not null").select("doc_id", "piece_no", "token_start", "n_tokens", F.concat(F.lit("p"), F.col("box")).alias("container_id"))
    rest = placed.where("box is null").drop("box")
    blocks = max(1, -(-rest.count() // conf.block))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable")
        box = best_fit(np.maximum(1, pdf["n_tokens"].to_numpy()), cap)
        return pdf.assign(container_id=[f"r{b}-{x}" for b, x in zip(pdf["block"], box)]).drop(columns="block")

    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(5)), F.lit(blocks)).cast("int"))
    rest = rest.groupBy("block").applyInPandas(fit, "doc_id long, piece_no int, token_start long, n_tokens int, container_id string")
    return done.unionByName(rest)


def pack_documents(docs: DataFrame, conf: PackConf = PackConf()) -> DataFrame:
    """``pack`` for the token sizes of ``docs (doc_id, text)``."""
    return pack(token_sizes(docs, conf), conf)
