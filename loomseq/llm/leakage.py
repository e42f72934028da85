"""Problem 8: passages of test items inside training documents.

Method: a hash set of the normalised n-grams (runs of ``n`` words) of all test items is broadcast; windows of document
words are looked up in it, hits are verified word by word, and the spans they cover can be removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.session import materialize

#: HTML tags and entities are skipped; a word is a run of letters and digits, carried on behind a hyphen at a line end
#: over blanks and the quote or comment marks of the next line.
_TOKEN = re.compile(r"<[A-Za-z/!][^<>]*>|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|([^\W_]+(?:(?<=[^\W\d_])-[ \t]*\r?\n(?:[ \t>#;%*]|//|--)*[^\W_]+)*)")
_JOIN = re.compile(r"-[ \t]*\r?\n(?:[ \t>#;%*]|//|--)*")
_GRAMS_IN_MEMORY = 8_000_000


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The normalised words of a text and the places they take in it."""
    found, at = [], []
    for m in _TOKEN.finditer(text):
        w = m.group(1)
        if w:
            found.append((_JOIN.sub("", w) if "\n" in w else w).lower())
            at.append(m.span())
    return found, at


class WordHash:
    """64-bit hashes of words and of windows of ``n`` words."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(n)], np.uint64)

    def windows(self, ws: list[str]) -> np.ndarray:
        """A hash for each window of ``ws``; of windows that differ two in 2 ** 64 share one."""
        if len(ws) < self.n:
            return np.empty(0, np.int64)
        if len(self.known) > 500_000:
            self.known.clear()
        codes = np.empty(len(ws), np.uint64)
        for k, w in enumerate(ws):
            code = self.known.get(w)
            if code is None:
                code = self.known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            codes[k] = code
        out = np.zeros(len(ws) - self.n + 1, np.uint64)
        for i, p in enumerate(self.powers):
            out += codes[i : i + len(out)] * p
        return (out ^ out >> np.uint64(31)).view(np.int64)


def item_grams(items: DataFrame, n: int = 12) -> DataFrame:
    """``gram, item_id, words`` of every window of ``n`` words of every item; items with fewer words have none."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash(n)
        for pdf in batches:
            out = []
            for i, text in zip(pdf["item_id"], pdf["text"]):
                ws, _ = words(text)
                out += [(g, i, " ".join(ws[k : k + n])) for k, g in enumerate(hashes.windows(ws))]
            yield pd.DataFrame(out, columns=["gram", "item_id", "words"])

    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInPandas(grams, "gram long, item_id long, words string").distinct()


def _scan(held: Broadcast, n: int):
    """The windows of documents whose hash is among the ``held`` sorted ones."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, grams = WordHash(n), held.value
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ws, at = words(text)
                own = hashes.windows(ws)
                if not len(own) or not len(grams):
                    continue
                hit = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                out += [(doc, int(own[k]), " ".join(ws[k : k + n]), int(k), at[k][0], at[k + n - 1][1]) for k in np.flatnonzero(grams[hit] == own)]
            yield pd.DataFrame(out, columns=["doc_id", "gram", "words", "word_no", "start", "stop"])

    return scan


def leaked_windows(docs: DataFrame, items: DataFrame, n: int = 12, in_memory: int = _GRAMS_IN_MEMORY) -> DataFrame:
    """``doc_id, item_id, word_no, start, stop`` of each window of a document that is a window of an item.

    Whole texts are scanned. Null ids and null texts leave on both sides, texts with fewer than ``n`` words hold
    nothing, repeated rows repeat their windows, an empty table on either side gives an empty table.

    Every task holds a sorted array of the items' 64-bit window hashes, 8 bytes each and ``in_memory`` of them at most
    (64 MB); more are scanned for block by block, each block against all documents. Windows with a known hash are then
    verified word by word against the items' windows. A window that very many documents share meets its items in 16
    tasks.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    grams = materialize(item_grams(items, n), "grams")
    codes = grams.select("gram").distinct()
    blocks = max(1, -(-codes.count() // max(1, in_memory)))
    found: DataFrame | None = None
    for b in range(blocks):
        part = codes if blocks == 1 else codes.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        held = docs.sparkSession.sparkContext.broadcast(np.sort(part.toPandas()["gram"].to_numpy(np.int64)))  # bounded by in_memory
        hits = rows.mapInPandas(_scan(held, n), "doc_id long, gram long, words string, word_no int, start int, stop int")
        found = hits if found is None else found.unionByName(hits)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    known = grams.select("gram", "words", "item_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    return found.withColumn("salt", salt).join(known, ["gram", "words", "salt"]).select("doc_id", "item_id", "word_no", "start", "stop")


def leaked_items(docs: DataFrame, items: DataFrame, n: int = 12, in_memory: int = _GRAMS_IN_MEMORY) -> DataFrame:
    """``doc_id, item_id, n_windows``: which items, and how many of their windows, a document contains."""
    return leaked_windows(docs, items, n, in_memory).groupBy("doc_id", "item_id").agg(F.countDistinct("word_no").alias("n_windows"))


def remove_leaks(docs: DataFrame, items: DataFrame, n: int = 12, in_memory: int = _GRAMS_IN_MEMORY) -> DataFrame:
    """``doc_id, text, n_spans, n_removed`` of every document with a non-null id, leaked spans cut out.

    Overlapping windows are one span. Documents without a leak keep their text; ``n_removed`` counts letters.
    """
    found = leaked_windows(docs, items, n, in_memory).select("doc_id", "start", "stop").distinct()
    # windows of one document are merged into spans before they are gathered
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = opened.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = merged.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, found in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                kept, last = [], 0
                merged = [(x["start"], x["stop"]) for x in found] if found is not None else []
                for a, b in merged:
                    kept.append(text[last:a])
                    last = b
                out.append((doc, text if not merged else "".join(kept) + text[last:], len(merged), sum(b - a for a, b in merged)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_spans", "n_removed"])

    return rows.mapInPandas(cut, "doc_id long, text string, n_spans int, n_removed int")
