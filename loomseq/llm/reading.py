"""Problem 9: the reading level of each document's prose.

Method: interpolated n-gram models of the letters in words are trained on the prose of all documents; every word has a
surprisal under them, every document a distribution of surprisals over its whole text. The bits of a sentence and the mean
and quantiles of the bits of a word are mapped to school years by isotonic regression on the marks of human raters, one
rising curve for each, fitted in turns to what the others leave.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.session import materialize


@dataclass(frozen=True)
class ReadingConf:
    """order: letters of the longest n-gram. alphabet: a to z, any other letter, word start and end, so a model is a table of
    29 ** order numbers, however large the corpus. marks: rated documents that the curves are fitted to, drawn by hash
    where there are more. turns: how often each curve is fitted. The limits are those of demanding prose."""

    order: int = 4
    marks: int = 20_000
    turns: int = 8
    least_words: int = 40
    words_per_sentence: float = 16.0
    letters_per_word: float = 5.7


_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*(?:\n.*?)??(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_HTML_CODE = re.compile(r"<(pre|script|style)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_HTML_INLINE = re.compile(r"<(code|kbd|samp|tt)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCKQUOTE = re.compile(r"<blockquote\b.*?(?:</blockquote\s*>|\Z)", re.I | re.S)
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?[^`\n]\1(?!`)")
_LINK = re.compile(r"!?\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"\n]*\")?\)|<a\b.*?(?:</a\s*>|\Z)|<?\b(?:https?|ftp)://[^\s<>\"')]+>?|\bwww\.[^\s<>\"')]+", re.I | re.S)
_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|h[1-6]|table|tr|td|th|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)]|#{1,6})\s+")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$)")
# Abbreviations that end no sentence.
_ABBREVIATIONS = frozenset("e.g i.e etc vs cf fig figs no nos dr mr mrs ms prof al approx eq eqs sec ch vol pp p ed eds st jr sr inc ltd co dept est resp ca z.b d.h u.a bzw usw vgl nr bspw p.ej sra".split())
_LAST = re.compile(r"([^\W\d_][\w.]*)$")


def prose_sentences(text: str) -> list[str]:
    """The sentences of the prose of a post: without code, links and quoted lines; lists and paragraphs end a sentence."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t = _FENCE.sub("\n\n", t)
    t = _HTML_CODE.sub("\n\n", t)
    t = _BLOCKQUOTE.sub("\n\n", t)
    t = _HTML_INLINE.sub(" ", t)
    t = _INLINE.sub(" ", t)
    t = _LINK.sub(" ", t)
    t = _BLOCK_TAG.sub("\n\n", t)
    t = html.unescape(_TAG.sub("", t)).replace("\xa0", " ")
    segments: list[list[str]] = [[]]
    blank, code = True, False
    for line in t.split("\n"):
        if not line.strip():
            segments.append([])
            blank = True
            continue
        code = (line.startswith(("    ", "\t"))) and (blank or code)
        blank = False
        if code or line.lstrip().startswith(">"):
            segments.append([])
            continue
        item = _LIST.match(line)
        if item:
            segments += [[line[item.end() :]], []]
        else:
            segments[-1].append(line)
    out = []
    for lines in segments:
        s, begin = " ".join(lines), 0
        for m in _END.finditer(s):
            last = _LAST.search(s, begin, m.start())
            word = last.group(1).lower() if last else ""
            if m.group(0)[0] == "." and m.end() < len(s.rstrip()) and (word in _ABBREVIATIONS or len(word) == 1 and word.isalpha() and s[max(0, last.start() - 1)] in " .(" and last.group(1).isupper()):
                continue
            out.append(s[begin : m.end()].strip())
            begin = m.end()
        out.append(s[begin:].strip())
    return [s for s in out if _WORD.search(s)]


def prose_table(docs: DataFrame) -> DataFrame:
    """``doc_id, prose``: one line per sentence, for every document with a non-null id (empty for a null text)."""

    def prose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "prose": ["\n".join(prose_sentences(t)) if t else "" for t in pdf["text"]]})

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(prose, "doc_id long, prose string")


_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz~^$")}
_KNOWN = re.compile("[^a-z]")


def _padded(word: str, order: int) -> str:
    return "^" * (order - 1) + _KNOWN.sub("~", word.lower()) + "$"


def train_models(prose: DataFrame, conf: ReadingConf = ReadingConf()) -> np.ndarray:
    """Bits of each letter behind each ``order - 1`` letters, from the n-grams of all documents' words.

    Words are counted in every task before the shuffle, n-grams are made of different words only. What comes to the
    driver is a table of fixed size. Each order is mixed with the next lower one by the share of different letters seen
    after its context (Witten and Bell).
    """

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = Counter(w for p in pdf["prose"] for w in _WORD.findall(p.lower()))
            yield pd.DataFrame({"word": list(n.keys()), "n": list(n.values())})

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter[str] = Counter()
            for w, k in zip(pdf["word"], pdf["n"]):
                t = _padded(w, conf.order)
                for i in range(conf.order - 1, len(t)):
                    n[t[i - conf.order + 1 : i + 1]] += int(k)
            yield pd.DataFrame({"gram": list(n.keys()), "n": list(n.values())})

    words = prose.mapInPandas(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    grams = words.mapInPandas(count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(_LETTERS),) * conf.order)
    for r in grams.collect():  # at most 29 ** order rows
        counts[tuple(_LETTERS[c] for c in r["gram"])] = r["n"]
    p: np.ndarray | float = 1 / (len(_LETTERS) - 1)  # no letter is a word start
    for o in range(1, conf.order + 1):
        seen = counts.sum(axis=tuple(range(conf.order - o)))
        total, kinds = seen.sum(axis=-1, keepdims=True), (seen > 0).sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
    return -np.log2(p)


class Surprisal:
    """Bits of words under a table of ``train_models``."""

    def __init__(self, table: np.ndarray):
        self.table, self.order = table.reshape(-1), table.ndim
        self.known: dict[str, float] = {}

    def bits(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            at, found, top = 0, 0.0, len(self.table)
            for n, c in enumerate(_padded(word, self.order)):
                at = (at * len(_LETTERS) + _LETTERS[c]) % top
                if n >= self.order - 1:
                    found += float(self.table[at])
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found


_SCORED = "doc_id long, n_words int, n_sentences int, words_per_sentence double, letters_per_word double, bits_per_word double, bits_p10 double, bits_p50 double, bits_p90 double, score double"
#: What a level is fitted to: log2 of the bits of a sentence, and the distribution of the bits of a word.
FEATURES = ("score", "bits_per_word", "bits_p10", "bits_p50", "bits_p90")


def surprisal_table(prose: DataFrame, table: np.ndarray) -> DataFrame:
    """Size and surprisal distribution of each document's prose; ``score`` is log2 of the bits of a sentence."""
    held = prose.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Surprisal(held.value)
        for pdf in batches:
            out = []
            for doc, p in zip(pdf["doc_id"], pdf["prose"]):
                ws, n = _WORD.findall(p), p.count("\n") + 1
                if not ws:
                    out.append((doc, 0, 0, *[None] * 7))
                    continue
                bits = np.array([model.bits(w.lower()) for w in ws])
                q = np.quantile(bits, (0.1, 0.5, 0.9))
                out.append((doc, len(ws), n, len(ws) / n, sum(map(len, ws)) / len(ws), bits.mean(), *q, np.log2(bits.sum() / n)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCORED.split(", ")])

    return prose.mapInPandas(score, _SCORED)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing step function closest to y, as points (x, level)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # level, weight, first x, last x
    for a, b, w in zip(x[order], y[order], weight[order]):
        blocks.append([b, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b1 = blocks.pop()
            b0 = blocks[-1]
            b0[:] = [(b0[0] * b0[1] + b1[0] * b1[1]) / (b0[1] + b1[1]), b0[1] + b1[1], b0[2], b1[3]]
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [b[0] for b in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


@dataclass(frozen=True)
class GradeCurves:
    """A mean level and a rising curve (points x, y) for each feature; the level is their sum."""

    mean: float
    curves: tuple[tuple[np.ndarray, np.ndarray], ...]

    def level(self, x: np.ndarray) -> np.ndarray:
        return self.mean + sum(np.interp(x[:, k], *c) for k, c in enumerate(self.curves))


def fit_curves(x: np.ndarray, y: np.ndarray, turns: int) -> GradeCurves:
    """Isotonic curves fitted in turns, each to what the others leave of the marks ``y``."""
    part, mean = np.zeros_like(x), float(y.mean())
    curves = [(np.zeros(1), np.zeros(1))] * x.shape[1]
    for _ in range(turns):
        for k in range(x.shape[1]):
            xs, ys = isotonic(x[:, k], y - mean - part.sum(axis=1) + part[:, k], np.ones(len(y)))
            ys = ys - np.interp(x[:, k], xs, ys).mean()
            curves[k], part[:, k] = (xs, ys), np.interp(x[:, k], xs, ys)
    return GradeCurves(mean, tuple(curves))


def grade_curves(scored: DataFrame, labels: DataFrame, conf: ReadingConf = ReadingConf()) -> GradeCurves | None:
    """Level as a function of the features, from the marks: a document counts with its median mark, marks outside 1 to 18
    and documents without prose are left out. The driver gets ``marks`` rated documents at most."""
    marks = labels.where("doc_id is not null and grade between 1 and 18").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.percentile("grade", F.lit(0.5)).alias("grade"))
    rated = marks.join(scored.where("score is not null"), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(conf.marks)
    rows = rated.select(*FEATURES, "grade").toPandas().to_numpy(float)  # bounded by marks
    return fit_curves(rows[:, :-1], rows[:, -1], conf.turns) if len(rows) else None


def reading_levels(docs: DataFrame, labels: DataFrame, conf: ReadingConf = ReadingConf()) -> DataFrame:
    """One row per document with a non-null id: the columns of ``surprisal_table`` and ``level`` in school years.

    Null, blank and pure code texts have no words and a null level; without any usable mark all levels are null;
    repeated rows repeat; an empty table gives an empty table; other columns are ignored.
    """
    return _levels(docs, labels, conf)[0]


def _levels(docs: DataFrame, labels: DataFrame, conf: ReadingConf) -> tuple[DataFrame, GradeCurves | None]:
    prose = materialize(prose_table(docs), "prose")
    scored = materialize(surprisal_table(prose, train_models(prose, conf)), "scored")
    curves = grade_curves(scored, labels, conf)
    if curves is None:
        return scored.withColumn("level", F.lit(None).cast("double")), None

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(level=curves.level(pdf[list(FEATURES)].to_numpy(float)))

    return scored.mapInPandas(level, _SCORED + ", level double").withColumn("level", F.nanvl("level", F.lit(None).cast("double"))), curves


def demanding_documents(docs: DataFrame, labels: DataFrame, conf: ReadingConf = ReadingConf()) -> DataFrame:
    """The rows of ``reading_levels`` of demanding documents.

    Surprisal and level choose the candidates: of all documents with ``least_words`` words the least bits of a letter, and
    the least of each other feature, are measured. A demanding document has sentences of at least ``words_per_sentence``
    words of ``letters_per_word`` letters, so its sentences take no fewer bits than that many letters of the least
    surprising prose, and its level, which rises with every feature, is no lower than the curves give for these least
    values. So no demanding document is lost; the limits are then checked exactly on the candidates. Without any mark
    the bits alone choose them. Null and empty texts are not demanding.
    """
    levels, curves = _levels(docs, labels, conf)
    letter_bits = F.pow(F.lit(2.0), "score") / (F.col("words_per_sentence") * F.col("letters_per_word"))
    least = levels.where(F.col("n_words") >= conf.least_words).agg(F.min(letter_bits).alias("letter"), *[F.min(c).alias(c) for c in FEATURES[1:]]).first()
    if least["letter"] is None:
        return levels.limit(0)
    score = float(np.log2(conf.words_per_sentence * conf.letters_per_word * least["letter"])) - 1e-9
    candidates = levels.where(F.col("score") >= score)
    if curves is not None:
        floor = float(curves.level(np.array([[score, *(least[c] for c in FEATURES[1:])]]))[0]) - 1e-9
        candidates = candidates.where(F.col("level") >= floor)
    return candidates.where((F.col("n_words") >= conf.least_words) & (F.col("words_per_sentence") >= conf.words_per_sentence) & (F.col("letters_per_word") >= conf.letters_per_word))
