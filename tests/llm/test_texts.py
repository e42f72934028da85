import random
from datetime import datetime

import numpy as np

from loomseq.llm import leakage, packing, reading

DOCS = "doc_id long, text string, words string, gram string, item_id long, prose string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 5, "z", 1) for i, t in rows], DOCS)


ITEM = "The quick brown fox of 1999 jumps over the lazy dog and the cat near a river bank today."


def test_words():
    w, at = leakage.words("He **said** &quot;<b>hy-\n> phen</b>&quot; foo_bar 3rd well-known\n// la-\n// st")
    assert w == ["he", "said", "hyphen", "foo", "bar", "3rd", "well", "known", "last"]
    assert leakage.words("")[0] == [] and leakage.words("a - \nb")[0] == ["a", "b"]


def leaks(spark, rows, items, **kw):
    it = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(docs(spark, rows), it, **kw).collect()}


def test_leaks_both_ways(spark):
    ws = ITEM.rstrip(".").split(" ")
    rows = [
        (1, "intro. " + ITEM + " outro"),
        (2, "x " + " ".join(ws[3:15]) + " y"),
        (3, "x " + " ".join(ws[3:14]) + " y"),  # one word short
        (4, "# " + "\n# ".join([" ".join(ws[:6]).upper(), "<i>" + " ".join(ws[6:12]) + "</i>", " ".join(ws[12:])])),
        (5, " ".join(reversed(ws))),
        (6, None),
        (7, ""),
        (None, ITEM),
        (8, "The qu-\n> ick brown fox, of 1999: jumps *over* the _lazy_ dog and the cat"),
        (9, (" ".join(ws[:11]) + " gap ") * 2000),
        (10, ITEM * 2),
    ]
    items = [(100, ITEM, 1), (101, "too short to be found", 1), (102, None, 1), (103, ITEM, 1), (None, ITEM, 1)]
    want = {(d, i) for d in (1, 2, 4, 8, 10) for i in (100, 103)}
    assert leaks(spark, rows, items) == want
    assert leaks(spark, rows, items, in_memory=0) == want
    assert leaks(spark, rows, []) == set() and leaks(spark, [], items) == set()


def test_remove_leaks(spark):
    it = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r for r in leakage.remove_leaks(docs(spark, [(1, "Before! " + ITEM + " After."), (2, "clean"), (3, None)]), it).collect()}
    assert got[1]["text"] == "Before! . After." and got[1]["n_spans"] == 1
    assert got[2]["text"] == "clean" and got[2]["n_spans"] == 0 and got[3]["text"] is None


def test_prose():
    t = "One two e.g. three 3.5 kg. Is it? Yes (really)!\n\n- first item\n- second\n\n> quoted line here\n\n    code = 1. Not prose.\n\n```py\nx = 1. y\n```\nSee [this link](http://a.b/c) or http://x.y/z now `a.b` done\n<pre><code>no. no.</code></pre>"
    assert reading.prose_sentences(t) == ["One two e.g. three 3.5 kg.", "Is it?", "Yes (really)!", "first item", "second", "See   or   now   done"]
    assert reading.prose_sentences("") == [] and reading.prose_sentences("```\nopen fence. never closed") == []
    assert reading.prose_sentences("Dr. J. Smith saw Fig. 3 today. It was new") == ["Dr. J. Smith saw Fig. 3 today.", "It was new"]


def test_isotonic_is_monotone_and_exact_on_monotone_data():
    rng = np.random.default_rng(1)
    x = np.arange(50.0)
    xs, ys = reading.isotonic(x, x**2, np.ones(50))
    assert np.allclose(np.interp(x, xs, ys), x**2)
    xs, ys = reading.isotonic(x, x + rng.normal(0, 9, 50), np.ones(50))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def corpus(seed, n):
    rng = random.Random(seed)
    easy = "cat dog run sit map red sun hat big cup pen box fly toy".split()
    hard = "stratification heterogeneity characterizes phylogenetic discretization conceptualization authentication jurisprudence".split()
    rows, hardness = [], {}
    for i in range(n):
        h = rng.random()
        sents = []
        for _ in range(6):
            k = int(4 + 26 * h + rng.random() * 4)
            sents.append(" ".join(rng.choice(hard if rng.random() < h else easy) for _ in range(k)).capitalize() + ".")
        rows.append((i, " ".join(sents)))
        hardness[i] = h
    return rows, hardness


def test_levels_follow_held_out_marks(spark):
    rows, h = corpus(1, 160)
    rng = random.Random(2)
    marks = [(i, "r", max(1, min(18, round(2 + 14 * h[i] + rng.gauss(0, 1)))), datetime(2025, 1, 1)) for i in range(80) for _ in range(2)] + [(3, "r", None, None), (4, "r", 99, None), (None, "r", 3, None)]
    lab = spark.createDataFrame(marks, "doc_id long, rater string, grade int, rated_at timestamp")
    extra = [(900, None), (901, ""), (902, "```\ncode\n```"), (None, "words here.")]
    got = {r["doc_id"]: r for r in reading.reading_levels(docs(spark, rows + extra), lab).collect()}
    assert set(got) == set(range(160)) | {900, 901, 902}
    held = [i for i in range(80, 160)]
    level, true = np.array([got[i]["level"] for i in held]), np.array([h[i] for i in held])
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"))
    assert np.corrcoef(rank(level), rank(true))[0, 1] > 0.9
    assert np.mean(np.abs(level - (2 + 14 * true))) < 1.5
    assert got[900]["level"] is None and got[902]["n_words"] == 0
    hard = {r["doc_id"] for r in reading.demanding_documents(docs(spark, rows + extra), lab).collect()}
    want = {i for i in range(160) if got[i]["n_words"] >= 40 and got[i]["words_per_sentence"] >= 16 and got[i]["letters_per_word"] >= 5.7}
    assert hard == want and want
    unmarked = reading.reading_levels(docs(spark, rows), lab.limit(0))
    assert unmarked.where("level is not null").count() == 0
    assert {r["doc_id"] for r in reading.demanding_documents(docs(spark, rows), lab.limit(0)).collect()} == want
    assert reading.demanding_documents(docs(spark, []), lab).count() == 0
    assert reading.reading_levels(docs(spark, []), lab).count() == 0


def packed(spark, sizes, conf):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens int")
    return packing.pack(df, conf).collect()


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    sizes = [rng.choice((rng.randint(1, 12), int(rng.lognormvariate(5, 0.7)))) for _ in range(3000)] + [0, 5000, 2048, 4096, 2049]
    sizes += [6] * 2000
    got = packed(spark, sizes, packing.PackConf(group=500, block=400))
    fill, parts = {}, {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append(r)
    assert set(parts) == set(range(len(sizes))) and max(fill.values()) <= 2048
    for i, s in enumerate(sizes):
        p = sorted(parts[i], key=lambda r: r["piece_no"])
        assert sum(r["n_tokens"] for r in p) == s and len(p) == max(1, -(-s // 2048))
        assert [r["token_start"] for r in p] == [2048 * k for k in range(len(p))]
    assert sum(fill.values()) / (2048 * len(fill)) > 0.95


def test_packing_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, 5), (2, 7), (2, 7)], "doc_id long, n_tokens int")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in packing.pack(df).collect()) == [(1, 0), (2, 7), (2, 7)]
    assert packing.pack(df.limit(0)).count() == 0


def test_token_sizes(spark):
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_sizes(docs(spark, [(1, "hello world"), (2, None), (3, ""), (4, "a" * 120_000)])).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1000
    encode = packing._encoder(None, None).encode_ordinary
    rng = random.Random(8)
    for text in ("".join(rng.choice("0123456789") for _ in range(60_000)), " ".join(rng.choice(("ab", "c1", "  ", "\n", "it's")) for _ in range(5000)), " " * 3000 + "x"):
        assert packing._count(text, encode, 1000) == len(encode(text))


def test_nnls_reaches_an_exact_histogram():
    edges = packing.size_classes(64)
    hist = np.zeros(len(edges))
    hist[[15, 20]] = [40, 30]
    cls, n = packing.patterns(edges, hist > 0, 64)
    x = packing.nnls(cls, n, hist)
    made = np.zeros(len(edges))
    for c, k, w in zip(cls, n, x):
        np.add.at(made, c, k * w)
    assert (x >= 0).all() and np.abs(made - hist).max() < 0.5


def test_curves_rise_with_every_feature():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = x[:, 0] + 0.5 * x[:, 1] ** 3 + rng.normal(0, 0.3, 300)
    curves = reading.fit_curves(x, y, 8)
    for k in range(3):
        grid = np.zeros((50, 3))
        grid[:, k] = np.linspace(-3, 3, 50)
        assert (np.diff(curves.level(grid)) >= -1e-12).all()
    assert np.corrcoef(curves.level(x), y)[0, 1] > 0.95
