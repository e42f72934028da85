import random

import numpy as np

from loomseq.llm import _dna


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def mutate(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice("ACGT".replace(c, "")) if x < 2 * rate / 3 else c)
        if 2 * rate / 3 <= x < rate:
            out.append(rng.choice("ACGT"))
    return "".join(out)


def test_edit_distance_against_the_table():
    rng = random.Random(1)
    for _ in range(100):
        a, b = dna(rng, rng.randint(0, 40)), dna(rng, rng.randint(0, 40))
        assert _dna.edit_distance(a, b) == levenshtein(a, b)


def test_kmer_set_is_strand_free():
    rng = random.Random(2)
    s = dna(rng, 200)
    assert np.array_equal(_dna.kmer_set(s, 10), _dna.kmer_set(_dna.reverse_complement(s), 10))
    assert len(_dna.kmer_set("ACGTN" * 5, 10)) == 0 and len(_dna.kmer_set("ACG", 10)) == 0


def test_block_similarity_never_overrates_and_finds_moved_pieces():
    rng = random.Random(3)
    for _ in range(20):
        a = dna(rng, 400)
        b = mutate(rng, a, 0.06)
        plain = 1 - levenshtein(a, b) / min(len(a), len(b))
        assert abs(_dna.block_similarity(a, b) - plain) < 0.02
        moved = b[150:260] + b[:150] + b[260:]
        assert _dna.block_similarity(a, _dna.reverse_complement(moved)) > plain - 0.03
        other = dna(rng, 400)
        assert _dna.block_similarity(a, other) < 0.57


def test_noisy_copies_stay_above_unrelated_texts():
    rng = random.Random(4)
    for _ in range(15):
        h = dna(rng, 600)
        a, b = mutate(rng, h, 0.16), mutate(rng, h, 0.16)
        assert _dna.block_similarity(a, b[300:] + b[:300]) > 0.62


def test_short_empty_and_odd_texts():
    assert _dna.block_similarity("", "ACGT") == 0
    assert _dna.block_similarity("ACGTACGT", "ACGTACGT") == 1
    assert _dna.block_similarity("ACGTTT", "AAACGT") == 1  # reverse complement
    assert 0 <= _dna.block_similarity("N" * 500, "N" * 500) <= 1
    assert _dna.block_similarity("A" * 3000, "A" * 2990) > 0.9


def test_long_texts_with_many_edits():
    rng = random.Random(9)
    for n, rate in ((1500, 0.33), (5000, 0.1)):
        a = dna(rng, n)
        b = mutate(rng, a, rate)
        plain = _dna.edit_distance(a, b)
        assert plain > 400
        got = _dna.block_similarities([a, a[: n // 2], a], [b, b, a + dna(rng, 1200)], at_least=0.6)
        assert abs(got[0] - (1 - plain / min(n, len(b)))) < 0.05
        assert 0 <= got[1] < got[0] and 0 <= got[2] < 1
    assert 0 < _dna._block_edits([dna(rng, 700)], [dna(rng, 3000)], 6)[0] <= 3700


def test_short_moved_pieces():
    rng = random.Random(12)
    for n in (30, 50, 90, 110):
        a, b = dna(rng, n), dna(rng, n)
        assert _dna.block_similarity(a + b, b + a) == 1 and _dna.block_similarity(a + b, _dna.reverse_complement(b + a)) == 1


def test_gate_lets_pairs_over_the_limit_pass():
    rng = random.Random(13)
    pairs = []
    for _ in range(150):
        a = dna(rng, rng.choice((500, 640)))
        b = mutate(rng, a, 0.30)
        cut = rng.randrange(100, len(b) - 100)
        pairs.append((a, b[cut:] + b[:cut]))
    near = _dna.block_similarities([p[0] for p in pairs], [p[1] for p in pairs], 0.62)
    assert (near >= 0.62).mean() > 0.98
    far = _dna.block_similarities([p[0] for p in pairs], [dna(rng, 600) for _ in pairs], 0.62)
    assert (far < 0.5).all()


def test_edit_distances_of_many_pairs():
    rng = random.Random(14)
    a, b = ([dna(rng, rng.randint(0, 90)) + "N" * (n % 3) for n in range(150)] for _ in range(2))
    assert _dna.edit_distances(a, b).tolist() == [_dna.edit_distance(x, y) for x, y in zip(a, b)]
