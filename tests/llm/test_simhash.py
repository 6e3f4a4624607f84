"""SimHash groups against brute force: shingle by shingle, pair by pair."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_least(prints, ids, radius=4):
    """The smallest id reachable over pairs of prints of at most `radius` unlike bits."""
    n = len(prints)
    near = [[j for j in range(n) if bin(prints[i] ^ prints[j]).count("1") <= radius] for i in range(n)]
    least = list(ids)
    for _ in range(n):
        now = [min((least[j] for j in near[i] if least[j] is not None), default=None) for i in range(n)]
        if now == least:
            return now
        least = now


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = ["Wort", "célà", "x", "the", "WORD", "a b", "İ", "ﬁ", "zz"] + [f"w{k}" for k in range(60)]
    out = [None, "", " \t\n", "one", "ONE", "one\x0btwo", "one two three", "one two three four", "a b c d e"]
    while len(out) < n:
        base = (r.choice(out) or "").split(" ")
        if r.random() < 0.6 and len(base) > 60:
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\t", "\r\n"]).join(base))
        else:
            out.append(" ".join(r.choices(vocabulary, k=r.choice([1, 2, 4, 5, 80, 200]))))
    return out


def frame(spark, texts, ids):
    return spark.createDataFrame([(i, t, "f", 3, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, id int, cell int, n int").repartition(3)


@pytest.mark.parametrize("block", [16384, 3])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = corpus(block, 160)
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(4).shuffle(ids)
    prints = [brute_fingerprint(t) for t in texts]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark, texts, ids)).collect()}
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_least(prints, ids))}
    assert len({c for _, c in got.values()}) < len(set(prints))


def test_null_and_repeated_ids(spark):
    texts = ["a b c d e", "A b c d e", "a b c d e", "own text here now", "own text here now", None, "", "solo"]
    ids = [None, 7, 7, None, None, 3, None, 2]
    got = simhash.simhash_groups(frame(spark, texts, ids)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == sorted([(0, 7), (7, 7), (7, 7), (0, 0), (0, 0), (3, 3), (0, 3), (2, 2)])
    assert {r.fingerprint for r in got if r.component_id == 3} == {"0" * 16}


def test_empty_table(spark):
    assert simhash.simhash_groups(frame(spark, [], [])).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 20])
def test_fingerprint_of_stretches(chunk):
    r = random.Random(chunk)
    for n in (0, 1, 2, 3, 4, 5, 6, 50, 500):
        text = " \t".join(r.choices(["Ab", "cé", "longerword", "x"], k=n)) + "\n " * (n % 2)
        assert simhash.fingerprint(text.encode(), 4, chunk) % 2**64 == brute_fingerprint(text)


def test_very_long_text(spark):
    text = " ".join(f"word{k % 977} and{k % 13}" for k in range(200_000))
    got = simhash.simhash_groups(frame(spark, [text, text.upper(), text + " end"], [3, 1, 2])).collect()
    assert {r.component_id for r in got} == {1} and f"{brute_fingerprint(text):016x}" == next(r.fingerprint for r in got if r.doc_id == 3)


def pairs(fps, radius):
    return np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)


@pytest.mark.parametrize("radius", [0, 1, 2, 4, 7])
def test_bit_planes(radius):
    r = np.random.default_rng(radius)
    for n in (1, 2, 63, 64, 65, 130, 300):
        fps = r.integers(0, 2**64, 6, dtype=np.uint64)[r.integers(0, 6, n)]
        for _ in range(radius + 2):
            fps = fps ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64))
        whole = simhash.merged(np.arange(n), *pairs(fps, radius))
        assert (simhash.Lanes(fps, [n], [0]).groups(radius) == whole).all()
        if n > 1:  # two sides, and many cells in one layout: no link is lost and none made up
            a, b = pairs(fps, radius)
            cut = n // 2
            for sizes, splits, met in (([n], [cut], (a < cut) & (b >= cut)), ([cut, n - cut], [0, 0], (a < cut) == (b < cut))):
                got = simhash.Lanes(fps, sizes, splits).groups(radius)
                least = simhash.merged(np.arange(n), a[met], b[met])
                assert (got[least] == got).all() and (whole[got] == whole).all()


def test_masks_meet_every_pair_within_the_radius():
    r = random.Random(2)
    for radius in (0, 1, 4, 7):
        assert len(simhash.masks(radius)) == (radius + 2) * (radius + 1) // 2
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), radius))
            assert any(x & (m % 2**64) == 0 for m in simhash.masks(radius))
