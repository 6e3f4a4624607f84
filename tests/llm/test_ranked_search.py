"""Ranked search against the score's formula, document by document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """docs, items: (id, text). Sorted (item, rank, id, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(counts, lengths):
            score = 0
            for t, times in Counter(terms(text)).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + 75 * n * n_docs // n_terms
                    score += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(seed, n):
    r = random.Random(seed)
    common, rare = [f"c{k}" for k in range(6)], [f"Rare{k}é" for k in range(80)]
    texts = [None, "", " .,\n", "@", "C1", "c1 c1"]
    while len(texts) < n:
        if r.random() < 0.3:
            texts.append(r.choice(texts))  # ties
        else:
            texts.append(r.choice([" ", "--", "\n"]).join(r.choices(common + rare, [30] * 6 + [1] * 80, k=r.choice([1, 3, 20, 90]))))
    items = [" ".join(r.choices(common + rare + ["nowhere"], k=r.randint(1, 14))) for _ in range(12)] + [None, "", "nowhere", "c1", "c1 c1 C1 c0"]
    return texts, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 5, 1, 9, 4) for i, t in docs], "doc_id long, text string, score int, n int, id int, terms int").repartition(4)
    return d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int").repartition(2)


def rows(got):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block_docs, block_bytes", [(1 << 15, 4 << 20), (3, 40), (1000, 200)])
def test_ranking(spark, monkeypatch, block_docs, block_bytes):
    monkeypatch.setattr(R, "BLOCK_DOCS", block_docs)
    texts, items = corpus(block_docs, 150)
    ids = random.Random(3).sample(range(10**6), len(texts))
    docs, asked = list(zip(ids, texts)), list(enumerate(items))
    got = rows(R.ranked_search(*frames(spark, docs, asked), block_bytes=block_bytes))
    assert got == sorted(brute(docs, asked), key=repr)


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("seed", range(6))
def test_accumulators_lose_nothing(seed, k):
    """Search over many blocks in turn, with the floor of those before."""
    r = random.Random(seed)
    texts, items = corpus(seed, 400)
    vocabulary = {}
    asked = [Counter(vocabulary.setdefault(t.encode(), len(vocabulary)) for t in terms(x)) for x in items]
    docs = [(i, *R.term_counts(t.encode(), vocabulary)) for i, t in enumerate(texts) if terms(t)]
    n_docs, n_terms = len(docs), sum(n for _, n, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    best = [R.Best(k) for _ in items]
    stopped = 0
    while docs:
        block, docs = docs[: (size := r.choice([1, 10, 200]))], docs[size:]
        flat = [(t, c) for _, _, own in block for t, c in own.items()]
        index = R.Inverted(np.array([t for t, _ in flat], np.int32), np.array([c for _, c in flat], np.int32), np.array([len(c) for _, _, c in block]), np.array([n for _, n, _ in block]), n_docs, n_terms)
        ids = np.array([i for i, _, _ in block])
        for own, query in zip(best, asked):
            order = sorted((t for t in query if t in df), key=lambda t: (df[t], t))
            found, scores = index.search([(t, query[t] * R.weight(n_docs, df[t])) for t in order], k, own.floor)
            stopped += index.seen.sum() < sum(any(t in c for t in query) for _, _, c in block)
            own.add(scores, ids[found], np.zeros(len(found), bool))
    got = [(no, rank, int(i), int(s)) for no, own in enumerate(best) for rank, (i, s) in enumerate(zip(own.ids, own.scores), 1)]
    assert got == brute(list(enumerate(texts)), list(enumerate(items)), k)
    assert stopped  # the bound was at work


def test_null_and_repeated_ids(spark):
    docs = [(None, "red fox"), (None, "red fox"), (5, "red fox"), (5, "red fox"), (2, "red Fox"), (7, None), (8, "blue " * 3)]
    items = [(None, "red"), (1, "RED blue"), (1, "red blue"), (3, None)]
    assert rows(R.ranked_search(*frames(spark, docs, items))) == sorted(brute(docs, items), key=repr)


def test_empty_tables(spark):
    some, none = [(1, "red fox")], []
    for docs, items in ((none, none), (some, none), (none, some)):
        got = R.ranked_search(*frames(spark, docs, items))
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 20])
def test_counts_of_stretches(chunk):
    text = "".join(random.Random(chunk).choices(["Ab ", "é", "-", "Z9", "\x7f", "ab", " "], k=400))
    vocabulary = {b"ab": 0, "é".encode(): 1, b"z9": 2}
    n, counts = R.term_counts(text.encode(), vocabulary, chunk)
    want = Counter(terms(text))
    assert n == sum(want.values()) and counts == {vocabulary[t.encode()]: c for t, c in want.items() if t.encode() in vocabulary}


def test_very_long_text(spark):
    docs = [(1, "alpha beta gamma " * 400_000), (2, "alpha beta"), (3, "gamma")]
    items = [(1, "alpha gamma"), (2, "gamma gamma")]
    assert rows(R.ranked_search(*frames(spark, docs, items))) == sorted(brute(docs, items), key=repr)
