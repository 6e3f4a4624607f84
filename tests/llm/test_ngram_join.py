"""The n-gram join where members spread over many blocks, and at similarity 1, against brute force."""

import random

import pytest

from tessera.llm import ngram_join
from tests.llm.test_ops import brute_join, corpus, frame


def chain(n, step, width=100):
    r = random.Random(n)
    w = [f"c{r.randrange(10**6)}" for _ in range(n * step + width)]
    return [" ".join(w[k * step : k * step + width]) for k in range(n)]


@pytest.mark.parametrize("block, wide, fewer", [(150, 0, 0), (400, 1, 0), (2000, 0, 0.01), (300, 0, 4)])
def test_members_meet_in_the_buckets_of_their_bands(spark, monkeypatch, block, wide, fewer):
    """Groups whose members are near their pivot, far from it, linked in chains, and chains of unlinked rows."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block)
    monkeypatch.setattr(ngram_join, "WIDE_BLOCKS", wide)
    monkeypatch.setattr(ngram_join, "FEWER", fewer)
    long = " ".join(f"x{k}" for k in range(90))
    texts = corpus(5, 50) + [long.replace(f"x{k} ", f"y{k} ") for k in range(1, 25)] + [long] * 3
    texts += chain(40, 15) + chain(30, 6) + chain(10, 3)
    got = ngram_join.ngram_join(frame(spark, texts)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_join(texts)


def test_similarity_one_links_equal_sets_only(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 50)
    long = " ".join(f"x{k}" for k in range(90))
    texts = [long, long.upper(), long + " end", long.replace(" ", ", "), *chain(6, 3)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(frame(spark, texts), similarity=1.0).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 3: (0, 2)} | {k: (k, 0) for k in (2, *range(4, 10))}


def test_very_long_texts(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(300_000))
    texts = [long, long + " and a few more words", long[: len(long) // 2], "short"]
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.ngram_join(frame(spark, texts)).collect()}
    assert got == brute_join(texts)
