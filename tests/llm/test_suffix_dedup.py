"""Stretches of long texts, and what a long text takes of memory."""

import random
import tracemalloc

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S
from tests.llm.test_ops import brute_suffix, frame


def prose(seed, size):
    r = random.Random(seed)
    parts = [r.randbytes(r.randint(40, 400)).hex().encode() for _ in range(40)]
    out = b""
    while len(out) < size:
        out += r.choice(parts) if r.random() < 0.5 else r.randbytes(60).hex().encode()
    return out[:size]


@pytest.mark.parametrize("stretch", [1, 7, 100, 1000, 1 << 20])
def test_runs_of_stretches_are_those_of_the_whole(stretch):
    for data in (b"", b"a" * 99, b"a" * 100, b"a" * 1500, prose(stretch, 4000), b"ab" * 600 + prose(2, 900)):
        for got, want in zip(S.text_runs(data, stretch=stretch), S.cover_runs(data)):
            assert (got == want).all() and len(got) == len(want)


def test_spans():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(0, 12))
        start, width = r.integers(0, 300, n), r.integers(1, 40, n)
        covered = np.zeros(600, bool)
        for s, w in zip(start, width):
            covered[s : s + w + 9] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(int)))
        a, b = S._spans(start, width, 10)
        touching = list(zip(edge[::2], edge[1::2]))
        assert list(zip(a.tolist(), b.tolist())) == touching


@pytest.mark.parametrize("flush_bytes, bucket_runs, hot_ranks", [(8 << 20, 2000, 64), (50_000, 1, 64), (20_000, 2000, 0)])
def test_long_texts(spark, monkeypatch, flush_bytes, bucket_runs, hot_ranks):
    long = prose(1, 300_000).decode()
    texts = ["x" + long[1000:3000], long, long[5000:80_000] + long[5000:6000], long[:50_000] + "y" + long[50_000:]]
    got = S.suffix_dedup(frame(spark, texts), flush_bytes=flush_bytes, bucket_runs=bucket_runs, hot_ranks=hot_ranks).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_suffix(texts)


def test_memory_of_a_long_text():
    """A flush of one text takes a few times its bytes, and not a multiple that its hashes would."""
    for size in (4 << 20, 16 << 20):
        data = np.random.default_rng(1).integers(97, 123, size, dtype=np.uint8).tobytes()
        held = {(True, 1, 0, 0): (1, 0, data)}
        tracemalloc.start()
        S._flush(held, S.LENGTH, S.KMER, S.HOT_RANKS)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 120e6 + 7 * size
