"""Reach against a search by hand, with cycles, repeats, nulls and bounds."""

import random

import pytest

from tessera.operators.reach import reach


def brute(edges, starts, bound):
    out = {}
    for s in starts:
        front = {s}
        for k in range(1, bound + 1):
            front = {b for a, b in edges if a in front and b is not None} - {n for t, n in out if t == s}
            out |= {(s, n): k for n in front}
    return out


@pytest.mark.parametrize("bound", [1, 3, 50])
def test_reach(spark, bound):
    r = random.Random(bound)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(45)] + [(k, k + 1) for k in range(100, 110)] + [(7, 7), (None, 1), (1, None)]
    df = spark.createDataFrame(edges + edges[:9], "a long, b long").repartition(3)
    starts = {a for a, b in edges if a is not None and b is not None}
    want = brute([e for e in edges if None not in e], starts, bound)
    got = reach(df, "a", "b", bound).collect()
    assert len(got) == len(want) and {(r.start, r.node): r.steps for r in got} == want
    some = spark.createDataFrame([(100,), (7,), (7,), (None,), (999,)], "x long")
    got = reach(df, "a", "b", bound, some).collect()
    assert {(r.start, r.node): r.steps for r in got} == {k: v for k, v in want.items() if k[0] in (100, 7)}


def test_reach_of_nothing(spark):
    assert reach(spark.createDataFrame([(None, None)], "a long, b long"), "a", "b", 5).count() == 0
    with pytest.raises(ValueError):
        reach(spark.createDataFrame([], "a long, b long"), "a", "b", 0)
