"""Sketches rolled up against exact values, within the stated bounds, and against sketches of the rows themselves."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import sketches as S

SPECS = {"users": ("distinct", "user"), "price": ("quantiles", "price"), "kinds": ("top", "kind")}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for k in range(30_000):
        out.append((r.randrange(20), int(r.paretovariate(0.6)) % 9000, r.gauss(100, 40) if r.random() > 0.01 else None, f"k{int(r.expovariate(0.4))}"))
    return out


def test_roll_up_holds_its_bounds(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "day int, user long, price double, kind string").repartition(4)
    S.sketch(df, ("day",), SPECS).write.parquet(str(tmp_path / "days"))  # stored, and merged without the rows
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 20
    for by, groups in ((("week",), {k // 7: None for k in range(20)}), ((), {None: None})):
        merged = S.roll_up(days.withColumn("week", F.col("day").cast("int") - F.col("day") % 7), by, SPECS)
        got = S.estimates(merged, SPECS, ranks=(0.1, 0.5, 0.9), k=5).collect()
        assert len(got) == (3 if by else 1)
        for g in got:
            own = [x for x in rows if not by or x[0] - x[0] % 7 == g["week"]]
            assert g.n == len(own)
            exact = len({x[1] for x in own})
            assert abs(g.users - exact) <= 4 * S.DISTINCT_ERROR * exact
            prices = [x[2] for x in own if x[2] is not None]
            for rank, value in zip((0.1, 0.5, 0.9), g.price):
                assert abs(sum(p <= value for p in prices) / len(prices) - rank) <= 2 * S.RANK_ERROR
            assert Counter({t.item: t["count"] for t in g.kinds}) == Counter(dict(Counter(x[3] for x in own).most_common(5)))


def test_parts_in_any_order_count_once(spark, rows):
    df = spark.createDataFrame(rows[:5000], "day int, user long, price double, kind string")
    whole = S.estimates(S.sketch(df, (), SPECS), SPECS).first()
    twice = S.sketch(df, ("day",), SPECS)
    again = S.estimates(S.roll_up(twice.unionByName(twice), (), SPECS), SPECS).first()
    assert again.users == S.estimates(S.roll_up(twice, (), SPECS), SPECS).first().users and again.n == 2 * whole.n
    assert abs(again.users - whole.users) <= 4 * S.DISTINCT_ERROR * whole.users


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, None, None), (None, 5, 2.0, "a")], "day int, user long, price double, kind string")
    got = {g.day: g for g in S.estimates(S.roll_up(S.sketch(df, ("day",), SPECS), ("day",), SPECS), SPECS).collect()}
    assert got[1].users == 0 and got[1].price is None and got[1].n == 1
    assert got[None].users == 1 and got[None].price == [2.0, 2.0, 2.0] and got[None].kinds[0].item == "a"
    assert S.sketch(df.limit(0), ("day",), SPECS).count() == 0
    with pytest.raises(ValueError):
        S.sketch(df, (), {"x": ("mean", "price")})
