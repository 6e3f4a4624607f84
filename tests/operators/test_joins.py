"""As-of and range joins against brute force, with nulls, ties, hot keys, clashing names and empty tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import asof_join as A
from tessera.operators.range_join import range_join


def sides(spark, seed, n=150, keys=4, times=60):
    r = random.Random(seed)
    pick = lambda x: None if r.random() < 0.05 else x
    left = [(k, pick(r.choice([0] * keys + list(range(keys)))), pick(r.randrange(times))) for k in range(n)]
    right = [(k, pick(r.choice([0] * keys + list(range(keys)))), pick(r.randrange(times)), r.randrange(3)) for k in range(n)]
    return left, right, spark.createDataFrame(left, "id long, key int, at int").repartition(3), spark.createDataFrame(right, "id long, key int, at int, tie int").repartition(3)


def brute_asof(left, right, direction, exact, tolerance, keyed):
    out = {}
    for i, key, at in left:
        able = [r for r in right if at is not None and r[2] is not None and (not keyed or key is not None and r[1] == key)]
        back = max((r for r in able if r[2] < at or exact and r[2] == at), key=lambda r: (r[2], r[3], r[0]), default=None)
        after = min((r for r in able if r[2] > at or exact and r[2] == at), key=lambda r: (r[2], -r[3], -r[0]), default=None)
        found = {"backward": back, "forward": after}.get(direction)
        if direction == "nearest":
            found = after if back is None or after is not None and after[2] - at < at - back[2] else back
        if found is not None and tolerance is not None and abs(found[2] - at) > tolerance:
            found = None
        out[i] = found and found[0]
    return out


@pytest.mark.parametrize("share", [1000, 3, 10])
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact, tolerance, keyed", [(True, None, True), (False, None, True), (True, 2, False), (False, 3, False)])
def test_asof(spark, share, direction, exact, tolerance, keyed):
    left, right, a, b = sides(spark, share)
    options = {"tie_break": ("tie", "id"), "share": share, "min_rows": 5} if share < 1000 else {"tie_break": ("tie", "id")}
    got = A.asof_join(a, b, "at", "at", by=("key",) if keyed else (), direction=direction, allow_exact=exact, tolerance=None if tolerance is None else F.lit(tolerance), **options)
    assert got.columns == ["id", "key", "at", "id_right", *(["key_right"] if not keyed else []), "at_right", "tie"]
    assert {r["id"]: r["id_right"] for r in got.collect()} == brute_asof(left, right, direction, exact, tolerance, keyed)


def test_asof_cuts_a_hot_key_and_no_time(spark):
    rows = spark.createDataFrame([(1, k // 10) for k in range(1000)] + [(k, 5) for k in range(100, 130)], "_key0 int, _num int")
    slotted, cut = A._slotted(rows, ["_key0"], 20, 10)
    sizes = {r["_slot"]: r["count"] for r in slotted.where("_key0 = 1").groupBy("_slot").count().collect()}
    assert cut and len(sizes) > 10 and max(sizes.values()) <= 120
    assert slotted.where("_key0 = 1").groupBy("_num").agg(F.count_distinct("_slot").alias("n")).where("n > 1").isEmpty()
    assert slotted.where("_key0 > 1 AND _slot IS NOT NULL").isEmpty()


def test_asof_inner_types_and_payloads(spark):
    day = datetime.date
    left = spark.createDataFrame([("a", day(2024, 1, 5), {"k": 1}), ("b", day(2024, 1, 5), None)], "key string, day date, m map<string,int>")
    right = spark.createDataFrame([("a", day(2024, 1, 1), {"k": 2}, [1]), ("a", day(2024, 1, 4), {"k": 3}, [2]), (None, day(2024, 1, 5), None, None)], "key string, `on day` date, m map<string,int>, l array<int>")
    got = A.asof_join(left, right, "day", "on day", by=("key",), how="inner", tolerance=F.expr("INTERVAL 2 DAYS"))
    assert [r.asDict() for r in got.collect()] == [{"key": "a", "day": day(2024, 1, 5), "m": {"k": 1}, "on day": day(2024, 1, 4), "m_right": {"k": 3}, "l": [2]}]
    stamp = datetime.datetime(2024, 1, 1)
    for kind in ("timestamp", "timestamp_ntz", "double", "decimal(9,2)"):
        value = stamp if "time" in kind else 4
        one = spark.createDataFrame([(value,)], "t timestamp_ntz" if "time" in kind else "t int").select(F.col("t").cast(kind))
        assert A.asof_join(one, one, "t", "t").collect()[0][1] is not None


def test_asof_of_nothing(spark):
    _, _, a, b = sides(spark, 1, 10)
    assert A.asof_join(a.limit(0), b, "at", "at", by=("key",)).count() == 0
    got = A.asof_join(a, b.limit(0), "at", "at", by=("key",)).collect()
    assert len(got) == 10 and all(r["id_right"] is None for r in got)
    with pytest.raises(TypeError):
        A.asof_join(a, b.withColumn("at", F.col("at").cast("long")), "at", "at")


def test_asof_plan_has_no_join_of_rows(spark):
    _, _, a, b = sides(spark, 1, 10)
    plan = A.asof_join(a, b, "at", "at", by=("key",))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window") >= 1


def spans(spark, seed, n=120):
    r = random.Random(seed)
    infinite = float("inf")

    def side():
        out = []
        for k in range(n):
            lo = r.choice([r.uniform(-50, 50), float(r.randint(-20, 20))])
            size = r.choice([0, 0, r.random(), r.randint(1, 4), 30.0, 4000.0, -1.0])
            row = [k, r.randrange(3), lo, lo + size]
            if r.random() < 0.08:
                row[r.randrange(1, 4)] = None
            if r.random() < 0.05:
                row[3] = infinite
            if r.random() < 0.03:
                row[2], row[3] = -infinite, float("nan")
            out.append(tuple(row))
        return out

    a, b = side(), side()
    schema = "id long, key int, lo double, hi double"
    return a, b, spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).repartition(2)


def brute_range(a, b, keyed, closed):
    out = []
    for i, k, lo, hi in a:
        for j, m, lo2, hi2 in b:
            if None in (lo, hi, lo2, hi2) or keyed and (k is None or k != m) or not (lo <= hi and lo2 <= hi2):
                continue
            if (lo <= hi2 and lo2 <= hi) if closed == "both" else (lo < hi2 and lo2 < hi or lo == lo2):
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("closed", ["both", "left"])
@pytest.mark.parametrize("seed", [1, 2])
def test_range(spark, keyed, closed, seed):
    a, b, left, right = spans(spark, seed)
    got = range_join(left, right, ("lo", "hi"), ("lo", "hi"), by=("key",) if keyed else (), closed=closed)
    assert got.columns == ["id", "key", "lo", "hi", "id_right", *([] if keyed else ["key_right"]), "lo_right", "hi_right"]
    assert sorted((r["id"], r["id_right"]) for r in got.collect()) == brute_range(a, b, keyed, closed)


def test_range_left_keeps_all(spark):
    a, b, left, right = spans(spark, 3)
    pairs = brute_range(a, b, True, "both")
    got = range_join(left, right, ("lo", "hi"), ("lo", "hi"), by=("key",), how="left", left_key=("id",)).collect()
    alone = {r[0] for r in a} - {i for i, _ in pairs}
    assert alone and sorted((r["id"], r["id_right"]) for r in got if r["id_right"] is not None) == pairs
    assert sorted(r["id"] for r in got if r["id_right"] is None) == sorted(alone)


def test_range_of_times_and_large_numbers(spark):
    base = datetime.datetime(2024, 1, 1)
    at = lambda s: base + datetime.timedelta(seconds=s)
    times = spark.createDataFrame([(k, at(k * 7), at(k * 7 + k % 90)) for k in range(100)], "id long, lo timestamp_ntz, hi timestamp_ntz")
    want = brute_range(*[[(k, 0, k * 7, k * 7 + k % 90) for k in range(100)]] * 2, False, "both")
    for kind in ("timestamp_ntz", "timestamp"):
        side = times.select("id", F.col("lo").cast(kind), F.col("hi").cast(kind))
        assert sorted((r["id"], r["id_right"]) for r in range_join(side, side, ("lo", "hi"), ("lo", "hi")).collect()) == want
    large = [(k, 0, 2**62 + k, 2**62 + k + k % 3) for k in range(40)]
    side = spark.createDataFrame([(r[0], r[2], r[3]) for r in large], "id long, lo long, hi long")
    assert sorted((r["id"], r["id_right"]) for r in range_join(side, side, ("lo", "hi"), ("lo", "hi")).collect()) == brute_range(large, large, False, "both")
    exact = side.select("id", (F.col("lo").cast("decimal(30,2)") / 100).alias("lo"), (F.col("hi").cast("decimal(30,2)") / 100).alias("hi"))
    assert range_join(exact, exact, ("lo", "hi"), ("lo", "hi")).count() == len(brute_range(large, large, False, "both"))


def test_range_of_nothing(spark):
    _, _, left, right = spans(spark, 4, 10)
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.where("lo > hi"), right)):
        assert range_join(a, b, ("lo", "hi"), ("lo", "hi")).count() == 0


def test_range_copies_a_row_to_few_bins(spark):
    """One interval over everything and many points: an equi-join, and no more candidates than a few for each pair."""
    points = spark.range(2000).select(F.col("id"), F.col("id").alias("at"))
    wide = spark.createDataFrame([(0, 0, 10**9)] + [(k, k * 20, k * 20 + 3) for k in range(1, 100)], "id long, lo long, hi long")
    out = range_join(points, wide, ("at", "at"), ("lo", "hi"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 2000 + 99 * 4
