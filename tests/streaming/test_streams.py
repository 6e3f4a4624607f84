"""Streams on purpose-built input: late and out-of-order rows, restarts, eviction."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming.dedup import first_of_key
from tessera.streaming.funnels import funnels
from tessera.streaming.interval_join import interval_join
from tessera.streaming.tables import ROCKSDB, drain, shared_folder, table_stream
from tessera.streaming.windows import event_windows

SCHEMA = "id long, user long, at timestamp_ntz, step string"


def minute(m):
    return None if m is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)


class Folder:
    """A table to which one file is added at a time, each later than the one before."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0
        os.makedirs(self.path)

    def add(self, rows):
        self.n += 1
        part = f"{self.path}-{self.n}"
        self.spark.createDataFrame([(i, u, minute(m), s) for i, u, m, s in rows], SCHEMA).coalesce(1).write.parquet(part)
        (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        os.utime(f"{part}/{name}", (1e9 + self.n, 1e9 + self.n))
        os.rename(f"{part}/{name}", f"{self.path}/{self.n:03}.parquet")

    def stream(self):
        return table_stream(self.spark, self.path, files_per_batch=1)


def hours(stream):
    return event_windows(stream, "at", "60 minutes", [F.count("*").alias("n")], size="1 hour")


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    table = Folder(spark, tmp_path / "t")
    table.add([(1, 1, 5, "a"), (2, 1, 300, "a")])  # moves the watermark to 4:00
    table.add([(3, 1, 310, "a"), (4, 1, 250, "a"), (9, 1, None, "a")])  # 4:10 is out of order but in time
    table.add([(5, 1, 10, "a"), (6, 1, 305, "a")])  # 0:10 is too late
    table.add([(7, 1, 600, "a")])
    out = drain(hours(table.stream()), str(tmp_path / "run"))
    assert told(out) == [(minute(0), minute(60), 1), (minute(240), minute(300), 1), (minute(300), minute(360), 3)]
    assert sum(s.numRowsDroppedByWatermark for p in out.progress for s in p.stateOperators) == 1


def test_restart_goes_on_where_it_ended(spark, tmp_path):
    r = random.Random(1)
    table, rows = Folder(spark, tmp_path / "t"), []
    for k in range(4):
        part = [(k * 100 + i, r.randrange(3), k * 200 + r.randrange(200), "a") for i in range(50)]
        rows += part
        table.add(part)
        out = drain(hours(table.stream()), str(tmp_path / "run"))
    seen = max(m for _, _, m, _ in rows) - 60
    want = {}
    for _, _, m, _ in rows:
        want[m // 60] = want.get(m // 60, 0) + 1
    assert told(out) == sorted((minute(h * 60), minute(h * 60 + 60), n) for h, n in want.items() if h * 60 + 60 <= seen)
    again = drain(hours(table.stream()), str(tmp_path / "run"))
    assert told(again) == told(out)  # nothing new, nothing twice


def test_batch_windows_come_at_once(spark):
    rows = spark.createDataFrame([(minute(m),) for m in (0, 30, 61, 62, None)], "at timestamp_ntz")
    assert told(hours(rows)) == [(minute(0), minute(60), 2), (minute(60), minute(120), 2)]
    sessions = event_windows(rows, "at", "1 hour", [F.count("*").alias("n")], gap="30 minutes")
    assert told(sessions) == [(minute(0), minute(60), 2), (minute(61), minute(92), 2)]
    with pytest.raises(ValueError):
        event_windows(rows, "at", "1 hour", [F.count("*")])


def test_windows_do_not_follow_the_time_zone(spark):
    rows = spark.createDataFrame([(minute(10),)], "at timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = told(hours(rows))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(minute(0), minute(60), 1)]


def visits(rows, steps, gap, until):
    out = []
    for user in {u for _, u, _, _ in rows if u is not None}:
        visit = None
        for m, step in [*sorted((m, s) for _, u, m, s in rows if u == user and m is not None), (10**9, "")]:
            if visit and m - visit[1] > gap:
                if visit[1] + gap < until:
                    out.append((user, minute(visit[0]), minute(visit[1]), visit[2], visit[3]))
                visit = None
            visit = visit or [m, m, 0, 0]
            visit[1:3] = [m, visit[2] + 1]
            if visit[3] < len(steps) and step == steps[visit[3]]:
                visit[3] += 1
    return sorted(out)


def test_funnels_of_rows_out_of_order_and_a_restart(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, r.randrange(4), k * 3 + r.randrange(-20, 20), r.choice("abcx")) for k in range(300)]
    rows += [(900, None, 30, "a"), (901, 1, None, "a")]
    table = Folder(spark, tmp_path / "t")
    for k in range(0, len(rows), 80):
        table.add(rows[k : k + 80])
        out = drain(funnels(table.stream(), "user", "at", "step", ("a", "b", "c"), 600, "60 minutes"), str(tmp_path / "run"), settings=ROCKSDB)
    until = max(m for _, _, m, _ in rows if m is not None) - 60
    got = told(out)
    assert got == visits(rows, "abc", 10, until) and len({n for *_, n in got}) == 4


def test_interval_join_evicts_and_keeps_the_unmatched(spark, tmp_path):
    table = Folder(spark, tmp_path / "t")
    rows = []
    for k in range(6):
        part = [(k * 10 + i, i % 2, k * 240 + i * 20, "ab"[i % 3 == 0]) for i in range(8)]
        rows += part
        table.add(part)
    side = lambda step, name: table.stream().where(F.col("step") == step).select("user", F.col("id").alias(name), F.col("at").alias(f"{name}_at"))
    joined = interval_join(side("a", "x"), side("b", "y"), "x_at", "y_at", ("user",), "0 minutes", "30 minutes", "10 minutes", "10 minutes", how="left_outer")
    out = drain(joined.select("user", "x", "y"), str(tmp_path / "run"))
    pairs = [(u, i, j) for i, u, m, s in rows for j, v, n, t in rows if (s, t) == ("a", "b") and u == v and 0 <= n - m <= 30]
    met = {i for _, i, _ in pairs}
    got = [tuple(r) for r in out.collect()]
    assert sorted(r for r in got if r[2] is not None) == sorted(pairs)
    alone = {i for i, _, m, s in rows if s == "a" and i not in met}
    left = {r[1] for r in got if r[2] is None}
    assert left <= alone and {i for i in alone if i < 50} <= left  # those of the last file wait for the watermark
    assert max(s.numRowsTotal for p in out.progress for s in p.stateOperators) < 20 < len(rows)


def test_repeats_and_late_rows(spark, tmp_path):
    table = Folder(spark, tmp_path / "t")
    table.add([(1, 1, 0, "a"), (1, 1, 0, "a"), (2, 1, 10, "a"), (None, 1, 10, "a"), (None, 1, 12, "a")])
    table.add([(1, 1, 25, "a"), (2, 1, 10, "a"), (3, 1, 40, "a")])  # repeats over batches, one of them later than its first
    table.add([(4, 1, 300, "a")])  # the watermark goes to 4:00
    table.add([(5, 1, 301, "a")])
    table.add([(3, 1, 302, "a"), (6, 1, 20, "a")])  # 3 is long forgotten and comes anew, 6 is late
    out = drain(first_of_key(table.stream(), ("id",), "at", "60 minutes"), str(tmp_path / "run"))
    assert sorted((r.id or 0) for r in out.collect()) == [0, 1, 2, 3, 3, 4, 5]
    assert sum(s.numRowsDroppedByWatermark for p in out.progress for s in p.stateOperators) == 1
    assert min(s.numRowsTotal for s in out.progress[-1].stateOperators) < 4
    rows = spark.createDataFrame([(1, minute(0)), (1, minute(9))], "id long, at timestamp_ntz")
    assert first_of_key(rows, ("id",), "at", "1 hour").count() == 1


def test_complete_mode_keeps_the_last_result(spark, tmp_path):
    table = Folder(spark, tmp_path / "t")
    for k in range(3):
        table.add([(k, 1, k, "a")])
    counts = table.stream().groupBy("user").agg(F.count("*").alias("n"))
    assert told(drain(counts, str(tmp_path / "run"), mode="complete")) == [(1, 3)]


def test_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="yarn", getConf=lambda: SimpleNamespace(get=lambda *_: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=sc))
