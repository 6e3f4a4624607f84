"""Span summaries against brute force and range_incidents against its SQL, with nulls, ties and repeated keys."""

import datetime
import random

import duckdb
import pytest

from tessera.operators import span_summary as S
from tessera.plans import temporal


def brute(spans, points, width):
    out = {}
    for key in {k for k, at in spans if at is not None}:
        met = [(item, owner) for k, since in spans if k == key and since is not None for at, owner, item in points if at is not None and since <= at < since + width]
        if met:
            items = [item for item, _ in met if item is not None]
            out[key] = (len(met), len({owner for _, owner in met if owner is not None}), min(items, default=None), max(items, default=None))
    return out


@pytest.mark.parametrize("stretch", [1, 2, 72])
@pytest.mark.parametrize("owners, times, width", [(3, 60, 7), (40, 60, 7), (2, 400, 10), (1, 12, 5), (5, 30, 1)])
def test_spans(spark, monkeypatch, stretch, owners, times, width):
    monkeypatch.setattr(S, "STRETCH", stretch)
    r = random.Random(owners + stretch)
    pick = lambda x: None if r.random() < 0.07 else x
    spans = [(pick(k), pick(r.randrange(-times, times))) for k in range(60)]
    spans += [spans[5], spans[6], (7, -times), (7, times // 2), (8, spans[8][1])]
    points = [(pick(r.randrange(-times, times)), pick(r.randrange(owners)), pick(r.randrange(1000))) for _ in range(150)]
    a = spark.createDataFrame(spans, "id long, since long").repartition(3)
    b = spark.createDataFrame(points, "at long, who long, item long").repartition(3)
    got = S.span_summary(a, b, "id", "since", width, "at", "who", "item")
    assert got.columns == ["id", "n", "owners", "least", "largest"]
    assert {row[0]: tuple(row[1:]) for row in got.collect()} == brute(spans, points, width)


def test_spans_of_nothing(spark):
    a, b = spark.createDataFrame([(1, 5)], "id long, since long"), spark.createDataFrame([(5, 1, 9)], "at long, who long, item long")
    assert S.span_summary(a, b, "id", "since", 3, "at", "who", "item").collect() == [(1, 1, 1, 9, 9)]
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert S.span_summary(x, y, "id", "since", 3, "at", "who", "item").collect() == []


def events(folder, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, 1, '{}')", rows)
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return con


def test_incidents_of_odd_rows(spark, tmp_path):
    r = random.Random(7)
    pick = lambda x: None if r.random() < 0.05 else x
    minute = lambda: datetime.datetime(1969, 12, 31, 22) + datetime.timedelta(minutes=r.randrange(300), microseconds=r.choice([-1, 0, 0, 1]))
    con = events(tmp_path, [(pick(r.randrange(250)), pick(minute()), pick(r.randrange(20)), pick(r.choice(["error", "view"]))) for _ in range(300)])
    want = con.execute(temporal.ORACLE_SQL["range_incidents"]).fetchall()
    got = temporal.range_incidents(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 80


def test_incidents_make_no_pairs(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events(tmp_path, [(k, start + datetime.timedelta(seconds=k), k % 7, "error" if k % 2 else "view") for k in range(100)])
    got = temporal.range_incidents(spark, str(tmp_path))
    assert {tuple(row) for row in got.collect()} == {(k, 100, 7, 0, 99) for k in range(1, 100, 2)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
