"""Stream-to-stream interval join: rows of equal keys whose times lie within bounds of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.streaming.tables import event_time


def interval_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: tuple[str, ...], at_least: str, at_most: str, left_delay: str, right_delay: str, how: str = "inner") -> DataFrame:
    """All columns of both sides for each pair with at_least <= right time - left time <= at_most (intervals as text, such as "0 seconds").

    Column names of the sides differ, but for `by`, which comes once. With bounds on both sides' times Spark evicts a row from the state
    as soon as no row of the other side can meet it before the watermark, so state holds some `at_most` and `at_least` of
    time, not the streams. how "left_outer": left rows that no right row can meet any more come with nulls, when the watermark has
    passed them. Rows with a null key or time meet nothing.
    """
    if how not in ("inner", "left_outer"):
        raise ValueError(f"how {how!r}")
    a, b = event_time(left, left_on), event_time(right, right_on)
    b = b.withColumnsRenamed({c: f"_{c}" for c in by})
    if a.isStreaming:
        a, b = a.withWatermark(left_on, left_delay), b.withWatermark(right_on, right_delay)
    within = F.expr(f"`{right_on}` >= `{left_on}` + INTERVAL {at_least} AND `{right_on}` <= `{left_on}` + INTERVAL {at_most}")
    for c in by:
        within = (F.col(c) == F.col(f"_{c}")) & within
    return a.join(b, within, how).drop(*(f"_{c}" for c in by))
