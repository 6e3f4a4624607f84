"""Repeats on a stream: one row of each key within the watermark's delay."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.streaming.tables import event_time


def first_of_key(rows: DataFrame, keys: tuple[str, ...], time_col: str, delay: str) -> DataFrame:
    """rows without those that repeat the keys of a row that came before, as deliveries at least once do.

    A key is known until the watermark, the largest time seen less `delay`, has passed its first row by the delay, so two
    rows of a key whose times are at most `delay` apart never both come; state is bounded by the keys of about two delays.
    Of repeats within one batch any one may come, so the columns that are no keys should be alike in repeats. A row that
    comes when the watermark has passed it is dropped as late. Null keys are keys like any other. On a table, one row of each key.
    """
    timed = event_time(rows, time_col)
    if not rows.isStreaming:
        return timed.dropDuplicates(list(keys))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))
