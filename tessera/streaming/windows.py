"""Event-time windows of a stream: tumbling, sliding and by session, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.streaming.tables import clock, event_time


def event_windows(events: DataFrame, time_col: str, delay: str, aggs: list[Column], by: tuple[str, ...] = (), size: str | None = None, slide: str | None = None, start: str | None = None, gap: str | Column | None = None) -> DataFrame:
    """by, window_start, window_end (first and last end, the latter excluded) and aggs for each window with rows.

    size: the length of tumbling windows; with slide, a window of that length begins at each slide; start: an offset of the
    grid from 1970-01-01. gap: sessions instead, which end where no row follows within the gap (rows exactly one
    gap apart are one session); a column gives each row a gap of its own.

    A row that comes when the watermark, the largest time seen less `delay`, has passed its window counts no more. On
    a stream in append mode a window comes once, when the watermark has passed its end: windows that end after the
    last watermark stay in the state, to come when later rows have moved it on. On a table all windows come at once.
    Rows with a null time belong to no window. State is bounded by the windows that are open within the delay.
    """
    if (size is None) == (gap is None):
        raise ValueError("give a size or a gap")
    rows = event_time(events, time_col).where(F.col(time_col).isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark(time_col, delay)
    window = F.session_window(time_col, gap) if gap is not None else F.window(time_col, size, slide, start)
    out = rows.groupBy(*by, window.alias("window")).agg(*aggs)
    named = [c for c in out.columns if c != "window"]
    return out.select(*named[: len(by)], clock(F.col("window.start")).alias("window_start"), clock(F.col("window.end")).alias("window_end"), *named[len(by) :])
