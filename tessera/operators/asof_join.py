"""As-of join: each left row with the right row of its keys that is next to it in time.

Both sides become one table of (keys, time), in which windows carry the last right row forward (or the next one
back); pairs of rows are never formed, so the cost is one shuffle and a sort of both sides together. A key that holds more than
1 / SHARE of all rows is cut into stretches of time by its own percentiles. Each stretch is a window of its own that starts
with the last right row of the stretches before it, found by an aggregate of one row per stretch; rows of one key
and one time are never cut apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys over 1 / SHARE of all rows, and MIN_ROWS at least, are cut; so there are fewer than SHARE, of as many stretches in all.
SHARE, MIN_ROWS = 1000, 100_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: tuple[str, ...] = (),
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance: Column | None = None,
    how: str = "left",
    tie_break: tuple[str, ...] = (),
    suffix: str = "_right",
    share: int = SHARE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """All columns of left, then those of right but `by`; a name that left has too gets the suffix.

    direction: "backward" takes the last right row at or before a left row's time, "forward" the first at or after it,
    "nearest" the closer of these two, the earlier one if both are as far. allow_exact=False passes over rows of the same time.
    tolerance: the largest distance in time of a match: a number, or an interval for dates and timestamps, as a literal.
    how: "left" keeps left rows without a match, with nulls; "inner" drops them.
    Of right rows of one key and time the largest by `tie_break` counts, then by its other sortable columns.
    A null time or key matches nothing on either side. Without `by` all rows are one key, cut in time as any other.
    """
    if direction not in ("backward", "forward", "nearest") or how not in ("left", "inner"):
        raise ValueError(f"direction {direction!r}, how {how!r}")
    if left.schema[left_on].dataType != right.schema[right_on].dataType:
        raise TypeError(f"times are {left.schema[left_on].dataType} and {right.schema[right_on].dataType}")
    keys = [f"_key{k}" for k in range(max(1, len(by)))]
    taken = [c for c in right.columns if c not in by]
    asked = _keyed(left, by, keys, left_on).withColumns({"_side": F.lit(1), "_left": F.struct(*map(_name, left.columns))})
    sorts = [*tie_break, *(c for c in taken if c not in tie_break and _sortable(right.schema[c].dataType))]
    given = _keyed(right, by, keys, right_on).withColumns({"_side": F.lit(0), "_tie": F.struct(*map(_name, sorts)), "_right": F.struct(F.col("_num").alias("_num"), *map(_name, taken))})
    given = given.select(*keys, "_num", "_side", "_tie", "_right")
    usable = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "_num"]))
    rows = asked.select(*keys, "_num", "_side", "_left").where(usable).unionByName(given.where(usable), allowMissingColumns=True)
    rows, cut = _slotted(rows, keys, share, min_rows)
    if direction != "forward":
        rows = _carried(rows, keys, cut, "_back", 1, allow_exact)
    if direction != "backward":
        rows = _carried(rows, keys, cut, "_next", -1, allow_exact)
    if direction == "nearest":
        later = F.col("_back").isNull() | (F.col("_next._num") - F.col("_num") < F.col("_num") - F.col("_back._num"))
        match = F.when(later & F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("_back"))
    else:
        match = F.col("_back" if direction == "backward" else "_next")
    rows = rows.where("_side = 1").select("_left", match.alias("_match"))
    if tolerance is not None:
        at, there = F.col(f"_left.{_tick(left_on)}"), F.col(f"_match.{_tick(right_on)}")
        rows = rows.withColumn("_match", F.when((there + tolerance >= at) & (at + tolerance >= there), F.col("_match")))
    if how == "inner":
        rows = rows.where("_match IS NOT NULL")
    else:
        lost = asked.where(~usable).select("_left")
        rows = rows.unionByName(lost, allowMissingColumns=True)
    names = [F.col(f"_match.{_tick(c)}").alias(c + suffix if c in left.columns else c) for c in taken]
    return rows.select(*(F.col(f"_left.{_tick(c)}").alias(c) for c in left.columns), *names)


def _tick(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _name(name: str) -> Column:
    return F.col(_tick(name)).alias(name)


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind)
    return not isinstance(kind, T.MapType | T.VariantType)


def _keyed(side: DataFrame, by: tuple[str, ...], keys: list[str], time: str) -> DataFrame:
    """side with its keys, and its time as a number."""
    kind, at = side.schema[time].dataType, F.col(_tick(time))
    if isinstance(kind, T.TimestampNTZType):
        at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), at)
    elif isinstance(kind, T.TimestampType):
        at = F.unix_micros(at)
    elif isinstance(kind, T.DateType):
        at = F.unix_date(at)
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"{kind} is no time")
    return side.withColumns({key: F.col(_tick(c)) for key, c in zip(keys, by)} if by else {keys[0]: F.lit(0)}).withColumn("_num", at)


def _slotted(rows: DataFrame, keys: list[str], share: int, min_rows: int) -> tuple[DataFrame, bool]:
    """rows with _slot, the number of the stretch of its key (null for keys that are not cut), and if any is cut."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = max(min_rows, (counts.agg(F.sum("_n")).first()[0] or 0) // share)
    hot = counts.where(F.col("_n") > limit).toArrow()  # fewer than `share` rows
    spark = rows.sparkSession
    if not hot.num_rows:
        return rows.withColumn("_slot", F.lit(None).cast("int")), False
    steps = [k / share for k in range(1, share)]
    own = rows.join(F.broadcast(spark.createDataFrame(hot)), keys)
    step = F.greatest(F.lit(1), F.floor(F.lit(share) * limit / F.col("_n"))).cast("int")  # so many percentiles make a stretch
    bounds = own.groupBy(*keys, "_n").agg(F.percentile_approx("_num", steps, 10 * share).alias("_all"))
    bounds = bounds.select(*keys, F.array_distinct(F.filter("_all", lambda x, k: (k + 1) % step == 0)).alias("_bounds")).toArrow()  # fewer than 2 * share numbers
    cut = rows.join(F.broadcast(spark.createDataFrame(bounds)), keys, "left")
    return cut.withColumn("_slot", F.size(F.filter("_bounds", lambda b: b < F.col("_num")))).withColumn("_slot", F.when(F.col("_bounds").isNotNull(), F.col("_slot"))).drop("_bounds"), True


def _carried(rows: DataFrame, keys: list[str], cut: bool, name: str, sign: int, allow_exact: bool) -> DataFrame:
    """rows with `name`: the last right row so far (sign 1), or the first to come (sign -1)."""
    if cut:
        here = F.col("_side") == 0
        last = F.max_by(F.when(here, F.col("_right")), F.when(here, F.struct(sign * F.col("_num"), "_tie"))).alias("_right")
        stretches = rows.where("_slot IS NOT NULL").groupBy(*keys, "_slot").agg(last)
        before = Window.partitionBy(*keys).orderBy(sign * F.col("_slot")).rowsBetween(Window.unboundedPreceding, -1)
        starts = stretches.withColumn("_right", F.last("_right", True).over(before)).where("_right IS NOT NULL").withColumn("_side", F.lit(0))
        rows = rows.unionByName(starts, allowMissingColumns=True)
    time = F.asc_nulls_first("_num") if sign == 1 else F.desc_nulls_first("_num")  # a start has no time
    side = F.asc("_side") if allow_exact else F.desc("_side")
    so_far = Window.partitionBy(*keys, "_slot").orderBy(time, side, F.asc_nulls_first("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last("_right", True).over(so_far)).where("_num IS NOT NULL")
