"""Range join: pairs of rows whose intervals overlap, found through bins that fit the intervals' lengths.

Without it Spark joins on inequalities by comparing every row with every row. Here an interval has a level by its
length, bins of a level are at least as wide as its intervals, so an interval lies in two bins of its own level at most. Of two
intervals the shorter one goes to the bins of the longer one's level: a row is copied to at most two bins for each
level that the other side has, however long the intervals are, and short ones never meet in wide bins. Bins are joined by
hash; a pair that shares two bins counts in the bin where its overlap begins. Crowded bins are split by adaptive
execution, as in any equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of a level are BASE times as wide as those of the level below.
BASE = 4
#: Bins are numbered exactly up to 2 ** PLACES.
PLACES = 52


def range_join(
    left: DataFrame,
    right: DataFrame,
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    by: tuple[str, ...] = (),
    closed: str = "both",
    how: str = "inner",
    left_key: tuple[str, ...] = (),
    suffix: str = "_right",
) -> DataFrame:
    """All columns of left, then those of right but `by`, for each pair of overlapping intervals; a name that left has too gets the suffix.

    left_range, right_range: names of the first and last end; the same name twice for points. by: columns that must be equal.
    closed: with "both", intervals hold both ends; with "left", all but the last end (a point holds itself).
    how: "left" adds the left rows that meet none, told by `left_key`, columns that name a row of left; rows of one key count as one.
    Ends are numbers, dates, timestamps or timestamp_ntz, infinite ones too; intervals with a null or NaN end or with the
    last end before the first are empty and meet nothing, as are rows with a null in `by`.
    """
    if closed not in ("both", "left") or how not in ("inner", "left") or (how == "left" and not left_key):
        raise ValueError(f"closed {closed!r}, how {how!r}, left_key {left_key!r}")
    keys = [f"_key{k}" for k in range(len(by))]
    a, b = (_intervals(side, by, keys, ends, name) for side, ends, name in ((left, left_range, "_left"), (right, right_range, "_right")))
    both = a.select("_lo", "_hi", F.lit(0).alias("_of")).unionByName(b.select("_lo", "_hi", F.lit(1).alias("_of")))
    far = both.select(F.explode(F.array(*(F.abs(F.col(c).cast("double")) for c in ("_lo", "_hi")))).alias("x")).where("x < double('infinity')").agg(F.max("x")).first()[0] or 1.0
    least = math.ceil(math.log(far, BASE)) - PLACES * math.log(2, BASE)
    seen = both.select("_of", _level(far, None).alias("level")).distinct().collect()  # a level for each doubling of double's exponent at most
    floor = max(min((r.level for r in seen if r.level is not None), default=0), math.ceil(least))
    levels = [sorted({max(floor if r.level is None else r.level, floor) for r in seen if r["_of"] == k}) for k in (0, 1)]
    own = _level(far, floor)
    a, b = (x.withColumn("_level", own) for x in (a, b))
    # the longer side (left, if they are alike) keeps its level, the other one comes to it
    placed_a = _placed(a, {0: F.array("_level"), 1: F.filter(_array(levels[1]), lambda x: x > F.col("_level"))}, far, "_a")
    placed_b = _placed(b, {0: F.filter(_array(levels[0]), lambda x: x >= F.col("_level")), 1: F.array("_level")}, far, "_b")
    on = [*keys, "_turn", "_at", "_bin"]
    begins = F.greatest("_lo_a", "_lo_b")
    meets = (F.col("_lo_a") <= F.col("_hi_b")) & (F.col("_lo_b") <= F.col("_hi_a"))
    if closed == "left":
        meets = ((F.col("_lo_a") < F.col("_hi_b")) & (F.col("_lo_b") < F.col("_hi_a"))) | (F.col("_lo_a") == F.col("_lo_b"))
    rows = placed_a.join(placed_b, on).where(meets & (F.col("_bin") == _bin(begins, F.col("_at"), far)))
    taken = [c for c in right.columns if c not in by]
    named = [F.col(f"_right.{_tick(c)}").alias(c + suffix if c in left.columns else c) for c in taken]
    out = rows.select(*(F.col(f"_left.{_tick(c)}").alias(c) for c in left.columns), *named)
    if how == "left":
        met = out.select(*(F.col(_tick(c)).alias(f"_met{k}") for k, c in enumerate(left_key))).distinct()
        same = [F.col(_tick(c)).eqNullSafe(F.col(f"_met{k}")) for k, c in enumerate(left_key)]
        out = out.unionByName(left.join(met, same, "left_anti"), allowMissingColumns=True)
    return out


def _tick(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _number(side: DataFrame, name: str) -> Column:
    kind, at = side.schema[name].dataType, F.col(_tick(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), at)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at)
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("long")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return at.cast("double")
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{kind} is no end of an interval")
    return at if isinstance(kind, T.DecimalType) else at.cast("long")


def _intervals(side: DataFrame, by: tuple[str, ...], keys: list[str], ends: tuple[str, str], name: str) -> DataFrame:
    """Keys, _lo, _hi and the row; intervals that hold something only."""
    lo, hi = (_number(side, c) for c in ends)
    whole = F.struct(*(F.col(_tick(c)).alias(c) for c in side.columns))
    rows = side.select(*(F.col(_tick(c)).alias(k) for c, k in zip(by, keys)), lo.alias("_lo"), hi.alias("_hi"), whole.alias(name))
    kept = (F.col("_lo") <= F.col("_hi")) & ~F.isnan(F.col("_hi").cast("double"))
    for k in keys:
        kept &= F.col(k).isNotNull()
    return rows.where(kept)


def _finite(x: Column, far: float) -> Column:
    """x as a double between -far and far, in the order of x: what bins are counted on."""
    return F.least(F.greatest(x.cast("double"), F.lit(-far)), F.lit(far))


def _level(far: float, floor: int | None) -> Column:
    """The least level whose bins are as wide as the interval, null for a point; not below the floor."""
    length = _finite(F.col("_hi"), far) - _finite(F.col("_lo"), far)
    level = F.when(length > 0, F.ceil(F.log(float(BASE), length)).cast("int"))
    return level if floor is None else F.greatest(F.coalesce(level, F.lit(floor)), F.lit(floor))


def _bin(x: Column, level: Column, far: float) -> Column:
    return F.floor(_finite(x, far) / F.pow(F.lit(float(BASE)), level)).cast("long")


def _array(levels: list[int]) -> Column:
    return F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")


def _placed(rows: DataFrame, turns: dict[int, Column], far: float, side: str) -> DataFrame:
    """rows once for each bin of each level; turn 0: left keeps its level, turn 1: right does."""

    def named(turn: int) -> Callable[[Column], Column]:
        return lambda level: F.struct(F.lit(turn).alias("_turn"), level.alias("_at"))

    at = F.flatten(F.array(*(F.transform(levels, named(turn)) for turn, levels in turns.items())))
    each = rows.select("*", F.inline(at)).drop("_level")
    bins = F.sequence(_bin(F.col("_lo"), F.col("_at"), far), _bin(F.col("_hi"), F.col("_at"), far))
    return each.withColumn("_bin", F.explode(bins)).withColumnsRenamed({"_lo": f"_lo{side}", "_hi": f"_hi{side}"})
