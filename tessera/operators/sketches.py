"""Sketches that are stored by fine groups and rolled up to coarse ones without the rows.

Three kinds, each a column of a few KB that Spark aggregates before it shuffles and merges in any order:

* distinct: HyperLogLog with 2 ** LOG_REGISTERS registers; the relative standard error of a count is 1.04 / sqrt(registers).
* quantiles: KLL; the rank of an estimated quantile is off by RANK_ERROR at most, at 99 % confidence.
* top: frequent items; a count is short or over by at most rows / (0.75 * TRACKED), so every item above that share is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_REGISTERS, KLL_K, TRACKED = 14, 200, 1024
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2), 0.0165
KINDS = ("distinct", "quantiles", "top")


def _checked(specs: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    for name, (kind, _) in specs.items():
        if kind not in KINDS:
            raise ValueError(f"{name}: {kind!r} is none of {KINDS}")
    return specs


def sketch(rows: DataFrame, by: tuple[str, ...], specs: dict[str, tuple[str, str]]) -> DataFrame:
    """by, n (rows of the group), and a sketch for each of specs: name -> (kind, column). Nulls of a column are not sketched."""

    def one(kind: str, column: str) -> Column:
        if kind == "distinct":
            return F.hll_sketch_agg(column, LOG_REGISTERS)
        if kind == "quantiles":
            return F.kll_sketch_agg_double(F.col(column).cast("double"), KLL_K)
        return F.expr(f"approx_top_k_accumulate(`{column}`, {TRACKED})")

    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(one(kind, column).alias(name) for name, (kind, column) in _checked(specs).items()))


def roll_up(sketches: DataFrame, by: tuple[str, ...], specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Sketches of the groups `by`, of columns of sketches (which may be computed from those it was made by); the same columns as sketch gives."""

    def one(kind: str, name: str) -> Column:
        if kind == "distinct":
            return F.hll_union_agg(name)
        if kind == "quantiles":
            return F.kll_merge_agg_double(name)
        return F.expr(f"approx_top_k_combine(`{name}`, {TRACKED})")

    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *(one(kind, name).alias(name) for name, (kind, _) in _checked(specs).items()))


def estimates(sketches: DataFrame, specs: dict[str, tuple[str, str]], ranks: tuple[float, ...] = (0.25, 0.5, 0.75), k: int = 10) -> DataFrame:
    """Sketches replaced by what they say: a count, an array of the quantiles at `ranks` (null without values), the k most frequent (item, count)."""

    def one(kind: str, name: str) -> Column:
        if kind == "distinct":
            return F.hll_sketch_estimate(name)
        if kind == "quantiles":
            some = F.kll_sketch_get_n_double(name) > 0
            return F.when(some, F.array(*(F.kll_sketch_get_quantile_double(name, F.lit(float(r))) for r in ranks)))
        return F.expr(f"approx_top_k_estimate(`{name}`, {k})")

    return sketches.withColumns({name: one(kind, name) for name, (kind, _) in _checked(specs).items()})
