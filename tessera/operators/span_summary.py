"""Summaries of the points in each of many spans of one width, without pairs: how many, of how many owners, least and largest item.

Time is cut into blocks as wide as a span, so a span is the end of one block and the beginning of the next. Rows of a block
are read in order once from each end, with running counts, least and largest items; a span asks in both blocks, and its
two answers are added. An owner counts with the first of its points in a block from the beginning, and with the last
from the end; one in both parts counts once less: the span must then reach past its first point in the later block and
still hold its last one in the earlier block, which is an interval of span ends within the later block.
So there are at most two rows for a point and two for a span, however many points a span holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.range_join import _number, range_join

#: Blocks in which the points of one owner are put in order at once; those of the last block are also read with the next ones.
STRETCH = 72


def span_summary(spans: DataFrame, points: DataFrame, key: str, start: str, width: int, at: str, owner: str, item: str) -> DataFrame:
    """(key, n, owners, least, largest) of each key whose spans hold a point; a span holds `start` and all before `start` + `width`.

    width: in units of `start` and `at`, microseconds for timestamps. Points and spans without a time meet nothing; points without an
    owner count, but for no owner. Spans of one key are one group: a point counts in each of them, an owner once. Keys whose
    spans begin at different times are summed up from pairs.
    """
    spans = spans.select(F.col(key).alias("key"), _number(spans, start).alias("since")).where("since IS NOT NULL")
    points = points.select(_number(points, at).alias("at"), F.col(owner).alias("owner"), F.col(item).alias("item")).where("at IS NOT NULL")
    keys = spans.groupBy("key").agg(F.count("*").alias("times"), F.min("since").alias("since"), F.max("since").alias("latest"))
    out = _swept(keys.where("since = latest"), points, width)
    spread = keys.where("since < latest").select(F.col("key").alias("again"))
    if not spread.isEmpty():
        ends = spans.join(spread, F.col("key").eqNullSafe(F.col("again")), "left_semi").withColumn("until", F.col("since") + width)
        pairs = range_join(ends, points, ("since", "until"), ("at", "at"), closed="left")
        out = out.unionByName(pairs.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("owner").alias("owners"), F.min("item").alias("least"), F.max("item").alias("largest")))
    return out.withColumnRenamed("key", key)


def _block(x: Column, width: int) -> Column:
    return x - F.pmod(x, F.lit(width))


def _marked(points: DataFrame, width: int) -> DataFrame:
    """(block, at, n, item, opens, closes, shared): opens and closes mark the first and last point of an owner in its block, `shared` is
    1 where an owner is back within a width of the block before, and -1 where its point there leaves the spans."""
    block, own = _block(F.col("at"), width), _block(F.col("at"), width * STRETCH)
    known = points.where("owner IS NOT NULL")
    last = block == own + width * (STRETCH - 1)
    placed = known.withColumn("stretch", F.explode(F.when(last, F.array(own, own + width * STRETCH)).otherwise(F.array(own))))
    order = Window.partitionBy("owner", "stretch").orderBy("at")
    seen = placed.withColumns({"before": F.lag("at").over(order), "after": F.lead("at").over(order)}).where(F.col("stretch") == own).withColumn("block", block)
    opens = F.col("before").isNull() | (F.col("before") < F.col("block"))
    closes = F.col("after").isNull() | (F.col("after") >= F.col("block") + width)
    back = opens & (F.col("before") > F.col("at") - width)

    def row(at: Column, n: Column, item: Column, opens: Column, closes: Column, shared: Column) -> Column:
        named = {"at": at, "n": n, "item": item, "opens": opens, "closes": closes, "shared": shared}
        return F.struct(*(c.cast("int").alias(k) if k not in ("at", "item") else c.alias(k) for k, c in named.items()))

    no, one = F.lit(0), F.lit(1)
    here = row(F.col("at"), one, F.col("item"), opens, closes, F.coalesce(back, F.lit(False)))
    leaves = row(F.col("before") + width, no, F.lit(None).cast(points.schema["item"].dataType), no, no, F.lit(-1))
    rows = seen.select("block", F.inline(F.when(back, F.array(here, leaves)).otherwise(F.array(here))))
    nobody = points.where("owner IS NULL").select(block.alias("block"), F.inline(F.array(row(F.col("at"), one, F.col("item"), no, no, no))))
    return rows.unionByName(nobody)


def _swept(keys: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """keys: key, times, since; one row each."""
    block = _block(F.col("since"), width)
    asks = F.array(F.struct(block.alias("block"), F.col("since").alias("at"), F.lit(True).alias("tail")), F.struct((block + width).alias("block"), (F.col("since") + width).alias("at"), F.lit(False).alias("tail")))
    asked = keys.select("key", "times", F.inline(asks))
    # of one time, asking comes before the points: it is past them from the end, and before them from the beginning
    rows = _marked(points, width).withColumn("point", F.lit(1)).unionByName(asked.withColumn("point", F.lit(0)), allowMissingColumns=True)
    each = Window.partitionBy("block")
    up = each.orderBy("at", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = each.orderBy(F.desc("at"), F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = {"n": F.sum("n"), "owners": (F.sum(F.col("opens") - F.col("shared")), F.sum("closes")), "least": F.min("item"), "largest": F.max("item")}
    sides = {k: c if isinstance(c, tuple) else (c, c) for k, c in met.items()}
    read = rows.select("key", "times", "tail", "point", *(c.over(w).alias(f"{k}{s}") for k, both in sides.items() for s, (c, w) in enumerate(zip(both, (up, down)))))
    told = read.where("point = 0").select("key", "times", *(F.when(F.col("tail"), F.col(f"{k}1")).otherwise(F.col(f"{k}0")).alias(k) for k in sides))
    whole = told.groupBy("key").agg((F.sum("n") * F.max("times")).alias("n"), F.sum("owners").alias("owners"), F.min("least").alias("least"), F.max("largest").alias("largest"))
    return whole.where("n > 0")
