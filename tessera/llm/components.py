"""Distributed connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import drop, join_groups, materialise

MAX_ROUNDS = 60


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m, degree) with m the smallest of u and its v. Counts pairs, and nodes (`open`) by which the pairs are not yet stars around their smallest node."""
    smaller, larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("degree"), smaller.alias("smaller"), larger.alias("larger"))
    return materialise(least, pairs=F.sum("degree"), open=F.count_if((F.col("smaller") > 1) | ((F.col("smaller") > 0) & (F.col("larger") > 0))))


def _nearest(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Adds m, the smallest of u and its v, to each pair; a hub u may hold a third of all pairs."""
    return join_groups(pairs, least.select("u", "m", "degree"), "u", "degree", F.col("v").cast("string"), least.seen_on_the_way.get("pairs") or 0)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node of it.

    Edges may repeat, run either way and be loops; a null end drops the edge (a loop alone names its node).
    Rounds are logarithmic in the longest path and end as soon as every component is a star; each is written to the
    shared folder, so a lost executor costs at most one round; the tables of a round go when the next stands.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    # u >= v in all that follows, and u > v after the first round
    now = materialise(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), loops=F.count_if(F.col("u") == F.col("v")))
    loops = [materialise(now.where("u = v"))] if now.seen_on_the_way.get("loops") else []
    for _ in range(MAX_ROUNDS):
        pairs = now.where("u <> v")
        either = pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = _least(either)
        if not least.seen_on_the_way.get("open"):
            drop(least)
            break
        # a larger end of each pair goes to the smallest node around the other end; repeats stay, there are no more than pairs
        large = materialise(_nearest(either, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        drop(now, least)
        least = _least(large)
        star = _nearest(large, least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = materialise(star.where("u <> v").distinct())
        drop(large, least)
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v"))
    for own in loops:
        named = named.union(own)
    return named.groupBy("node").agg(F.min("component").alias("component"))
