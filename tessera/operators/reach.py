"""Recursive reach over edges: the fewest steps from each start to each node, by semi-naive rounds.

A round joins only what the round before found with the edges, and keeps what is new; it is written to the folder that
driver and executors share, so the plan stays short and a lost executor costs a round. Rounds end when nothing is new, or
at the bound on steps, whichever comes first, so cycles end too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.streaming.tables import shared_folder


def reach(edges: DataFrame, start_col: str, end_col: str, max_steps: int, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, steps) for each node that at least one and at most max_steps edges lead to from a start.

    starts: one column, the nodes to start from; without it every node that has an edge out. A start that a cycle leads back
    to is reached as any node. Edges may repeat; those with a null end lead nowhere.
    """
    if max_steps < 1:
        raise ValueError(f"max_steps {max_steps}")
    step = edges.select(F.col(start_col).alias("_from"), F.col(end_col).alias("node")).where("_from IS NOT NULL AND node IS NOT NULL").distinct()
    folder = f"{shared_folder(edges.sparkSession)}/reach-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return edges.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    step = written(step, "edges")
    new = step.select(F.col("_from").alias("start"), "node", F.lit(1).alias("steps"))
    if starts is not None:
        new = new.join(starts.toDF("_start").distinct(), F.col("start") == F.col("_start"), "left_semi")
    new = found = written(new, "1")
    for k in range(2, max_steps + 1):
        if new.isEmpty():
            break
        further = new.select("start", F.col("node").alias("_at")).join(step, F.col("_at") == F.col("_from")).select("start", "node").distinct()
        new = written(further.join(found.select(F.col("start").alias("_s"), F.col("node").alias("_n")), (F.col("start") == F.col("_s")) & (F.col("node") == F.col("_n")), "left_anti").withColumn("steps", F.lit(k)), str(k))
        found = found.unionByName(new)
    return found
