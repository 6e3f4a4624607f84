"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words of lower-cased UTF-8 bytes: the byte form of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Largest number of keys that one hot-key broadcast holds.
HOT_KEYS = 1000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text; only A-Z are lower-cased. Null has no words."""
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode only) one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir()
    if found is not None and not isinstance(found, str):  # a Scala Option
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def materialise(df: DataFrame, **seen: Column) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. The files go by drop(), or when the application ends.

    seen: aggregates that are taken on the way; `seen_on_the_way` of what is returned has their values.
    """
    spark, schema = df.sparkSession, df.schema
    watch = Observation() if seen else None
    if watch:
        df = df.observe(watch, *(c.alias(k) for k, c in seen.items()))
    out = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the shuffle files go with the write, not when the driver collects garbage
    try:
        df.write.parquet(out)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    store, path = _hadoop(spark, out)
    store.deleteOnExit(path)
    written = spark.read.schema(schema).parquet(out)
    written._tessera_path = out
    written.seen_on_the_way = watch.get if watch else {}
    return written


def _hadoop(spark: SparkSession, name: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop(*written: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads again."""
    for df in written:
        store, path = _hadoop(df.sparkSession, df._tessera_path)
        store.delete(path, True)


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """fn for mapInArrow that gives freed memory back when its task ends, as Python workers serve many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only this C library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def rows_out(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a string column holds about `limit` bytes in each; a longer value comes alone."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def text_blocks(rows: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """(id, text) of all rows in blocks of at most `limit` bytes of text (one row at least), one in the driver at a time; no rows: one empty block."""
    block, size = [], 0
    for name, text, n in rows.select(id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0))).toLocalIterator():
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += n
    yield block


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, total: int | None = None) -> DataFrame:
    """Left join of rows with one row per key, where a key may hold a third of all rows.

    `groups` has the unique column `key` and `size`, the number of rows of the key; total: their sum, if known. Keys over a
    thousandth of the grouped rows are fewer than HOT_KEYS: they are broadcast, and their rows are spread
    by `spread` (a string column; null values are dealt evenly) over the shuffle that serves the other keys.
    """
    total = (groups.agg(F.sum(size)).first()[0] or 0) if total is None else total
    limit = max(HOT_KEYS, total // HOT_KEYS)
    own = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).select(F.col(key).alias("_hot_key"), F.struct(*own).alias("_hot_row"))
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_cold_key"), F.struct(*own).alias("_cold_row"))
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    first = first.withColumn("_route", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("s"), F.coalesce(spread, F.monotonically_increasing_id().cast("string")))))
    out = first.join(cold.withColumn("_cold_key", F.concat(F.lit("k"), F.col("_cold_key").cast("string"))), F.col("_route") == F.col("_cold_key"), "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"_hot_row.{c}"), F.col(f"_cold_row.{c}")).alias(c) for c in own))
