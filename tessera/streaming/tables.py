"""Tables read as streams, and streams run into tables.

A stream's place and state live in a folder that driver and executors share, so a lost executor costs a batch's tasks and a
restart of the driver goes on where the last committed batch ended.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings of a stream whose state is in RocksDB.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a folder of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, its files in the order of their times; all that are there make one batch unless files_per_batch is set."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())  # a stream reads folders only


def event_time(df: DataFrame, name: str) -> DataFrame:
    """df with a column of event time as watermarks need it: a timestamp_ntz becomes the timestamp of the same UTC clock."""
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return df
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    return df.withColumn(name, F.timestamp_micros(micros))


def clock(at: Column) -> Column:
    """The UTC clock of a timestamp as timestamp_ntz, whatever the session's time zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.unix_micros(at) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))


def drain(stream: DataFrame, folder: str | None = None, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it has written.

    folder: holds the results and the stream's state; a later call with the same folder and stream goes on from there, and
    returns what all calls have written. Modes other than append keep the last result only, of a folder of its own.
    settings: of this stream alone; the session has them while the stream starts.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out, schema = f"{folder}/out", stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", out)
    else:  # the whole result of each batch replaces the one before; a batch that is tried again does so once more
        writer = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    before = {k: spark.conf.get(k, None) for k in settings or ()}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        query = writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    written = spark.read.schema(schema).parquet(out)
    written.progress = query.recentProgress
    return written
