"""Retention as a stream: every trigger sweeps what has expired until then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import retention as R

#: What each table is told by, and the kind of that column.
KEYS = {"jobs": ("job_id", "long"), "uploads": ("upload_id", "long"), "objects": ("key", "string")}


def removed(spark: SparkSession, log: str, kind: str, before: int | None = None) -> DataFrame:
    """Ids of a kind that sweeps have removed, those before a sweep if its number is given."""
    key, type_ = KEYS[kind]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{log}/{kind}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{key} {type_}, sweep int")
    rows = spark.read.schema(f"{key} {type_}, sweep int").parquet(f"{log}/{kind}")
    return rows if before is None else rows.where(F.col("sweep") < before)


def current(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], log: str, before: int | None = None) -> dict[str, DataFrame]:
    """The tables as they are now, rows that came meanwhile too, without what sweeps have removed."""
    return {kind: load().join(removed(spark, log, kind, before).select(KEYS[kind][0]), KEYS[kind][0], "left_anti") for kind, load in tables.items()}


def sweep_once(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], log: str, n: int, now: Column, **hours: int) -> None:
    """Sweep number n: appends the ids that go to the log, each kind under the sweep's number.

    A sweep that runs again sees the log as it was before it and replaces its own part, so a
    lost driver costs nothing. Jobs that go with their upload are logged with those that expired.
    """
    left = current(spark, tables, log, before=n)
    after = R.sweep(left["jobs"], left["uploads"], left["objects"], now, **hours)
    gone = {kind: left[kind].join(after[kind].select(KEYS[kind][0]), KEYS[kind][0], "left_anti").select(KEYS[kind][0]) for kind in KEYS}
    gone["objects"] = after["gone_objects"]
    for kind, ids in gone.items():
        ids.write.mode("overwrite").parquet(f"{log}/{kind}/sweep={n}")


def periodic_sweep(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], log: str, every: str = "1 hour", now: Callable[[], Column] = F.current_timestamp, **hours: int) -> StreamingQuery:
    """A stream that sweeps at every trigger, from a clock's ticks; stop() ends it, and its checkpoint below the log resumes it.

    tables gives jobs, uploads and objects afresh at each trigger.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=every).option("checkpointLocation", f"{log}/ticks").foreachBatch(lambda _, n: sweep_once(spark, tables, log, n, now(), **hours)).start()
