"""Intermediate tables in the folder that all executors share, and row numbers without one task that sees all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session, which is one process, may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/quern-tables"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df from a table that it is written to: computed once, whatever executors are lost, and without its lineage.

    by names a column whose values get folders of their own, so that reading one reads no other.
    """
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """df with each row's number in the order, from 1, or the sum of a column up to and with it.

    Rows are dealt by ranges of the order; each range numbers or sums its own, and what came before
    a range is the sum of one row for each of those.
    """
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_row", 33)
    if total is None:
        own = (F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name)
        counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        kind = "long"
    else:
        from pyspark.sql import Window

        own = F.sum(total).over(Window.partitionBy(part).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)).alias(name)
        counts = dealt.groupBy(part.alias("_part")).agg(F.sum(total).alias("_n"))
        kind = counts.schema["_n"].dataType.simpleString()
    so_far, offsets = None, []
    for r in sorted(counts.collect()):
        offsets.append((r["_part"], so_far))
        so_far = r["_n"] if so_far is None else so_far + (r["_n"] or 0)
    before = df.sparkSession.createDataFrame(offsets, f"_part long, _before {kind}")
    # One row for each range: as small as the number of tasks.
    out = dealt.select(*df.columns, part.alias("_part"), own).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0).cast(kind))).select(*df.columns, name)
