"""Retention sweeps as DataFrames: what goes, and what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TERMINAL


def cutoff(now: Column, hours: int) -> Column:
    return now - F.expr(f"INTERVAL {int(hours)} HOURS")


def expired_jobs(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Jobs that have ended and weren't touched for so long. Running ones never expire."""
    return jobs.where(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < cutoff(now, hours)))


def live_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("cancel_requested") & ~F.col("status").isin(*TERMINAL))


def expired_uploads(uploads: DataFrame, jobs: DataFrame, now: Column, upload_hours: int = 24, report_hours: int = 24) -> DataFrame:
    """Old uploads that no running job and no fresh report protects."""
    protects = ~F.col("status").isin(*TERMINAL) | (F.col("report").isNotNull() & (F.col("updated_at") >= cutoff(now, report_hours)))
    kept = jobs.where(protects).select("upload_id")
    return uploads.where(F.col("updated_at") < cutoff(now, upload_hours)).join(kept, "upload_id", "left_anti")


def orphan_objects(objects: DataFrame, uploads: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Old objects that no upload names."""
    return objects.where(F.col("last_modified") < cutoff(now, hours)).join(uploads.select(F.col("storage_key").alias("key")), "key", "left_anti")


def sweep(jobs: DataFrame, uploads: DataFrame, objects: DataFrame, now: Column, upload_hours: int = 24, report_hours: int = 24, object_hours: int = 24) -> dict[str, DataFrame]:
    """The tables after a sweep, its counts, and what went: jobs first, as their going unprotects uploads.

    Jobs of gone uploads go too, but are not among the counted jobs; cascaded has them.
    """
    gone_jobs = expired_jobs(jobs, now, report_hours).select("job_id")
    jobs1 = jobs.join(gone_jobs, "job_id", "left_anti")
    gone_uploads = expired_uploads(uploads, jobs1, now, upload_hours, report_hours).select("upload_id", "storage_key")
    uploads1 = uploads.join(gone_uploads.select("upload_id"), "upload_id", "left_anti")
    gone_objects = orphan_objects(objects, uploads1, now, object_hours).select("key").union(gone_uploads.select("storage_key")).distinct()
    cascaded = jobs1.join(gone_uploads.select("upload_id"), "upload_id", "left_semi").select("job_id", "upload_id")
    counts = None
    for name, df in (("jobs", gone_jobs), ("uploads", gone_uploads), ("objects", gone_objects)):
        one = df.agg(F.count("*").alias("removed")).select(F.lit(name).alias("kind"), "removed")
        counts = one if counts is None else counts.unionByName(one)
    left = jobs1.join(gone_uploads.select("upload_id"), "upload_id", "left_anti")
    return {"jobs": left, "uploads": uploads1, "objects": objects.join(gone_objects, "key", "left_anti"), "counts": counts, "cascaded": cascaded, "gone_objects": gone_objects}


def cascade_counts(swept: dict[str, DataFrame]) -> DataFrame:
    """The counts of a sweep, with the jobs that went because their upload did as a kind of their own."""
    return swept["counts"].unionByName(swept["cascaded"].agg(F.count("*").alias("removed")).select(F.lit("cascaded jobs").alias("kind"), "removed"))
