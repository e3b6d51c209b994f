"""Checks of stored rows: usage, jobs, uploads, prices and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TERMINAL, eta

#: Fixed value: how long fetched prices count as fresh, in seconds.
PRICE_TTL = 3600


def _broken(df: DataFrame, keys: tuple[str, ...], rules: dict[str, Column]) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.select(*keys, F.explode(hits).alias("rule"))


def usage_violations(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule) of usage rows whose total isn't prompt and completion, or whose cache tokens exceed the prompt."""
    cache = F.coalesce("cached_tokens", F.lit(0)) + F.coalesce("cache_write_tokens", F.lit(0))
    return _broken(rows, keys, {"total": F.col("total_tokens") != F.col("prompt_tokens") + F.col("completion_tokens"), "cache": cache > F.col("prompt_tokens")})


def job_violations(jobs: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule): exactly failed jobs have an error, and ended jobs have no estimate of the time left."""
    failed = F.col("status") == "failed"
    return _broken(jobs, keys, {"error missing": failed & F.col("error").isNull(), "error": ~failed & F.col("error").isNotNull(), "estimate": F.col("status").isin(*TERMINAL) & F.col("estimated_seconds_remaining").isNotNull()})


def upload_violations(uploads: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule): exactly ready uploads have a profile, and exactly failed ones an error."""
    ready, failed = F.col("status") == "ready", F.col("status") == "failed"
    profile, error = F.col("profile").isNotNull(), F.col("error").isNotNull()
    return _broken(uploads, keys, {"profile": profile != ready, "error": error != failed})


def whitelisted(requests: DataFrame, catalog: DataFrame, model: str = "model") -> DataFrame:
    """The requests whose model the catalog lists."""
    return requests.join(catalog.select(F.col("model_id").alias(model)).distinct(), model, "left_semi")


def is_fresh(prices: DataFrame, now: Column, ttl: int = PRICE_TTL, by: tuple[str, ...] = ()) -> DataFrame:
    """([by,] fresh): the oldest of the known times of prices lies within ttl seconds; false if none is known.

    One row, or one for each of the groups asked for.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp(F.min("updated_at"))
    return prices.groupBy(*by).agg(F.coalesce(age <= ttl, F.lit(False)).alias("fresh"))


def guarded_report(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """jobs with the reports of those that still run and aren't cancelled: completed, with their report.

    The condition of a guarded update as a join: a report for a job that has ended, was
    cancelled or is gone changes nothing. reports: (job_id, report), one for each job.
    """
    new = reports.select("job_id", F.col("report").alias("_report"))
    live = ~F.col("status").isin(*TERMINAL) & ~F.coalesce("cancel_requested", F.lit(False)) & F.col("_report").isNotNull()
    rest = [c for c in jobs.columns if c not in ("status", "report")]
    return jobs.join(new, "job_id", "left").select(*rest, F.when(live, "completed").otherwise(F.col("status")).alias("status"), F.when(live, F.col("_report")).otherwise(F.col("report")).alias("report"))


def catalog_of(payloads: DataFrame, column: str = "payload", most_bytes: int = 20 << 20) -> DataFrame:
    """(model_id, prompt, completion, input_cache_read, input_cache_write) of captured catalog responses.

    A payload that is too large, no JSON, or without a list of data raises an error. Prices stay
    texts; cost.prices decides which are valid. Entries without a text id are passed over.
    """
    body = F.col(column)
    value = F.try_parse_json(body)
    data = F.try_variant_get(value, "$.data", "array<variant>")
    checked = F.when(F.octet_length(body) > most_bytes, F.raise_error(F.lit("the catalog is larger than allowed"))).when(data.isNull(), F.raise_error(F.lit("the catalog has no list of data"))).otherwise(data)
    item = payloads.select(F.explode(checked).alias("_i"))
    of = lambda path: F.try_variant_get("_i", path, "string")
    named = item.where(F.schema_of_variant(F.try_variant_get("_i", "$.id", "variant")) == "STRING")
    return named.select(of("$.id").alias("model_id"), *[of(f"$.pricing.{c}").alias(c) for c in ("prompt", "completion", "input_cache_read", "input_cache_write")])


def job_view(jobs: DataFrame, now: Column) -> DataFrame:
    """What is shown of a job: seven fields, the time that is left reckoned from its progress."""
    return jobs.select("analysis_id", "status", "progress", "created_at", "updated_at", eta(F.col("status"), F.col("progress"), F.col("created_at"), now).alias("estimated_seconds_remaining"), "error")
