"""Token and cost estimates, and the chunks that records are sent in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from .tables import numbered, written

MAX_RECORDS, MAX_TOKENS = 120, 12_000


def sized(groups: DataFrame) -> DataFrame:
    """groups with the tokens of each as the prompt renders it."""
    context = F.col("context") if "context" in groups.columns else None
    return groups.withColumn("tokens", S.record_tokens(T.render_record(F.col("record_id"), F.col("redacted_text"), context)))


def chunks(groups: DataFrame, max_records: int = MAX_RECORDS, max_tokens: int = MAX_TOKENS, presized: bool = False) -> DataFrame:
    """Records with the chunk and position they are sent in, by falling count, then id.

    A chunk closes when it is full or the next record would overflow it; a record too large
    goes alone. Where a chunk closes depends on all before it, but not on how: only on where the
    open chunk began, and that is among the last records. So each range of the order makes a
    small map, from where its first chunk begins to where the next range's first chunk does;
    the maps are composed, and each range numbers its own records.
    """
    if presized:
        key, rows, order = "position", groups.select("position", F.col("tokens").cast("long").alias("tokens")), [F.col("position")]
    else:
        key, order = "record_id", [F.desc("count"), F.col("record_id")]
        rows = groups.withColumn("tokens", S.record_tokens(T.render_record(F.col("record_id"), F.col("text")))) if "tokens" not in groups.columns else groups
    numbered = chunk_numbers(rows.select(key, *(["count"] if not presized else []), F.col("tokens").cast("long").alias("tokens")), key, order, max_records, max_tokens)
    out = rows.join(numbered, key)
    return out if presized else out.withColumnRenamed("place", "position")


def chunk_numbers(rows: DataFrame, key: str, order: list[Column], max_records: int, max_tokens: int) -> DataFrame:
    """(key, chunk, place) of rows (key, tokens), dealt by ranges of the order.

    Of each range its first records' tokens and its map come to the driver: as many numbers as
    a chunk can have records. A task holds one range of (key, tokens).
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "tokens").withColumn("row", F.monotonically_increasing_id())
    held = written(dealt.select(key, "tokens", F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranges")
    least = held.agg(F.min("tokens")).first()[0]
    # A chunk that begins before a range ends within so many records of it.
    reach = max_records if not least or least < 1 else max(1, min(max_records, max_tokens // least + 1))
    heads = held.groupBy("part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("at") < reach, F.struct("at", "tokens")))).alias("head"))
    parts = sorted((r["part"], r["n"], [h["tokens"] for h in r["head"]]) for r in heads.collect())
    ahead: dict[int, list[int]] = {}
    after: list[int] = []
    for part, _, head in reversed(parts):
        ahead[part] = after
        after = [*head, *after][:reach] if len(head) < reach else head

    def begins(part: int, tokens: np.ndarray) -> np.ndarray:
        """For each record of a range where the next chunk begins if one begins at it; it may lie in the ranges that follow."""
        total = np.concatenate([[0], np.cumsum(np.concatenate([tokens, np.array(ahead[part], np.int64)]))])
        n = np.arange(len(tokens))
        fits = np.searchsorted(total, total[n] + max_tokens, side="right") - 1
        return np.maximum(n + 1, np.minimum(np.minimum(n + max_records, fits), len(total) - 1))

    def of_range(part, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = pdf.sort_values("at")["tokens"].to_numpy()
        n, entries = len(tokens), min(reach, len(tokens))
        after_, leaves, opened = begins(int(part[0]), tokens), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            j = after_[i]
            leaves[i], opened[i] = (leaves[j], opened[j] + 1) if j < n else (j - n, 1)
        return pd.DataFrame({"part": [part[0]], "leaves": [leaves[:entries].tolist()], "opened": [opened[:entries].tolist()]})

    maps = {r["part"]: (r["leaves"], r["opened"]) for r in held.groupBy("part").applyInPandas(of_range, "part long, leaves array<long>, opened array<long>").collect()}
    entry, chunk, place, starts = 0, 0, 0, {}
    for part, n, _ in parts:
        starts[part] = (entry, chunk, place)
        leaves, opened = maps[part]
        # A range that ends before the open chunk does passes it on.
        entry, chunk = (leaves[entry], chunk + opened[entry]) if entry < n else (entry - n, chunk)
        place += n

    def assigned(part, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        entry, chunk, place = starts[int(part[0])]
        tokens = pdf["tokens"].to_numpy()
        after_, first, i = begins(int(part[0]), tokens), np.zeros(len(tokens), np.int64), entry
        while i < len(tokens):
            first[i], i = 1, after_[i]
        return pd.DataFrame({key: pdf[key], "chunk": chunk - 1 + np.cumsum(first), "place": place + np.arange(len(tokens))})

    return held.groupBy("part").applyInPandas(assigned, f"{key} {rows.schema[key].dataType.simpleString()}, chunk long, place long")


def chunk_sizes(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("chunk").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))


def profile_chunk_sizes(records: int, tokens_each: int, max_records: int = MAX_RECORDS, max_tokens: int = MAX_TOKENS) -> list[int]:
    size = max(1, min(max_records, max(1, max_tokens // max(1, tokens_each))))
    full, rest = divmod(records, size)
    return [size] * full + ([rest] if rest else [])


def map_estimate(sizes: DataFrame, overhead_tokens: int) -> DataFrame:
    """(chunks, records, prompt_tokens, completion_tokens) of the map calls."""
    n, r = F.count("*"), F.coalesce(F.sum("records"), F.lit(0))
    return sizes.agg(n.alias("chunks"), r.alias("records"), (F.coalesce(F.sum("tokens"), F.lit(0)) + n * overhead_tokens).alias("prompt_tokens"), (n * S.MAP_BASE + r * S.MAP_PER_RECORD).alias("completion_tokens"))


def reduce_estimate(categories: int, overhead_tokens: int, retain: float, max_tokens: int = MAX_TOKENS) -> tuple[int, int]:
    """Prompt and completion tokens of merging so many categories in rounds, each keeping a share of them."""
    capacity = max(2, max_tokens // S.REDUCE_PROMPT_PER_CATEGORY)
    prompt = completion = 0
    while categories > 1:
        full, rest = divmod(categories, capacity)
        batches = full + (rest > 0)
        calls = full + (rest > 1)
        sent = full * capacity + (rest if rest > 1 else 0)
        if not calls:
            break
        prompt += overhead_tokens * calls + sent * S.REDUCE_PROMPT_PER_CATEGORY
        completion += S.REDUCE_BASE * calls + S.REDUCE_PER_CATEGORY * sent
        kept = max(batches, int(categories * retain + 0.999))
        if batches == 1 or kept >= categories:
            break
        categories = kept
    return prompt, completion


#: Rounds of merging for each share that a round keeps: what is left, and what the calls so far sent and got.
_ROUNDS = """
    WITH RECURSIVE start AS (
        SELECT explode(array({expected}D, {cautious}D)) AS retain, categories, prompt, completion, greatest(2, {max_tokens} DIV {per_category}) AS capacity FROM {given}
    ), rounds AS (
        SELECT retain, capacity, categories, prompt, completion FROM start
        UNION ALL
        SELECT retain, capacity, CASE WHEN batches = 1 OR kept >= categories THEN CAST(1 AS BIGINT) ELSE kept END, prompt + {overhead} * calls + sent * {per_category}, completion + {base} * calls + {answer} * sent
        FROM (
            SELECT *, CAST(ceil(categories / capacity) AS BIGINT) AS batches, categories DIV capacity + CAST(categories % capacity > 1 AS BIGINT) AS calls,
                categories - CAST(categories % capacity = 1 AS BIGINT) AS sent, greatest(CAST(ceil(categories / capacity) AS BIGINT), CAST(floor(categories * retain + 0.999D) AS BIGINT)) AS kept
            FROM rounds
        ) WHERE categories > 1 AND calls > 0
    )
    SELECT retain, max(prompt) AS prompt, max(completion) AS completion FROM rounds GROUP BY retain
"""


def reduce_rounds(given: DataFrame, overhead_tokens: int, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(retain, prompt, completion): tokens of one given row (categories, prompt, completion) and of merging its categories in rounds.

    A recursive query with a row for the expected and for the cautious share that a round keeps; nothing is computed in the driver.
    """
    fixed = {"expected": S.EXPECTED_RETAIN, "cautious": S.CAUTIOUS_RETAIN, "per_category": S.REDUCE_PROMPT_PER_CATEGORY, "base": S.REDUCE_BASE, "answer": S.REDUCE_PER_CATEGORY}
    query = _ROUNDS.format(given="{given}", overhead=overhead_tokens, max_tokens=max_tokens, **fixed)
    return given.sparkSession.sql(query, given=given.select(*(F.col(c).cast("long").alias(c) for c in ("categories", "prompt", "completion"))))


def cost_decision(estimate: DataFrame, in_rate: float, out_rate: float, max_cost: float, reduce_overhead: int = 0) -> DataFrame:
    """One row: expected and cautious cost of map and reduce, and whether the expected one exceeds the limit."""
    categories = F.when(F.col("chunks") > 1, 20 * F.col("chunks")).otherwise(F.lit(0))
    rounds = reduce_rounds(estimate.select(categories.alias("categories"), F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion")), reduce_overhead)
    cost = S.half_even(F.col("prompt") / 1_000_000 * in_rate + F.col("completion") / 1_000_000 * out_rate, 6)
    of = lambda share: F.max(F.when(F.col("retain") == share, cost))
    return rounds.agg(of(S.EXPECTED_RETAIN).alias("expected_cost"), of(S.CAUTIOUS_RETAIN).alias("upper_cost")).withColumn("exceeds", F.col("expected_cost") > max_cost)


def prices(models: DataFrame, live: DataFrame) -> DataFrame:
    """models (model_id, in_rate, out_rate) with live prices where both are valid; source says which."""
    fresh = live.select("model_id", S.price_per_million(F.col("prompt")).alias("_in"), S.price_per_million(F.col("completion")).alias("_out"))
    ok = F.col("_in").isNotNull() & F.col("_out").isNotNull()
    out = models.join(fresh, "model_id", "left")
    return out.select("model_id", F.when(ok, F.col("_in")).otherwise(F.col("in_rate")).alias("in_rate"), F.when(ok, F.col("_out")).otherwise(F.col("out_rate")).alias("out_rate"), F.when(ok, "live").otherwise("fallback").alias("price_source"))


def running_cost(calls: DataFrame) -> DataFrame:
    """calls with the cost so far, in the order of call."""
    return numbered(calls, [F.col("call")], "so_far", total="cost")
