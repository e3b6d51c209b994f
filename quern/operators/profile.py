"""Column profiles of wide tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from .tables import written

#: The distinct cap, samples a column, sample length, and a sheet's row limit flag.
DISTINCT_CAP, SAMPLES, SAMPLE_LENGTH, ROW_LIMIT = 200_000, 3, 80, 100_000
#: Values up to this length are their own grouping key.
SHORT = 64
#: The columns that a request's fields are looked for in.
KNOWN = {"text": "message_text_clean", "session": "session_id", "order": "message_order", "role": "direction", "message_type": "message_type"}


def _cells(df: DataFrame, row_ix: Column | None, columns: list[str]) -> DataFrame:
    """(index, name, is_string, value[, row_ix]): one row for each cell, blank cells null."""
    kinds = {f.name: isinstance(f.dataType, Y.StringType) for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(c).alias("name"), F.lit(kinds[c]).alias("is_string"), F.nullif(T.strip(F.col(f"`{c}`").cast("string")), F.lit("")).alias("value")) for i, c in enumerate(columns)])
    return df.select(*([row_ix.cast("long").alias("row_ix")] if row_ix is not None else []), F.explode(cells).alias("c")).select("*", "c.*").drop("c")


def column_profile(df: DataFrame, columns: list[str] | None = None, exact_distinct: bool = True, cap: int | None = DISTINCT_CAP) -> DataFrame:
    """(index, name, non_empty_count, empty_count, unique_count, total_length, avg_length, is_likely_text).

    Counters are sums over one scan, combined before a shuffle of a row a column and task.
    Distinct values are grouped by (column, value), so no column is one task's, and told up to
    cap as a lower bound, or all of them if it is None; without exact_distinct they are estimated in the scan.
    Long values are shuffled as their digest and length, never as texts.
    """
    columns = columns or df.columns
    told = lambda n: n if cap is None else F.least(n, F.lit(cap))
    if exact_distinct:
        cells = _cells(df, None, columns)
        size = F.length("value")
        short = F.when(size > SHORT, F.sha2(F.col("value"), 256)).otherwise(F.col("value"))
        by_value = cells.groupBy("index", "name", "is_string", short.alias("value"), size.alias("size")).agg(F.count("*").alias("n"))
        some = F.col("value").isNotNull()
        out = by_value.groupBy("index", "name").agg(F.sum(F.when(some, F.col("n")).otherwise(0)).alias("non_empty_count"), F.sum(F.when(some, 0).otherwise(F.col("n"))).alias("empty_count"), told(F.count("value")).alias("unique_count"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("total_length"), F.sum(F.when(some & F.col("is_string"), F.col("n")).otherwise(0)).alias("_strings"))
    else:
        kinds = {f.name: isinstance(f.dataType, Y.StringType) for f in df.schema.fields}
        aggs = []
        for c in columns:
            v = F.nullif(T.strip(F.col(f"`{c}`").cast("string")), F.lit(""))
            aggs.append(F.struct(F.count(v).alias("n"), F.count("*").alias("all"), F.approx_count_distinct(v).alias("u"), F.coalesce(F.sum(F.length(v)), F.lit(0)).alias("len")))
        one = df.agg(F.array(*aggs).alias("a"))
        names = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("s")) for c in columns])
        x = one.select(F.posexplode(F.arrays_zip(F.col("a"), names.alias("b"))).alias("index", "z"))
        out = x.select("index", F.col("z.b.name").alias("name"), F.col("z.a.n").alias("non_empty_count"), (F.col("z.a.all") - F.col("z.a.n")).alias("empty_count"), told(F.col("z.a.u")).alias("unique_count"), F.col("z.a.len").alias("total_length"), F.when(F.col("z.b.s"), F.col("z.a.n")).otherwise(F.lit(0)).alias("_strings"))
    avg = F.coalesce(F.bround(F.try_divide(F.col("total_length"), F.col("non_empty_count")), 2), F.lit(0.0))
    out = out.withColumn("avg_length", avg.cast("double"))
    likely = F.coalesce((F.try_divide(F.col("_strings"), F.col("non_empty_count")) >= 0.8) & (F.col("avg_length") >= 15), F.lit(False))
    return out.withColumn("is_likely_text", likely).drop("_strings")


class _Least:
    """The least distinct 128-bit digests of a column so far: all of them below the cap, else so many as the cap."""

    def __init__(self, cap: int) -> None:
        self.cap, self.kept, self.new, self.waiting = cap, np.zeros(0, _DIGEST), [], 0

    def add(self, digests: np.ndarray) -> None:
        if len(self.kept) == self.cap:
            digests = digests[digests["a"] <= self.kept[-1]["a"]]
        self.new.append(digests)
        self.waiting += len(digests)
        if self.waiting > self.cap:
            self.settle()

    def settle(self) -> np.ndarray:
        self.kept = np.unique(np.concatenate([self.kept, *self.new]))[: self.cap]
        self.new, self.waiting = [], 0
        return self.kept


_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def capped_distinct(df: DataFrame, columns: list[str] | None = None, cap: int = DISTINCT_CAP) -> DataFrame:
    """(index, name, unique_count, is_lower_bound, estimate) of the values of columns that aren't blank.

    unique_count is exact up to the cap, and the cap beyond it, as a lower bound; estimate is then
    reckoned from how near to zero the least digests are. Each task keeps the least `cap` digests
    of a column and no more, and such sets merge: what is shuffled is bounded by tasks and the cap, not by how
    many values there are. A set that is full also tells the others what can't be among the least.
    """
    columns = columns or df.columns
    value = lambda c: F.nullif(T.strip(F.col(f"`{c}`").cast("string")), F.lit(""))
    # Two hashes of 64 bits with different seeds; a null value has none.
    pairs = [h for i, c in enumerate(columns) for v in [value(c)] for h in (F.when(v.isNotNull(), F.xxhash64(v)).alias(f"a{i}"), F.when(v.isNotNull(), F.xxhash64(F.lit(7), v)).alias(f"b{i}"))]

    def over(batches):
        sets = [_Least(cap) for _ in columns]
        for b in batches:
            for i, s in enumerate(sets):
                a, c = b.column(2 * i).drop_null(), b.column(2 * i + 1).drop_null()
                d = np.empty(len(a), _DIGEST)
                d["a"], d["b"] = a.to_numpy(zero_copy_only=False).view("u8"), c.to_numpy(zero_copy_only=False).view("u8")
                s.add(np.unique(d))
        for i, s in enumerate(sets):
            kept = s.settle()
            for k in range(0, len(kept), 10_000):
                part = kept[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int32)), pa.array((part["a"] ^ _SIGN).view("i8")), pa.array(part["b"].view("i8")), pa.array(np.full(len(part), len(kept) == cap))], names=["index", "a", "b", "full"])

    sets = written(df.select(*pairs).mapInArrow(over, "index int, a bigint, b bigint, full boolean"), "least")
    # What is above the last digest of any full set is not among the least of all.
    tasks = sets.where("full").groupBy("index", F.input_file_name()).agg(F.max("a").alias("last")).groupBy("index").agg(F.min("last").alias("last"))
    near = sets.join(F.broadcast(tasks), "index", "left").where("last is null or a <= last")
    counted = near.select("index", "a", "b", "last").distinct().groupBy("index").agg(F.count("*").alias("n"), F.max("a").alias("largest"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "index int, name string")
    out = names.join(counted, "index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = (F.col("largest").cast("double") + 2.0**63) / 2.0**64
    full = F.col("n") >= cap
    return out.select("index", "name", F.least("n", F.lit(cap)).cast("long").alias("unique_count"), full.alias("is_lower_bound"), F.when(full, F.round((F.col("n") - 1) / share).cast("long")).otherwise(F.col("n")).alias("estimate"))


#: Signed order of a digest's first half is its unsigned order.
_SIGN = np.uint64(1 << 63)


def sample_values(df: DataFrame, row_ix: Column, columns: list[str] | None = None) -> DataFrame:
    """(index, name, samples): of each column the first distinct sanitized values in row order."""
    cells = _cells(df, row_ix, columns or df.columns).where("value is not null").withColumn("sample", T.sanitize_sample(F.col("value"), SAMPLE_LENGTH))
    first = cells.where("sample <> ''").groupBy("index", "name", "sample").agg(F.min("row_ix").alias("at"))
    # Of each column the least few are picked by a bounded aggregate, not by sorting all its values.
    ranked = first.withColumn("k", F.row_number().over(W.partitionBy("index", "name").orderBy("at", "sample"))).where(F.col("k") <= SAMPLES)
    return ranked.groupBy("index", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sample"))), lambda x: x["sample"]).alias("samples"))


def sheet_rows(rows: DataFrame, sheet: str = "sheet") -> DataFrame:
    """(sheet, row_count, exceeds_limit): rows of each sheet, and of all of them as sheet null.

    The flag of the total says whether any single sheet exceeds the limit.
    """
    by = rows.groupBy(sheet).agg(F.count("*").alias("n"))
    out = by.rollup(sheet).agg(F.sum("n").alias("row_count"), (F.max("n") > ROW_LIMIT).alias("exceeds_limit"))
    return out.withColumnRenamed(sheet, "sheet")


def suggested_columns(profile: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """(field, name): the column to suggest for each field of a request, null if there is none.

    A field's column is the one of exactly its known name; text takes the first likely text
    column if there is no such one.
    """
    named = KNOWN | (known or {})
    found = [F.min_by("name", F.when(F.col("name") == n, F.col("index"))).alias(f) for f, n in named.items()]
    likely = F.min_by("name", F.when(F.col("is_likely_text"), F.col("index"))).alias("_likely")
    one = profile.agg(*found, likely).withColumn("text", F.coalesce("text", "_likely"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in named])).alias("s")).select("s.*")


def profile_violations(profile: DataFrame, row_count: int) -> DataFrame:
    bad = (F.col("non_empty_count") + F.col("empty_count") != row_count) | (F.col("unique_count") > F.col("non_empty_count"))
    return profile.where(bad).select("name")
