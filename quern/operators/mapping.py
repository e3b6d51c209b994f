"""Repairing a model's mapping: unknown, repeated and missing ids, and merges of categories."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from .cost import chunks
from .tables import numbered, scratch_path, written

FALLBACK = "unassigned"
PARTIAL = "LLM_REDUCE_PARTIAL_COVERAGE"


def first_assignments(mapped: DataFrame) -> DataFrame:
    """Of each record_id its first mention by (chunk, pos)."""
    k = F.row_number().over(W.partitionBy("record_id").orderBy("chunk", "pos"))
    return mapped.withColumn("_k", k).where("_k = 1").drop("_k")


def duplicate_assignments(mapped: DataFrame) -> DataFrame:
    """(record_id, extra): how many mentions after the first."""
    return mapped.groupBy("record_id").agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def unknown_ids(mapped: DataFrame, groups: DataFrame) -> DataFrame:
    return mapped.join(groups.select("record_id"), "record_id", "left_anti").groupBy("record_id").agg(F.count("*").alias("n"))


def missing_categories(mapped: DataFrame, categories: DataFrame) -> DataFrame:
    """Mentions whose category isn't in the catalog: they don't count as assigned."""
    return mapped.join(categories.select("category"), "category", "left_anti")


def unassigned(groups: DataFrame, mapped: DataFrame) -> DataFrame:
    return groups.join(mapped.select("record_id"), "record_id", "left_anti").select("record_id")


def repaired(mapped: DataFrame, categories: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assign (record_id, category) for every record exactly once, and warnings (code, n).

    Known mentions of cataloged categories count, the first of each record; the rest of the
    records go to the fallback category. Of the other mentions those of unknown records count
    as hallucinated, those after a record's assignment as duplicates, and those before it, or
    without one, as hallucinated too: their category isn't in the catalog.
    """
    told = mapped.join(groups.select("record_id", F.lit(True).alias("_known")), "record_id", "left").join(categories.select("category", F.lit(True).alias("_listed")).distinct(), "category", "left")
    at = F.struct("chunk", "pos")
    good = told.where("_known and _listed")
    first = first_assignments(good).select("record_id", "category")
    rest = unassigned(groups, first).select("record_id", F.lit(FALLBACK).alias("category"))
    since = good.groupBy("record_id").agg(F.min(at).alias("_first"))
    late = told.where("_known").join(since, "record_id", "left").withColumn("_late", F.coalesce(at > F.col("_first"), F.lit(False)))
    lost = late.where("not _late and _listed is null").agg(F.count("*").alias("n"))
    unknown = told.where("_known is null").agg(F.count("*").alias("n"))
    counts = {
        "LLM_UNKNOWN_RECORD_ID": unknown.union(lost).agg(F.sum("n").alias("n")),
        "LLM_DUPLICATE_ASSIGNMENT": late.where("_late").agg(F.count("*").alias("n")),
        "LLM_UNASSIGNED_RECORDS": rest.agg(F.count("*").alias("n")),
    }
    warnings = None
    for code, n in counts.items():
        row = n.select(F.lit(code).alias("code"), F.col("n").cast("long").alias("n"))
        warnings = row if warnings is None else warnings.unionByName(row)
    return first.unionByName(rest), warnings.where("n > 0")


def merged_categories(categories: DataFrame, merges: DataFrame) -> DataFrame:
    """(position, target): the merge group of each category; of several mentions the first, of none itself.

    merges: (position, group, pos), group being numbered in order.
    """
    first = merges.withColumn("_k", F.row_number().over(W.partitionBy("position").orderBy("group", "pos"))).where("_k = 1")
    known = first.join(categories.select("position"), "position", "left_semi").select("position", F.concat(F.lit("g"), F.col("group").cast("string")).alias("target"))
    left = categories.join(known, "position", "left_anti").select("position", F.concat(F.lit("c"), F.col("position").cast("string")).alias("target"))
    return known.unionByName(left)


@dataclass(frozen=True)
class Usage:
    """What calls used; a provider's own cost is null unless every call has one."""

    prompt_tokens: int = 0
    completion_tokens: int = 0
    cached_tokens: int = 0
    cache_write_tokens: int = 0
    cost: float | None = None
    calls: int = 1

    def __add__(self, other: Usage) -> Usage:
        own = None if self.cost is None or other.cost is None else self.cost + other.cost
        return Usage(*(getattr(self, c) + getattr(other, c) for c in COUNTERS[:4]), own, self.calls + other.calls)

    def row(self) -> tuple:
        return (*(getattr(self, c) for c in COUNTERS[:4]), self.cost, self.calls)


COUNTERS = ("prompt_tokens", "completion_tokens", "cached_tokens", "cache_write_tokens", "cost", "calls")
USAGE = "prompt_tokens long, completion_tokens long, cached_tokens long, cache_write_tokens long, cost double, calls long"


class Used(list):
    """What a map or reduce call gives, with what it used."""

    def __init__(self, rows=(), usage: Usage | None = None) -> None:
        super().__init__(rows)
        self.usage = usage


@dataclass(frozen=True)
class Merge:
    """A group of categories by position, with the question and theme that the model gives it."""

    members: list[int]
    question: str | None = None
    theme: str | None = None


@dataclass(frozen=True)
class Rates:
    """USD a million tokens; cache rates that are not known are the input's."""

    prompt: float = 0.0
    completion: float = 0.0
    cache_read: float | None = None
    cache_write: float | None = None


class CostLimitExceeded(RuntimeError):
    """A run was stopped because of what it had spent; calls that were not made yet are not made."""

    def __init__(self, spent: float, most: float) -> None:
        super().__init__(f"spent {spent} of {most} USD")
        self.spent, self.most = spent, most


class ModelClassifier:
    """A classifier behind a model: chunks of records are mapped to categories in parallel, then merged in rounds.

    call_map(records) and call_reduce(categories) are plain functions, shipped to the
    executors: the first gets [(record_id, text)] and gives [(record_id, question, theme)],
    the second gets [(position, question, theme)] and gives groups of positions, or Merge with
    titles of their own. Either may give Used, which says what the call used. A call_map with the
    attribute `rendered` gets each record as the prompt shows it, with the turns before it.
    Results of a chunk carry (chunk, position), so first mentions don't depend on arrival. Tasks may run
    twice; switch speculation off where calls cost money.

    Answers and the catalog of each round of merging are written to tables, so that no call is
    made again for a lost executor. warnings (code, n) and usage (one row of sums) are set by classify.

    With max_cost chunks go in waves of so many calls at once; what a wave used is written before the
    next is sent, and once the sum is over the limit none is. What merging used counts too. A wave is a
    job of its own, a call a task, that reads and writes this wave alone, so waves cost the same however many went before.
    """

    def __init__(self, identifier: str, call_map: Callable, call_reduce: Callable | None = None, max_records: int = 120, max_tokens: int = 12_000, reduce_tokens: int = 12_000, max_cost: float | None = None, rates: Rates = Rates(), wave: int = 8) -> None:
        self.identifier, self.call_map, self.call_reduce = identifier, call_map, call_reduce
        self.max_records, self.max_tokens, self.reduce_tokens = max_records, max_tokens, reduce_tokens
        self.max_cost, self.rates, self.wave = max_cost, rates, wave
        self.warnings: DataFrame | None = None
        self._used: list[DataFrame] = []
        self._spent = 0.0

    @property
    def usage(self) -> DataFrame:
        """One row: what all calls so far used, and what they cost: the provider's own figure, else tokens at the rates."""
        rows = self._used[0]
        for more in self._used[1:]:
            rows = rows.unionByName(more)
        costs = F.coalesce(F.sum(self._cost()), F.lit(0.0))
        return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS if c != "cost"), costs.alias("cost"))

    def _cost(self) -> Column:
        r = self.rates
        at_rates = S.usage_cost(*(F.col(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "cache_write_tokens")), *(F.lit(x).cast("double") for x in (r.prompt, r.completion, r.cache_read, r.cache_write)))
        return F.coalesce("cost", at_rates)

    def _charge(self, used: DataFrame) -> None:
        """Adds what calls used, a row for each, to what is spent; beyond the limit that is an error."""
        if self.max_cost is None:
            return
        self._spent += sum(r["cost"] for r in used.select(self._cost().alias("cost")).collect())
        if self._spent > self.max_cost:
            raise CostLimitExceeded(self._spent, self.max_cost)

    def shown(self, groups: DataFrame) -> DataFrame:
        """(record_id, count, text, tokens) of the groups, written, so that these are computed once.

        Chunks are sized by what the prompt shows: with their context, if records have one.
        """
        context = F.col("context") if "context" in groups.columns else None
        shown = T.render_record(F.col("record_id"), F.col("redacted_text"), context)
        text = shown if getattr(self.call_map, "rendered", False) else F.col("redacted_text")
        return written(groups.select("record_id", "count", text.alias("text"), S.record_tokens(shown).alias("tokens")), "records")

    def mapped(self, ready: DataFrame) -> DataFrame:
        """(record_id, chunk, pos, category, question, theme) of shown records as the model gave them."""
        call, spark = self.call_map, ready.sparkSession
        limited = self.max_cost is not None
        sent = chunks(ready, self.max_records, self.max_tokens).withColumn("wave", F.floor(F.col("chunk") / (self.wave if limited else 1 << 40)).cast("long"))
        sent = written(sent.repartition("wave") if limited else sent, "chunks", by="wave")

        def over(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("position")
            got = call(list(zip(pdf["record_id"], pdf["text"])))
            got = got if isinstance(got, Used) else Used(got)
            rows = [(r, int(key[0]), i, f"{q}\x1f{t}", q, t, *[None] * 6) for i, (r, q, t) in enumerate(got)]
            rows.append((None, int(key[0]), None, None, None, None, *(got.usage or Usage()).row()))
            return pd.DataFrame(rows, columns=["record_id", "chunk", "pos", "category", "question", "theme", *COUNTERS]).astype({"pos": "Int64"} | {c: "Int64" for c in COUNTERS if c != "cost"} | {"cost": "float64"})

        def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if held := list(batches):
                for chunk, pdf in pd.concat(held).groupby("chunk"):
                    yield over((chunk,), pdf)

        schema, path = f"record_id string, chunk long, pos long, category string, question string, theme string, {USAGE}", scratch_path(spark, "mapped")
        read = lambda at: spark.read.schema(schema).parquet(at)
        used = lambda answers: answers.where("calls is not null").select(*COUNTERS).withColumn("cost", F.nanvl("cost", F.lit(None).cast("double")))
        try:
            for w in range((sent.agg(F.max("wave")).first()[0] or 0) + 1):
                rows, at = sent.where(F.col("wave") == w), f"{path}/wave={w}"
                calls = rows.repartitionById(self.wave, (F.col("chunk") % self.wave).cast("int")).mapInPandas(in_task, schema) if limited else rows.groupBy("chunk").applyInPandas(over, schema)
                calls.write.parquet(at)
                self._charge(used(read(at)))
        except CostLimitExceeded:
            self._used.append(used(read(path)))
            raise
        answers = read(path)
        self._used.append(used(answers))
        return answers.where("calls is null").select("record_id", "chunk", "pos", "category", "question", "theme")

    def classify(self, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        self._used, self._spent = [], 0.0
        groups = self.shown(groups)
        mapped = self.mapped(groups)
        catalog = mapped.groupBy("category").agg(F.first("question").alias("question"), F.first("theme").alias("theme"))
        assign, self.warnings = repaired(mapped, catalog, groups)
        named = catalog.unionByName(catalog.sparkSession.createDataFrame([(FALLBACK, "Sınıflandırılamayan kısa mesajlar", "Diğer")], "category string, question string, theme string"))
        named, partial = self.reduced(named)
        if partial:
            self.warnings = self.warnings.unionByName(named.sparkSession.createDataFrame([(PARTIAL, 1)], "code string, n long"))
        counted = assign.join(groups.select("record_id", "count"), "record_id").join(named, "category")
        largest = F.struct("count", "question")
        sums = counted.groupBy("target").agg(F.sum("count").alias("n"), F.coalesce(F.max("title"), F.max_by("question", largest)).alias("question"), F.coalesce(F.max("topic"), F.max_by("theme", F.struct("count", "theme"))).alias("theme"))
        q = numbered(sums, [F.desc("n"), F.col("target")], "position").withColumn("question_id", F.concat(F.lit("q"), F.col("position").cast("string")))
        q = q.select("target", "position", "question_id", T.trim_title(F.col("question")).alias("canonical_question"), T.slug(F.col("theme")).alias("theme_id"), "theme")
        out = assign.join(named.select("category", "target"), "category").join(q.select("target", "question_id"), "target").select("record_id", "question_id")
        return out, q.select("question_id", "canonical_question", "theme_id", "position"), q.groupBy("theme_id").agg(F.min_by("theme", "position").alias("name"))

    def reduced(self, catalog: DataFrame) -> tuple[DataFrame, bool]:
        """catalog with target, title and topic: categories merged round by round until one batch is left or none shrinks.

        The catalog is bounded by categories, not records; a round's batches are called in
        parallel, what a batch leaves out stays as it is, and a category that fills a batch
        alone is passed on without a call. title and topic are what the model named a merged
        category, null where it named none. The flag says that merging ended with several
        batches, so that like categories of different batches stayed apart.
        """
        null = F.lit(None).cast("string")
        now = catalog.withColumns({"target": F.col("category"), "title": null, "topic": null})
        if self.call_reduce is None:
            return now, False
        call = self.call_reduce
        before = None
        while True:
            heads = now.groupBy("target").agg(F.coalesce(F.max("title"), F.min("question")).alias("question"), F.coalesce(F.max("topic"), F.min("theme")).alias("theme"))
            cats = written(numbered(heads, [F.col("target")], "position"), "categories")
            n = cats.count()
            if n < 2 or n == before:
                return now, n > 1
            before = n
            sized = cats.withColumn("tokens", F.greatest(F.lit(1), F.floor((F.length("question") + F.length("theme")) / 3) + 12))
            batch = chunks(sized.select(F.col("position"), "tokens"), 1 << 30, self.reduce_tokens, presized=True)
            rows = cats.join(batch.select("position", "chunk"), "position")

            def over(key, pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("position")
                got = call(list(zip(pdf["position"].tolist(), pdf["question"], pdf["theme"]))) if len(pdf) > 1 else Used(usage=Usage(cost=0.0, calls=0))
                got = got if isinstance(got, Used) else Used(got)
                out = []
                for g, m in enumerate(got):
                    m = m if isinstance(m, Merge) else Merge(m)
                    # Batches have 32 bits of groups each.
                    out += [(p, int(key[0]) << 32 | g, i, m.question, m.theme, *[None] * 6) for i, p in enumerate(m.members)]
                out.append((None, None, None, None, None, *(got.usage or Usage()).row()))
                return pd.DataFrame(out, columns=["position", "group", "pos", "title", "topic", *COUNTERS]).astype({c: "Int64" for c in ("position", "group", "pos", *COUNTERS) if c != "cost"} | {"cost": "float64"})

            answers = written(rows.groupBy("chunk").applyInPandas(over, f"position long, group long, pos long, title string, topic string, {USAGE}"), "merges")
            self._used.append(answers.where("calls is not null").select(*COUNTERS).withColumn("cost", F.nanvl("cost", F.lit(None).cast("double"))))
            self._charge(self._used[-1])
            merges = answers.where("calls is null")
            target = merged_categories(cats, merges).join(cats.select("position", F.col("target").alias("old")), "position")
            titles = merges.groupBy(F.concat(F.lit("g"), F.col("group").cast("string")).alias("new")).agg(F.max("title").alias("named"), F.max("topic").alias("themed"))
            renamed = target.select(F.col("old").alias("target"), F.col("target").alias("new")).join(titles, "new", "left")
            now = now.join(renamed, "target").drop("target").withColumns({"title": F.coalesce("named", "title"), "topic": F.coalesce("themed", "topic")})
            now = written(now.drop("named", "themed").withColumnRenamed("new", "target"), "merged")
            if batch.select("chunk").distinct().count() == 1:
                return now, False


def fake_model(theme_words: dict[str, str]) -> tuple[Callable, Callable]:
    """A map and a reduce call for tests: records by the first theme word they have, categories by theme."""

    def call_map(records: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        for r, text in records:
            theme = next((t for w, t in theme_words.items() if w in text.lower()), "Diğer")
            yield r, f"{theme} nedir?", theme

    def call_reduce(categories: list[tuple[int, str, str]]) -> list[list[int]]:
        by: dict[str, list[int]] = {}
        for p, _, theme in categories:
            by.setdefault(theme, []).append(p)
        return list(by.values())

    return call_map, call_reduce
