"""Counts, Top-N, themes and checks: all numbers come from joins of mappings with real frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import percentage, thousands
from .preprocess import EXAMPLES
from .tables import numbered

#: Fixed value: the closed set of warnings.
WARNINGS = (
    "ROW_LIMIT_TRUNCATED",
    "CHUNK_PARTIAL_FAILURE",
    "LOW_CONFIDENCE_THEMES",
    "PII_REDACTION_INCOMPLETE",
    "COST_LIMIT_APPROACHED",
    "LLM_UNKNOWN_RECORD_ID",
    "LLM_DUPLICATE_ASSIGNMENT",
    "LLM_UNASSIGNED_RECORDS",
    "LLM_REDUCE_PARTIAL_COVERAGE",
)
NOTHING = "Analiz edilebilecek kayıt bulunamadı."


class AggregationError(ValueError):
    pass


def unknown_records(assign: DataFrame, groups: DataFrame) -> DataFrame:
    return assign.join(groups.select("record_id"), "record_id", "left_anti").select("record_id").distinct()


def repeated_records(assign: DataFrame) -> DataFrame:
    return assign.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")


def check_assignment(assign: DataFrame, groups: DataFrame) -> None:
    """Every record at most once, and only records that exist."""
    seen = assign.groupBy("record_id").agg(F.count("*").alias("n")).join(groups.select("record_id", F.lit(True).alias("known")), "record_id", "left")
    bad = seen.where("n > 1 or known is null").first()
    if bad is not None:
        raise AggregationError(f"{'unknown record' if bad.known is None else 'record assigned twice'}: {bad.record_id}")


def check_themes(theme: DataFrame, analyzed: int) -> None:
    """Themes can't count more records than were analyzed."""
    total = theme.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if total > analyzed:
        raise AggregationError(f"themes count {total} of {analyzed} records")


def record_lists(assign: DataFrame, groups: DataFrame) -> DataFrame:
    """(question_id, place, record_id, count): the records of each question in order, by falling count, then id.

    A row for each record, so that no question's list is one value or one task's; places count from 1.
    """
    rows = assign.join(groups.select("record_id", "count"), "record_id").select("question_id", "record_id", "count")
    ordered = numbered(rows, [F.col("question_id"), F.desc("count"), F.col("record_id")], "_n")
    first = ordered.groupBy("question_id").agg(F.min("_n").alias("_first"))
    return ordered.join(first, "question_id").select("question_id", (F.col("_n") - F.col("_first") + 1).alias("place"), "record_id", "count")


def question_counts(assign: DataFrame, groups: DataFrame) -> DataFrame:
    return assign.join(groups.select("record_id", "count"), "record_id").groupBy("question_id").agg(F.sum("count").alias("count"))


def question_examples(assign: DataFrame, groups: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(question_id, examples): spellings of the members by falling count, each once, the first few."""
    members = assign.join(groups.select("record_id", "count", "examples"), "record_id").select("question_id", "count", "record_id", F.posexplode("examples").alias("pos", "example"))
    first = members.groupBy("question_id", "example").agg(F.min(F.struct(-F.col("count"), "record_id", "pos")).alias("at"))
    ranked = first.withColumn("k", F.row_number().over(W.partitionBy("question_id").orderBy("at"))).where(F.col("k") <= most)
    return ranked.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "example"))), lambda x: x["example"]).alias("examples"))


def top_questions(assign: DataFrame, question: DataFrame, groups: DataFrame, analyzed: int, top_n: int = 10) -> DataFrame:
    """(question_id, canonical_question, count, percentage, examples), by falling count, then id as text."""
    counted = question.join(question_counts(assign, groups), "question_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    top = counted.orderBy(F.desc("count"), "question_id").limit(top_n)
    shown = assign.join(F.broadcast(top.select("question_id")), "question_id", "left_semi")  # top_n rows at most
    out = top.join(question_examples(shown, groups), "question_id", "left").withColumn("percentage", percentage(F.col("count"), F.lit(analyzed)))
    return out.select("question_id", "canonical_question", "count", "percentage", F.coalesce("examples", F.array().cast("array<string>")).alias("examples")).orderBy(F.desc("count"), "question_id")


def themes(assign: DataFrame, question: DataFrame, theme: DataFrame, groups: DataFrame, analyzed: int, top: DataFrame) -> DataFrame:
    """(theme_id, name, count, percentage, related): counts over all questions of a theme, shown or not."""
    counted = question.join(question_counts(assign, groups), "question_id", "left")
    sums = counted.groupBy("theme_id").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    shown = question.join(F.broadcast(top.select("question_id")), "question_id", "left_semi")
    related = shown.groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "question_id"))), lambda x: x["question_id"]).alias("related"))
    out = theme.join(sums, "theme_id", "left").join(related, "theme_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select("theme_id", "name", "count", percentage(F.col("count"), F.lit(analyzed)).alias("percentage"), F.coalesce("related", F.array().cast("array<string>")).alias("related")).orderBy(F.desc("count"), "theme_id")


def folded_themes(theme: DataFrame, shown: int = 5) -> DataFrame:
    """(label, count, percentage): beyond six themes the first five, and the rest as one row."""
    ranked = numbered(theme, [F.desc("count"), F.col("theme_id")], "k").withColumn("n", F.lit(theme.count()))
    label = F.when((F.col("n") <= shown + 1) | (F.col("k") <= shown), F.col("theme_id")).otherwise("other")
    return ranked.groupBy(label.alias("label")).agg(F.sum("count").alias("count"), F.round(F.sum("percentage"), 1).alias("percentage"))


def display_shares(rows: DataFrame) -> DataFrame:
    """rows with bar (count by the greatest) and segment (count by the sum)."""
    every = W.partitionBy()
    return rows.withColumn("bar", F.try_divide(F.col("count"), F.max("count").over(every))).withColumn("segment", F.try_divide(F.col("count"), F.sum("count").over(every)))


def executive_summary(top: DataFrame, theme: DataFrame, analyzed: int) -> DataFrame:
    """One row (executive_summary): up to three sentences, their numbers all counted."""
    ranked = top.withColumn("k", F.row_number().over(W.orderBy(F.desc("count"), "question_id")))
    first = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    facts = ranked.agg(F.count("*").alias("n"), first("percentage").alias("p"), first("canonical_question").alias("q"), F.sum(F.when(F.col("k") <= 3, F.col("count"))).alias("c3"))
    big = theme.orderBy(F.desc("count"), "theme_id").limit(1).agg(F.first(F.struct("name", "count", "percentage")).alias("t"))
    one = F.translate(F.concat(F.lit("Analize giren "), thousands(F.lit(analyzed)), F.lit(" mesajın %"), F.col("p").cast("string"), F.lit(" kadarı «"), F.col("q"), F.lit("» başlığında toplanıyor.")), ",", ".")
    three = F.when(F.col("n") >= 3, F.concat(F.lit("İlk üç soru analiz edilen mesajların %"), percentage(F.col("c3"), F.lit(analyzed)).cast("string"), F.lit(" kadarını oluşturuyor.")))
    theme_text = F.when(F.col("t").isNotNull(), F.concat(F.lit("En büyük tema «"), F.col("t.name"), F.lit("» ("), F.col("t.count").cast("string"), F.lit(" mesaj, %"), F.col("t.percentage").cast("string"), F.lit(").")))
    none = (F.col("n") == 0) | F.lit(analyzed == 0)
    return facts.crossJoin(big).select(F.when(none, F.lit(NOTHING)).otherwise(F.concat_ws(" ", one, three, theme_text)).alias("executive_summary"))


def prompt_hashed(identifier: Column, version: Column) -> Column:
    """What a report tells of its prompt: a short digest of classifier and version."""
    return F.concat(F.lit("sha256:"), F.left(F.sha2(F.concat_ws("|", identifier, version), 256), F.lit(12)))


def usage_totals(calls: DataFrame) -> DataFrame:
    """Sums of tokens and cost of calls; the cost is null if any real call lacks one."""
    cost = F.when(F.count("cost") == F.count("*"), F.sum("cost"))
    return calls.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")], cost.alias("cost")).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def report(summary: DataFrame, top: DataFrame, theme: DataFrame, text: DataFrame) -> DataFrame:
    """One nested row: preprocessing summary, top questions, themes and executive summary."""
    tops = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "question_id", "canonical_question", "count", "percentage", "examples"))).alias("x"))
    ths = theme.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "theme_id", "name", "count", "percentage", "related"))).alias("y"))
    drop = lambda c, *names: F.transform(c, lambda e: F.struct(*[e[n].alias(n) for n in names]))
    every = summary.crossJoin(tops).crossJoin(ths).crossJoin(text)  # one row each
    return every.select(
        F.lit("1.0").alias("schema_version"),
        F.struct(*summary.columns).alias("preprocessing_summary"),
        drop(F.col("x"), "question_id", "canonical_question", "count", "percentage", "examples").alias("top_questions"),
        drop(F.col("y"), "theme_id", "name", "count", "percentage", "related").alias("themes"),
        "executive_summary",
    )


def report_violations(reports: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule) of each invariant that a report breaks."""
    s, a = F.col("preprocessing_summary"), F.col("preprocessing_summary.analyzed_count")
    ids = lambda c, k: F.transform(c, lambda e: e[k])
    q, t = ids("top_questions", "question_id"), ids("themes", "theme_id")
    wrong = lambda c: F.exists(c, lambda e: (e["count"] > a) | (e["percentage"] != percentage(e["count"], a)))
    rules = {
        "rows": s["analyzed_count"] + s["context_only_count"] + s["discarded_count"] != s["total_rows"],
        "unique": s["unique_count"] + s["duplicate_count"] != a,
        "redacted": s["redacted_count"] > a,
        "question ids": F.size(F.array_distinct(q)) != F.size(q),
        "theme ids": F.size(F.array_distinct(t)) != F.size(t),
        "question shares": wrong("top_questions"),
        "theme shares": wrong("themes"),
        "theme total": F.aggregate("themes", F.lit(0).cast("long"), lambda n, e: n + e["count"]) > a,
        "related": F.exists("themes", lambda e: (F.size(F.array_except(e["related"], q)) > 0) | (F.size(F.array_distinct(e["related"])) != F.size(e["related"]))),
    }
    hits = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return reports.select(*keys, F.explode(hits).alias("rule"))
