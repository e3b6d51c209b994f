"""Queries that do their whole job: no cap on what is counted, and work that grows with the tables alone."""

import re
import unicodedata

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import filters as R
from quern.operators import mapping as M
from quern.operators import model_output as O
from quern.operators import preprocess as P
from quern.operators import profile as PR
from quern.operators.classify import Deterministic
from quern.plans import books
from quern.plans.analysis import analyze

from test_runs import everything, groups_of


def test_workbook_profile_counts_all_distinct_values(spark, monkeypatch):
    n = PR.DISTINCT_CAP + 7
    rows = spark.range(n).select(F.col("id").alias("source_row"), F.col("id").cast("string").alias("o_orderkey"), F.lit("x").alias("note"))
    monkeypatch.setattr(books, "_books", lambda spark, d: rows)
    got = {r["name"]: r.unique_count for r in books.QUERIES["workbook_profile"](spark, "").collect()}
    assert got == {"o_orderkey": n, "note": 1}
    capped = {r["name"]: r.unique_count for r in PR.column_profile(rows, ["o_orderkey", "note"]).collect()}
    assert capped == {"o_orderkey": PR.DISTINCT_CAP, "note": 1}


def test_waves_cost_the_same_however_many_went_before(spark):
    """Each wave reads and writes itself alone, what all used is one table, and records are rendered once."""
    model = O.TextClassifier("fake", everything(M.Usage(1, cost=0.5)), merge=False, max_records=1, wave=1, max_cost=100.0)
    groups, seen = groups_of(spark, *(f"{i} numaralı dersin sınavı" for i in range(5))), spark.sparkContext.accumulator(0)

    def counted(text: str) -> str:
        seen.add(1)
        return text

    assign, question, _ = model.classify(groups.withColumn("redacted_text", F.udf(counted)("redacted_text")))
    assert model.usage.first().asDict() == {"prompt_tokens": 5, "completion_tokens": 0, "cached_tokens": 0, "cache_write_tokens": 0, "calls": 5, "cost": 2.5}
    assert model.usage._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    assert assign.count() == 5 and question.count() == 1 and seen.value == 5


def test_slugs_try_no_class_of_all_characters(spark):
    """Characters that decompose to several come out as Unicode has them, and no pattern looks for them at each place."""
    several = {x: unicodedata.normalize("NFKD", x) for x in "ĳǆŉﬁﬃ½⑳㎏№℡…‼ǉ㏒⒜ﷺ" if x == x.lower()}
    texts = [f"a{x}b{x}" for x in several] + ["".join(several), "漢字" * 50 + "№"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.slug(F.col("t")).alias("s"))
    plain = ["".join(several.get(x, x) for x in t) for t in texts]
    want = ["t-" + (re.sub("[^a-z0-9]+", "-", re.sub(r"[^\x00-\x7f]", "", x)).strip("-") or "diger") for x in plain]
    assert [r.s for r in df.orderBy("i").collect()] == want
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()


def counting(spark, df, column):
    """df with a column whose reads are counted, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text: str) -> str:
        seen.add(1)
        return text

    return df.withColumn(column, F.udf(counted)(column)), seen


TEXTS = ["Sınav ne zaman?", "sınav ne zaman", "Yurt ücreti ne kadar", "kayıt yenileme tarihi", "ok", "tamam", None, "12", "ara@example.com kayıt yenileme tarihi"]


def test_an_analysis_reads_its_texts_once(spark):
    """Summary, lists and report come from one written table of groups; none is a cache of texts."""
    df, seen = counting(spark, spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string").repartition(3), "t")
    x = analyze(df, F.col("i"), R.Request("t"))
    for part in (x.top, x.themes, x.report, x.summary):
        part.collect()
        assert "InMemory" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert seen.value == len(TEXTS)
    want = P.summary(P.messages(df.select(F.col("i").alias("row_ix"), F.col("t").alias("value")))).first()
    assert x.summary.first() == want and want.total_rows == len(TEXTS) and want.discarded_count >= 3


def test_record_lists_read_their_groups_once(spark, monkeypatch):
    rows = P.messages(spark.createDataFrame(list(enumerate(TEXTS)), "row_ix long, value string"))
    groups, seen = counting(spark, spark.createDataFrame(P.groups(rows).collect(), P.groups(rows).schema), "redacted_text")
    monkeypatch.setattr(books, "_groups", lambda spark, d: groups)
    n = groups.count()
    got = books.QUERIES["record_lists"](spark, "").collect()
    assert len(got) == n and seen.value <= n
    # Questions of one count are numbered in ranges, not in a window of that count.
    assert "Window" not in Deterministic().questions(groups)._jdf.queryExecution().optimizedPlan().toString()
