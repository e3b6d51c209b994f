import random

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.functions import text as T
from quern.operators import aggregate as A
from quern.operators import filters as R
from quern.operators import mapping as M
from quern.operators import preprocess as P
from quern.operators import retention as RT
from quern.operators.classify import Deterministic
from quern.operators.cost import chunk_sizes, chunks, profile_chunk_sizes, reduce_estimate
from quern.plans.analysis import analyze


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def values(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_ix long, value string")


def test_turkish_spellings_have_one_key(spark):
    assert one(spark, T.normalize, "SINAV NE ZAMAN?", "sınav  ne zaman", "İSTANBUL!") == ["sınav ne zaman", "sınav ne zaman", "istanbul"]


def test_masks(spark):
    got = one(spark, T.redact, "yaz: a.b@x.com.tr", "0532 123 45 67 ara", "10000000146", "no 1234567", "bak https://x.y/z?a=1", "no 123456")
    assert got == ["yaz: [EPOSTA]", "[TELEFON] ara", "[KIMLIK]", "no [NUMARA]", "bak [BAGLANTI]", "no 123456"]


def test_scalar_texts(spark):
    assert one(spark, T.slug, "Sınav Tarihleri", "Öğrenci İşleri!", "???", "Café") == ["t-sinav-tarihleri", "t-ogrenci-isleri", "t-diger", "t-cafe"]
    assert one(spark, T.formula_guard, "=1+1", " \t@x", "a=1", None) == ["'=1+1", "' \t@x", "a=1", None]
    assert one(spark, lambda c: T.truncate(c, 5), "abcde", "abc  def", None) == ["abcde", "abc…", None]
    assert one(spark, T.heading, "merhaba", "  ") == ["Merhaba", "Boş mesaj"]
    assert one(spark, lambda c: F.array_join(T.signature(c), " "), "sınav tarihleri ne zaman açıklanacak", "zaman sınav tarihleri") == ["sınav tarihleri zaman", "sınav tarihleri zaman"]


def test_percentage_rounds_halves_up(spark):
    df = spark.createDataFrame([(54, 2400), (1, 0), (1, 3)], "c long, t long")
    assert [r[0] for r in df.select(S.percentage(F.col("c"), F.col("t"))).collect()] == [2.3, 0.0, 33.3]


def test_frequencies_survive_dedupe(spark):
    rows = P.messages(values(spark, *["Sınav ne zaman?"] * 5, "harç ödemesi nasıl", "Harç ödemesi NASIL"))
    s = P.summary(rows).first()
    assert (s.total_rows, s.analyzed_count, s.unique_count, s.duplicate_count) == (7, 7, 2, 5)
    g = P.groups(rows).orderBy(F.desc("count")).collect()
    assert [r["count"] for r in g] == [5, 2] and g[1].redacted_text == "harç ödemesi nasıl" and len(g[1].examples) == 2


def test_what_is_discarded(spark):
    rows = P.messages(values(spark, "sınav ne zaman", None, "   ", "[SİSTEM] oturum açıldı", "Teşekkürler!", "ok", "05321234567"))
    assert [r.status for r in rows.orderBy("row_ix").collect()] == ["analyzed", "null", "blank", "system", "courtesy", "short", "only_masks"]
    assert P.summary(P.messages(values(spark).limit(0))).first().total_rows == 0


def conversation(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 2)], "ix long, s string, o string, r string, k string, t string")
    return R.conversation_rows(df, F.col("ix"), "t", R.Conversation("s", "o", "r", "k"))


C = R.Conversation("s", "o", "r", "k")


def test_context_makes_groups(spark):
    rows = conversation(spark, ("a", "1", "assistant", "text", "hangi ders"), ("a", "2", "user", "text", "ne zaman"), ("b", "1", "assistant", "text", "Hangi ders?"), ("b", "2", "user", "text", "Ne zaman?"), ("c", "1", "user", "text", "ne zaman"))
    g = P.groups(P.contextual_messages(rows, C)).collect()
    assert sorted(r["count"] for r in g) == [1, 2]
    s = P.summary(P.contextual_messages(rows, C)).first()
    assert (s.total_rows, s.analyzed_count, s.context_only_count, s.discarded_count) == (5, 3, 2, 0)


@pytest.mark.parametrize("orders", [("2", "1"), ("1", "NaN"), ("1", "x")])
def test_order_that_goes_back_fails(spark, orders):
    rows = conversation(spark, *[("a", o, "user", "text", "bir soru var") for o in orders])
    with pytest.raises(P.ConversationOrderError) as e:
        P.contextual_messages(rows, C)
    assert e.value.source_row == 3


def test_context_budget_keeps_the_newest(spark):
    df = spark.createDataFrame([([("user", "a" * 10), ("user", "bb  cccc")],)], "x array<struct<role:string,text:string>>")
    assert [t.text for t in df.select(P.bounded(F.col("x"), 2).alias("y")).first().y] == ["bb  cc"]
    assert [t.text for t in df.select(P.bounded(F.col("x"), 3).alias("y")).first().y] == ["a", "bb  cccc"]


def test_filters_keep_rows(spark):
    df = spark.createDataFrame([(1, "web ", "a"), (2, None, "b"), (3, "mobil", "c")], "i long, kanal string, t string")
    got = R.values_keeping_rows(df, F.col("i"), "t", (R.RowFilter("kanal", ("web",)),)).orderBy("row_ix").collect()
    assert [r.value for r in got] == ["a", None, None]
    with pytest.raises(R.RequestError) as e:
        R.values_keeping_rows(df, F.col("i"), "nope")
    assert e.value.code == "COLUMN_NOT_FOUND"
    with pytest.raises(R.RequestError):
        R.Request("t", (R.RowFilter("kanal", ("a", "a")),)).check()


def test_top_n_leaves_themes_whole(spark):
    texts = ["sınav tarihi belli mi"] * 40 + ["sınav yeri neresi"] * 20 + ["harç ödemesi yapılmıyor"] * 15 + ["yurt başvurusu"] * 10 + [None] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    x = analyze(df, F.col("i"), R.Request("t", top_n=1))
    assert x.summary.first().analyzed_count == 85
    assert x.top.count() == 1
    assert sum(r["count"] for r in x.themes.collect()) == 85
    assert A.report_violations(x.report).count() == 0
    full = analyze(df, F.col("i"), R.Request("t", top_n=100))
    assert sum(r["count"] for r in full.top.collect()) == 85


def test_assignment_errors(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 2)], "record_id string, count long")
    with pytest.raises(A.AggregationError):
        A.check_assignment(spark.createDataFrame([("a", "q1"), ("a", "q2")], "record_id string, question_id string"), groups)
    with pytest.raises(A.AggregationError):
        A.check_assignment(spark.createDataFrame([("z", "q1")], "record_id string, question_id string"), groups)


def test_chunks_close_when_full(spark):
    rows = spark.createDataFrame([(f"r{i}", 100 - i, n) for i, n in enumerate([4, 4, 4, 20, 1, 1, 1, 1])], "record_id string, count long, tokens long")
    got = {r.record_id: r.chunk for r in chunks(rows, 3, 10).collect()}
    assert [got[f"r{i}"] for i in range(8)] == [0, 0, 1, 2, 3, 3, 3, 4]
    assert chunk_sizes(chunks(rows.limit(0))).count() == 0
    assert profile_chunk_sizes(250, 50) == [120, 120, 10] and reduce_estimate(1, 10, 0.5) == (0, 0)


def test_model_mapping_loses_no_record(spark):
    texts = ["sınav tarihi", "sınav yeri", "yurt ücreti", "bambaşka konu"]
    groups = P.groups(P.messages(values(spark, *texts)))
    call_map, call_reduce = M.fake_model({"sınav": "Sınav", "yurt": "Yurt"})
    lossy = lambda records: [x for x in call_map(records) if "yeri" not in dict(records)[x[0]]] + [("unknown", "q", "t")]
    assign, question, theme = M.ModelClassifier("fake", lossy, call_reduce, max_records=2).classify(groups)
    A.check_assignment(assign, groups)
    assert assign.count() == 4 and assign.select("question_id").distinct().count() == question.count()
    assert {r.theme_id for r in theme.collect()} >= {"t-sinav", "t-yurt"}
    assert Deterministic().classify(groups)[0].count() == 4


def test_retention(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    jobs = spark.createDataFrame([(1, 1, "completed", "{}", "2024-01-08"), (2, 2, "analyzing", None, "2024-01-01"), (3, 3, "completed", "{}", "2024-01-09 12:00:00"), (4, 4, "cancelled", None, "2024-01-09 12:00:00")], "job_id long, upload_id long, status string, report string, u string").withColumn("updated_at", F.col("u").cast("timestamp"))
    uploads = spark.createDataFrame([(i, f"k{i}", "2024-01-08") for i in range(1, 6)], "upload_id long, storage_key string, u string").withColumn("updated_at", F.col("u").cast("timestamp"))
    objects = spark.createDataFrame([("k2", "2024-01-01"), ("old", "2024-01-01"), ("new", "2024-01-09 23:00:00")], "key string, u string").withColumn("last_modified", F.col("u").cast("timestamp"))
    out = RT.sweep(jobs, uploads, objects, now)
    assert {r.upload_id for r in out["uploads"].collect()} == {2, 3}
    assert {r.job_id for r in out["jobs"].collect()} == {2, 3}
    assert {r.key for r in out["objects"].collect()} == {"k2", "new"}


@pytest.mark.parametrize(("most", "tokens"), [(3, 10), (120, 400), (1, 5), (7, 10_000), (1 << 30, 60)])
def test_chunks_of_many_ranges_are_one_fold(spark, most, tokens):
    """Ranges that are shorter than a chunk, records larger than a chunk, and ties of count."""
    r = random.Random(most)
    rows = [(f"r{i}", r.randrange(4), r.choice([1, 2, 3, 5, 9, 30, 90])) for i in range(500)]
    want, chunk, records, used = {}, 0, 0, 0
    for place, (i, _, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0]))):
        if records and (records >= most or used + n > tokens):
            chunk, records, used = chunk + 1, 0, 0
        records, used = records + 1, used + n
        want[i] = (chunk, place)
    df = spark.createDataFrame(rows, "record_id string, count long, tokens long")
    for parts in ("1", "4", "60"):
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {x.record_id: (x.chunk, x.position) for x in chunks(df, most, tokens).collect()} == want
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
