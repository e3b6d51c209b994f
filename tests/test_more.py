"""Model output, JSON, order keys, streams and checks; queries of these against DuckDB."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import jsontext as J
from quern.functions import locale as L
from quern.functions import scalars as S
from quern.functions import text as T
from quern.operators import checks as K
from quern.operators import export as E
from quern.operators import filters as R
from quern.operators import mapping as M
from quern.operators import model_output as O
from quern.operators import profile as PR
from quern.operators import prompts
from quern.plans import more
from quern.streaming import jobs

SF = "/root/testdata/sf0.001"
NAMES = ["parsed_outputs", "model_usage", "model_classifier", "usage_totals", "nested_fingerprint", "redacted_columns", "mask_secrets", "storage_keys", "locale_texts", "order_keys", "theme_slugs", "stage_progress", "usage_violations", "job_violations", "upload_violations", "whitelisted_requests", "catalog_prices", "guarded_reports", "broken_reports", "without_blank_rows", "mapping_warnings", "partial_merges", "summary_sheet", "stream_context", "stream_idempotency"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = more.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    want = con.sql(more.ORACLE[name]).select(", ".join(f'"{c}"' for c in order)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(repr, want))


def one(spark, f, *values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


# --- model output ---------------------------------------------------------------------------------

GOOD = {"categories": [{"category_id": "a", "canonical_question": "q", "theme": "t"}], "assignments": [{"record_id": "r", "category_id": "a"}]}


def test_answers_are_repaired_and_say_nothing_of_their_content():
    told = []
    answers = iter(["", '{"categories": [{"category_id": "geheim"}], "assignments": 1}', "```JSON\n" + json.dumps(GOOD) + "```"])

    def call(messages):
        told.append(messages)
        return next(answers)

    got = O.complete(call, "s", "u", O.MAP_SHAPE)
    assert got.data == GOOD and got.calls == 3
    assert [len(m) for m in told] == [2, 4, 6]
    assert "empty" in told[1][-1][1] and "canonical_question: missing" in told[2][-1][1] and "geheim" not in told[2][-1][1]
    with pytest.raises(O.BadResponse):
        O.complete(lambda m: "no", "s", "u", O.MAP_SHAPE)
    with pytest.raises(O.SchemaViolation):
        O.read_answer('{"categories": [], "assignments": [{"record_id": 5, "category_id": true}]}', O.MAP_SHAPE)


def test_model_that_drops_records_and_needs_repairs(spark):
    groups = spark.createDataFrame([(f"r{i}", 10 - i, "sınav <soru>" if i % 2 else "yurt") for i in range(6)], "record_id string, count long, redacted_text string")
    call = O.fake_text_model({"sınav": "Sınav", "yurt": "Yurt"}, bad_first=2, drop_every=3)
    assign, question, _ = M.ModelClassifier("fake", O.map_call(call, prompts.prompt()), max_records=3).classify(groups)
    assert assign.count() == 6 and {r.canonical_question for r in question.collect()} >= {"Sınav nedir?", "Yurt nedir?"}
    broken = O.fake_text_model({}, bad_first=3)
    with pytest.raises(Exception, match="no usable answer"):
        M.ModelClassifier("fake", O.map_call(broken, prompts.prompt())).classify(groups)[0].collect()


def test_prompts_are_a_closed_registry():
    assert prompts.prompt().version == prompts.DEFAULT and len({prompts.prompt(v).map_system for v in prompts.VERSIONS}) == 4
    with pytest.raises(prompts.UnknownPromptVersion):
        prompts.prompt("faq_analysis/v9")
    for version, contextual in ((prompts.CONTEXTUAL, False), (prompts.DEFAULT, True)):
        with pytest.raises(prompts.PromptModeError):
            prompts.prompt_for(version, contextual)
    assert prompts.prompt_for(prompts.CONTEXTUAL, True).version == prompts.CONTEXTUAL


def test_bad_counters_and_costs(spark):
    payloads = ['{"usage": {"prompt_tokens": 7, "completion_tokens": -2, "cost": " 0.5 "}}', '{"usage": {"prompt_tokens": "7", "completion_tokens": 2.9, "cost": true}}', '{"usage": [1]}', "no json", None, '{"usage": {"cost": "inf", "prompt_tokens_details": {"cached_tokens": 3, "cache_write_tokens": false}}}']
    got = one(spark, O.usage, *payloads)
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0.5), (0, 2, 0, 0, None), (0, 0, 0, 0, None), (0, 0, 0, 0, None), (0, 0, 0, 0, None), (0, 0, 3, 0, None)]


def test_mentions_of_missing_categories_count_as_hallucinated(spark):
    mapped = spark.createDataFrame([("a", 0, 0, "none"), ("a", 0, 1, "x"), ("a", 0, 2, "none"), ("b", 0, 3, "none"), ("z", 0, 4, "x")], "record_id string, chunk long, pos long, category string")
    cats = spark.createDataFrame([("x",)], "category string")
    groups = spark.createDataFrame([("a", 1), ("b", 1)], "record_id string, count long")
    assign, warnings = M.repaired(mapped, cats, groups)
    assert {tuple(r) for r in assign.collect()} == {("a", "x"), ("b", M.FALLBACK)}
    assert {r.code: r.n for r in warnings.collect()} == {"LLM_UNKNOWN_RECORD_ID": 3, "LLM_DUPLICATE_ASSIGNMENT": 1, "LLM_UNASSIGNED_RECORDS": 1}


def test_merging_says_when_batches_stayed_apart(spark):
    groups = spark.createDataFrame([(f"r{i}", f"k{i}", 1, f"soru {i}", 0, [f"soru {i}"]) for i in range(6)], "record_id string, key string, count long, redacted_text string, redacted_count long, examples array<string>")
    called = []

    def classified(call_reduce, tokens):
        model = M.ModelClassifier("fake", lambda records: [(r, f"{t}?", "Tema") for r, t in records], call_reduce, max_records=3, reduce_tokens=tokens)
        assign, question, _ = model.classify(groups)
        out = ({r.record_id for r in assign.collect()}, question.count(), {r.code for r in model.warnings.collect()})
        return out

    every = {f"r{i}" for i in range(6)}
    assert classified(lambda cats: [], 45) == (every, 6, {M.PARTIAL})
    assert classified(lambda cats: [], 12_000) == (every, 6, set())
    assert classified(lambda cats: [[p for p, _, _ in cats]], 45) == (every, 1, set())
    # A batch of one category is passed on, never sent.
    def alone(cats):
        raise AssertionError("sent")

    assert classified(alone, 1) == (every, 6, {M.PARTIAL})


def test_summary_sheet_of_a_conversation(spark):
    c = R.Conversation("s", "o", "r", "k", user_roles=("Kullanıcı", "x"), max_turns=3)
    about = E.About(R.Request("t", (R.RowFilter("a", ("1", "2")), R.RowFilter("b", ("3",))), c), cost_source="provider")
    summary = spark.createDataFrame([tuple(range(7))], ", ".join(f"{n} long" for n in E.LABELS))
    executive = spark.createDataFrame([("=özet",)], "executive_summary string")
    none = spark.createDataFrame([], "code string, n long")
    rows = [tuple(r) for r in E.summary_sheet(summary, executive, about, none).collect()]
    found = {label: number if text is None else text for label, number, text in rows}
    assert found["Analiz biçimi"] == E.MODES[1] and found["Satır filtreleri"] == "a = 1 | 2; b = 3" and found["Azami geçmiş turn"] == 3
    assert found["Kullanıcı rol değerleri"] == "Kullanıcı | x" and found["Maliyet kaynağı"] == "OpenRouter usage.cost"
    assert rows[-2:] == [(None, None, None), ("Yönetici özeti", None, "'=özet")]
    assert [n for label, n, _ in rows if label in E.LABELS.values()] == list(range(7))


def test_columns_are_suggested_by_exact_name(spark):
    profile = spark.createDataFrame([(0, "Session_id", True), (1, "long", True), (2, "message_text_clean", False), (3, "direction", False)], "index int, name string, is_likely_text boolean")
    got = lambda df, **k: {r.field: r["name"] for r in PR.suggested_columns(df, k).collect()}
    assert got(profile) == {"text": "message_text_clean", "session": None, "order": None, "role": "direction", "message_type": None}
    assert got(profile.where("index < 2"), session="Session_id")["text"] == "Session_id" and got(profile.where("index = 3"))["text"] is None
    assert got(profile.where("index < 0")) == dict.fromkeys(PR.KNOWN)


def test_long_and_repeated_values_are_profiled_exactly(spark):
    long = "ğ" * 500
    df = spark.createDataFrame([(long,), (long,), (long + "x",), ("a",), (None,), (" ",)], "v string")
    row = PR.column_profile(df).first()
    assert (row.non_empty_count, row.empty_count, row.unique_count, row.total_length) == (4, 2, 3, 1502)


# --- JSON, keys, formats -----------------------------------------------------------------------------


def test_json_texts_are_pythons(spark):
    texts = ['a"b\\c', "\x00\x01\x1f\x7f\n\t\b\f\r", "é漢", ""]
    assert one(spark, S.json_text, *texts) == [json.dumps(t, ensure_ascii=False) for t in texts]
    numbers = [0.1, -0.25, 1.5e-4, 2.5e-5, 1e-7, 1234567.5, 12345678.9, 123456789012345.6, -9.5e-10, 3.0, 1e20, 0.0]
    assert one(spark, S.number_text, *numbers, kind="double") == [str(int(x)) if x.is_integer() else repr(x) for x in numbers]


def test_nested_canonical_json(spark):
    kind = "struct<b:array<struct<y:double,x:string>>,a:map<string,int>,c:boolean,d:string>"
    df = spark.createDataFrame([({"b": [{"y": 2.0, "x": "q"}, None], "a": {"z": 1, "k": None}, "c": True, "d": None},)], f"v {kind}")
    got = df.select(J.canonical(F.col("v"), df.schema["v"].dataType)).first()[0]
    assert got == '{"a":{"k":null,"z":1},"b":[{"x":"q","y":2},null],"c":true,"d":null}'


def test_redaction_goes_into_maps_and_lists(spark):
    df = spark.createDataFrame([({"Authorization": "x", "note": "Bearer abc"}, [{"user_password": "p", "n": 5}], {"my_token": 5, "n": 1})], "m map<string,string>, l array<struct<user_password:string,n:int>>, i map<string,int>")
    r = J.redact_columns(df).first()
    assert r.m == {"Authorization": "[REDACTED]", "note": "[REDACTED]"} and r.l[0].user_password == "[REDACTED]" and r.l[0].n == 5 and r.i == {"my_token": None, "n": 1}


def test_order_keys_of_any_length(spark):
    values = ["-100000000000000000000001", "-1000000000000000000000", "-15", "-1", "-0.0002", "0", "0.0002", "1e-2", "1", "1.50", "2", "15", "1e3", "999999999999999999999", "1000000000000000000000", "1E30"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int").select("i", S.order_key(F.col("v")).alias("k"))
    assert [r.i for r in df.orderBy("k.number").collect()] == list(range(len(values))) and df.where("k.kind <> 'number'").count() == 0
    same = one(spark, lambda c: S.order_key(c)["number"], "10", "1e1", "010.00", "+10.")
    assert len(set(same)) == 1
    assert one(spark, lambda c: S.order_key(c)["kind"], "NaN", "Infinity", "x1", "1_0") == ["error", "error", "text", "text"]


def test_slugs_of_compatibility_letters(spark):
    import re
    import unicodedata

    texts = ["ﬁnans", "Ａbc", "Größe ½", "Ⅻ. Yıl", "① ㎏ ﷺ", "漢字", "№ 5™"]
    plain = [unicodedata.normalize("NFKD", t.translate(str.maketrans("Iİı", "iii")).lower()).encode("ascii", "ignore").decode() for t in texts]
    assert one(spark, T.slug, *texts) == ["t-" + (re.sub("[^a-z0-9]+", "-", x).strip("-") or "diger") for x in plain]


def test_locale_and_keys(spark):
    assert one(spark, L.size_text, 5, 1023, 133169152, 5 << 30, kind="long") == ["5 B", "1.023 B", "127,0 MB", "5,0 GB"]
    assert one(spark, L.duration_text, 3725, 59, 60, -3, kind="long") == ["1 sa 2 dk", "59 sn", "1 dk", "0 sn"]
    assert one(spark, L.usd_text, 1.2345, 2.0, 1234.5, kind="double") == ["$1,2345", "$2,00", "$1.234,50"]
    assert one(spark, L.percent_text, 24.8, 0.0, kind="double") == ["%24,8", "%0,0"]
    assert one(spark, L.normalized_path, "uploads//", "/", "//a///b/", "") == ["/uploads", "/", "/a/b", "/"]
    assert one(spark, lambda c: L.storage_key(F.lit("post"), c, F.lit('k"')), "/uploads/") == ['idempotency:["POST","/uploads","k\\""]']


# --- streams ------------------------------------------------------------------------------------------


def conversation_stream(spark, tmp_path, batches):
    """A stream whose micro-batches are the given lists of (row, session, order, role, text)."""
    kind = "ix long, s string, o string, r string, t string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    raw = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("k", F.lit("text"))
    c = R.Conversation("s", "o", "r", "k", max_turns=2)
    return jobs.ordered_turns(R.conversation_rows(raw, F.col("ix"), "t", c), c), c


ROWS = [[(1, "a", "1", "user", "ilk soru burada"), (2, "a", "2", "assistant", "yanıt burada"), (3, "b", "x", "user", "başka oturum")], [(4, "a", "3", "user", "ikinci soru"), (5, "a", "10", "user", "üçüncü soru")]]


def test_stream_keeps_turns_between_batches(spark, tmp_path):
    got = {r.row_ix: [t.text for t in r.context] for r in jobs.run_to_end(jobs.context_stream(*conversation_stream(spark, tmp_path, ROWS)), "append").collect()}
    assert got == {1: [], 2: ["ilk soru burada"], 3: [], 4: ["ilk soru burada", "yanıt burada"], 5: ["yanıt burada", "ikinci soru"]}


def test_order_that_goes_back_fails_the_stream(spark, tmp_path):
    rows = [ROWS[0], [(4, "a", "1", "user", "geri dönen")]]
    stream, c = conversation_stream(spark, tmp_path, rows)
    with pytest.raises(Exception, match="goes back at row 4"):
        jobs.run_to_end(jobs.context_stream(stream, c), "append")
    marked = {r.row_ix: r.late for r in jobs.run_to_end(jobs.context_stream(stream, c, "mark"), "append").collect()}
    assert marked == {1: False, 2: False, 3: False, 4: True}


def test_replays_do_not_lengthen_a_claim(spark, tmp_path):
    rows = [(1, "k", "f", "2024-01-01 00:00:00"), (2, "k", "f", "2024-01-01 23:00:00"), (3, "k", "g", "2024-01-01 23:30:00"), (4, "k", "g", "2024-01-02 00:00:00"), (5, "k", "g", "2024-01-02 23:59:59")]
    spark.createDataFrame(rows, "event_id long, key string, fingerprint string, t string").selectExpr("event_id", "key", "fingerprint", "cast(t as timestamp) as ts").write.parquet(f"{tmp_path}/e.parquet")
    got = {r.event_id: (r.claim_id, r.outcome) for r in jobs.run_to_end(jobs.claims(jobs.read_table(spark, f"{tmp_path}/e.parquet")), "append").collect()}
    assert got == {1: (1, "claimed"), 2: (1, "replay"), 3: (1, "conflict"), 4: (4, "claimed"), 5: (4, "replay")}


# --- checks --------------------------------------------------------------------------------------------


def test_catalog_payloads(spark):
    good = spark.createDataFrame([('{"data": [{"id": "m", "pricing": {"prompt": "0.1"}}, {"id": 5}, {"pricing": {}}]}',)], "payload string")
    assert [tuple(r) for r in K.catalog_of(good).collect()] == [("m", "0.1", None, None, None)]
    for bad in ('{"data": 5}', "no json"):
        with pytest.raises(Exception, match="no list of data"):
            K.catalog_of(spark.createDataFrame([(bad,)], "payload string")).collect()
    with pytest.raises(Exception, match="larger than allowed"):
        K.catalog_of(good, most_bytes=10).collect()


def test_freshness_of_no_prices(spark):
    none = spark.createDataFrame([(None,)], "updated_at timestamp")
    assert K.is_fresh(none, F.current_timestamp()).first().fresh is False
