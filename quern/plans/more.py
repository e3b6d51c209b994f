"""Registered queries over model output, checks, keys, formats and progress, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import jsontext as J
from ..functions import locale as L
from ..functions import scalars as S
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import checks as K
from ..operators import cost as C
from ..operators import export as E
from ..operators import filters as R
from ..operators import mapping as M
from ..operators import model_output as O
from ..operators import preprocess as P
from ..operators.prompts import prompt
from .analysis import analyze
from .catalogue import NOW, ORACLE, QUERIES, query, table

# --- model output ---------------------------------------------------------------------------------

_BODY = """('{"categories":[{"category_id":"c' || doc_id % 5 || '","canonical_question":"Soru ' || doc_id % 7 || '","theme":"T"}],"assignments":[{"record_id":"r' || doc_id || '","category_id":"c' || doc_id % 5 || '"}]}')"""
_RAW = f"""CASE doc_id % 6 WHEN 0 THEN {_BODY} WHEN 1 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```' WHEN 2 THEN ' ```' || {_BODY} || '``` '
    WHEN 3 THEN left({_BODY}, length({_BODY}) - 3) WHEN 4 THEN replace({_BODY}, '"theme"', '"topic"') ELSE ' ' || chr(10) END"""
_ANSWER = "struct<categories:array<struct<category_id:string,canonical_question:string,theme:string>>,assignments:array<struct<record_id:string,category_id:string>>>"


@query(
    f"""WITH r AS (SELECT doc_id, trim({_RAW}, E' \\n') AS raw FROM labels),
    t AS (SELECT doc_id, CASE WHEN starts_with(raw, '```') THEN trim(regexp_replace(trim(raw, '`'), '^\\s*json', ''), E' \\n') ELSE raw END AS x FROM r),
    s AS (SELECT doc_id, x, CASE WHEN x = '' THEN 'empty' WHEN NOT json_valid(x) THEN 'invalid_json' WHEN CASE WHEN json_valid(x) THEN json_extract_string(x, '$.categories[0].theme') END IS NULL THEN 'schema' ELSE 'ok' END AS status FROM t)
    SELECT doc_id, status, CASE WHEN status = 'ok' THEN json_extract_string(x, '$.assignments[0].record_id') END AS record_id, CASE WHEN status = 'ok' THEN json_extract_string(x, '$.categories[0].canonical_question') END AS question FROM s"""
)
def parsed_outputs(spark, d):
    raw = table(spark, d, "labels").select("doc_id", F.expr(_RAW).alias("raw"))
    kind = Y.StructType.fromDDL(f"x {_ANSWER}")["x"].dataType
    out = raw.select("doc_id", O.parsed(F.col("raw"), kind).alias("p"))
    return out.select("doc_id", "p.status", F.get("p.data.assignments", F.lit(0))["record_id"].alias("record_id"), F.get("p.data.categories", F.lit(0))["canonical_question"].alias("question"))


_PAYLOAD = """('{"usage":{"prompt_tokens":' || CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS VARCHAR(20)) WHEN 1 THEN '-5' WHEN 2 THEN '"12"' WHEN 3 THEN '3.7' WHEN 4 THEN 'true' ELSE 'null' END
    || ',"completion_tokens":' || doc_id % 100 || ',"cost":' || CASE doc_id % 7 WHEN 0 THEN '0.25' WHEN 1 THEN '"0.5"' WHEN 2 THEN '-1' WHEN 3 THEN '"abc"' WHEN 4 THEN 'true' WHEN 5 THEN 'null' ELSE '3' END
    || ',"prompt_tokens_details":' || CASE doc_id % 3 WHEN 0 THEN '{"cached_tokens":4}' WHEN 1 THEN '[]' ELSE 'null' END || '}}')"""


def _counter_sql(path: str) -> str:
    return f"CASE WHEN json_type(p, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(floor(greatest(0.0, CAST(json_extract_string(p, '{path}') AS DOUBLE))) AS BIGINT) ELSE 0 END"


@query(
    f"""WITH x AS (SELECT doc_id, {_PAYLOAD} AS p FROM labels), y AS (SELECT doc_id, p, CASE WHEN json_type(p, '$.usage.cost') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(json_extract_string(p, '$.usage.cost') AS DOUBLE) END AS c FROM x)
    SELECT doc_id, {_counter_sql("$.usage.prompt_tokens")} AS prompt_tokens, {_counter_sql("$.usage.completion_tokens")} AS completion_tokens, {_counter_sql("$.usage.prompt_tokens_details.cached_tokens")} AS cached_tokens, CASE WHEN c >= 0 THEN c END AS cost FROM y"""
)
def model_usage(spark, d):
    rows = table(spark, d, "labels").select("doc_id", O.usage(F.expr(_PAYLOAD)).alias("u"))
    return rows.select("doc_id", "u.prompt_tokens", "u.completion_tokens", "u.cached_tokens", "u.cost")


_PRIORITY = "CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'Acil' WHEN o_orderpriority LIKE '%HIGH%' THEN 'Yüksek' ELSE 'Diğer' END"


@query(f"SELECT {_PRIORITY} || ' nedir?' AS canonical_question, count(*) AS count FROM orders GROUP BY 1")
def model_classifier(spark, d):
    """Calls of a fake model whose first answer is broken, so that each is repaired once."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_ix"), F.col("o_orderpriority").alias("value"))
    groups = P.groups(P.messages(rows))
    call = O.fake_text_model({"urgent": "Acil", "high": "Yüksek"}, bad_first=1)
    assign, question, _ = M.ModelClassifier("fake/v1", O.map_call(call, prompt())).classify(groups)
    return question.join(A.question_counts(assign, groups), "question_id").select("canonical_question", "count")


@query("SELECT 'LLM_REDUCE_PARTIAL_COVERAGE' AS code, CAST(1 AS BIGINT) AS n WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders) > 2")
def partial_merges(spark, d):
    """Merging in batches of two that never merge anything ends with categories apart, and says so."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_ix"), F.col("o_orderpriority").alias("value"))
    model = M.ModelClassifier("fake/v1", lambda records: [(r, text, "T") for r, text in records], lambda categories: [], reduce_tokens=40)
    model.classify(P.groups(P.messages(rows)))
    return model.warnings


_SHEET = R.Request("event_type", (R.RowFilter("event_type", ("click", "view", "purchase")),))


@query(
    """WITH e AS (SELECT event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')), s AS (SELECT (SELECT count(*) FROM events) AS total, count(*) AS n, count(DISTINCT event_type) AS u FROM e)
    SELECT t.label, CAST(t.number AS DOUBLE) AS number, t.text FROM s, LATERAL (VALUES ('Analiz kimliği', NULL, 'a1'), ('Oluşturulma', NULL, ''), ('Dosya', NULL, '''=x.xlsx'), ('Sayfa', NULL, ''), ('Kolon', NULL, 'event_type'),
    ('Analiz biçimi', NULL, 'Bağımsız mesajlar'), ('Satır filtreleri', NULL, 'event_type = click | view | purchase'), ('Toplam satır', total, NULL), ('Analiz edilen kayıt', n, NULL), ('Bağlam adayı (hedef dışı)', 0, NULL),
    ('Elenen kayıt', total - n, NULL), ('Tekrar eden kayıt', n - u, NULL), ('Benzersiz kayıt', u, NULL), ('PII maskelenen kayıt', 0, NULL), ('Model', NULL, 'm'), ('Prompt sürümü', NULL, 'v'), ('Prompt özeti', NULL, ''),
    ('Prompt token', 7, NULL), ('Yanıt token', 0, NULL), ('Cache''den okunan token', 0, NULL), ('Cache''e yazılan token', 0, NULL), ('Toplam token', 7, NULL), ('Maliyet (USD)', 0.25, NULL), ('Maliyet kaynağı', NULL, 'Fiyat snapshot hesabı'),
    ('Fiyat kataloğu', NULL, 'c'), ('Girdi fiyatı (USD / 1M)', 0.5, NULL), ('Çıktı fiyatı (USD / 1M)', 2, NULL), ('Cache okuma fiyatı (USD / 1M)', NULL, 'Yok'), ('Cache yazma fiyatı (USD / 1M)', NULL, 'Yok'),
    ('Uyarı kodu', NULL, 'Açıklama'), ('LLM_UNASSIGNED_RECORDS', NULL, 'Model 3 kaydı hiçbir kategoriye eşlemedi; bu kayıtlar «Sınıflandırılamayan kısa mesajlar» başlığında toplandı.'), ('OTHER', NULL, '2')) AS t(label, number, text)"""
)
def summary_sheet(spark, d):
    x = analyze(table(spark, d, "events"), F.col("event_id"), _SHEET)
    about = E.About(_SHEET, analysis_id="a1", filename="=x.xlsx", model="m", prompt_version="v", tokens={"prompt_tokens": 7, "total_tokens": 7}, cost=0.25, price_catalog="c", prices={"input": 0.5, "output": 2.0})
    warnings = spark.createDataFrame([("OTHER", 2), ("LLM_UNASSIGNED_RECORDS", 3)], "code string, n long")
    rows = E.summary_sheet(x.summary, x.report.select("executive_summary"), about, warnings)
    return rows.where("label <> 'Yönetici özeti'")


@query("SELECT CAST(sum(doc_id % 50) AS BIGINT) AS prompt_tokens, CAST(sum(doc_id % 9) AS BIGINT) AS completion_tokens, CAST(sum(doc_id % 50) + sum(doc_id % 9) AS BIGINT) AS total_tokens, doc_id % 2 AS part, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE count(*) * 0.5::DOUBLE END AS cost FROM labels GROUP BY doc_id % 2")
def usage_totals(spark, d):
    calls = table(spark, d, "labels").select((F.col("doc_id") % 2).alias("part"), (F.col("doc_id") % 50).alias("prompt_tokens"), (F.col("doc_id") % 9).alias("completion_tokens"), F.when(F.col("doc_id") % 2 == 1, 0.5).alias("cost"))
    out = None
    for part in (0, 1):
        one = A.usage_totals(calls.where(F.col("part") == part)).select(F.lit(part).cast("long").alias("part"), "prompt_tokens", "completion_tokens", "total_tokens", "cost")
        out = one if out is None else out.union(one)
    return out


# --- JSON, secrets, keys and formats -----------------------------------------------------------------


@query(
    """SELECT c_custkey, sha256('{"account":{"balance":' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END || ',"open":' || (c_acctbal > 0) || '}'
    || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ',"analysis_mode":"contextual_user_turns"' END || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ',"conversation_config":null' END || ',"names":["' || c_name || '",null,"a\\"b' || chr(92) || 'n"]}') AS fingerprint FROM customer"""
)
def nested_fingerprint(spark, d):
    body = F.struct(
        F.struct((F.col("c_acctbal") > 0).alias("open"), F.col("c_acctbal").alias("balance")).alias("account"),
        F.when(F.col("c_custkey") % 2 == 0, "message").otherwise("contextual_user_turns").alias("analysis_mode"),
        F.lit(None).cast("struct<a:string>").alias("conversation_config"),
        F.array(F.col("c_name"), F.lit(None).cast("string"), F.lit('a"b\n')).alias("names"),
    )
    df = table(spark, d, "customer").select("c_custkey", body.alias("body"))
    return df.select("c_custkey", J.fingerprint(F.col("body"), df.schema["body"].dataType).alias("fingerprint"))


@query("SELECT c_custkey, '[REDACTED]' AS api_key, 'call with [REDACTED] now' AS note, CASE WHEN c_custkey % 2 = 0 THEN '[REDACTED]' ELSE c_name END AS held, 'user ' || c_name AS inner_note, '[REDACTED]' AS inner_token FROM customer")
def redacted_columns(spark, d):
    t = table(spark, d, "customer")
    name = F.col("c_name")
    key = F.when(F.col("c_custkey") % 2 == 0, "X_Api_Key_2").otherwise("name")
    df = t.select("c_custkey", name.alias("api_key"), F.lit("call with Bearer abc.DEF-1 now").alias("note"), F.create_map(key, name).alias("m"), F.struct(F.concat(F.lit("user "), name).alias("note"), F.col("c_custkey").alias("Access_Token")).alias("inner"))
    got = J.redact_columns(df)
    return got.select("c_custkey", "api_key", "note", F.get(F.map_values("m"), F.lit(0)).alias("held"), F.col("inner.note").alias("inner_note"), F.col("inner.Access_Token").alias("inner_token"))


@query("SELECT doc_id, 'k: [REDACTED] and [REDACTED].' AS x FROM labels")
def mask_secrets(spark, d):
    text = F.concat(F.lit("k: sk-"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(" and Authorization = "), F.sha2(F.col("doc_id").cast("string"), 256), F.lit(" ."))
    return table(spark, d, "labels").select("doc_id", F.replace(T.mask_secrets(text), F.lit(" ."), F.lit(".")).alias("x"))


@query("""SELECT page_id, 'idempotency:["POST",' || to_json('/' || array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '/')) || ',' || to_json('k' || page_id) || ']' AS key FROM pages WHERE url IS NOT NULL""")
def storage_keys(spark, d):
    p = table(spark, d, "pages").where("url is not null")
    return p.select("page_id", L.storage_key(F.lit("post"), F.col("url"), F.concat(F.lit("k"), F.col("page_id").cast("string"))).alias("key"))


_TENTH = "(o_orderkey % 1000 / 10.0::DOUBLE)"
_COMMA = f"replace(printf('%.1f', {_TENTH}), '.', ',')"


@query(
    f"""SELECT o_orderkey, replace(format('{{:,}}', CAST(o_orderkey AS BIGINT) * 1000), ',', '.') AS count, '%' || {_COMMA} AS percent, '$' || {_COMMA} || '0' AS usd,
    CASE WHEN o_orderkey % 2000 < 1024 THEN replace(format('{{:,}}', CAST(o_orderkey % 2000 AS BIGINT)), ',', '.') || ' B' ELSE replace(printf('%.1f', round((o_orderkey % 2000) / 1024.0::DOUBLE, 1)), '.', ',') || ' KB' END AS size,
    CASE WHEN o_orderkey % 9000 >= 3600 THEN (o_orderkey % 9000) // 3600 || ' sa ' || (o_orderkey % 9000) % 3600 // 60 || ' dk' WHEN o_orderkey % 9000 >= 60 THEN (o_orderkey % 9000) // 60 || ' dk' ELSE o_orderkey % 9000 || ' sn' END AS duration,
    day(o_orderdate) || ' ' || (['Oca', 'Şub', 'Mar', 'Nis', 'May', 'Haz', 'Tem', 'Ağu', 'Eyl', 'Eki', 'Kas', 'Ara'])[month(o_orderdate)] || ' ' || year(o_orderdate) || ' ' || strftime(o_orderdate, '%H:%M') AS at FROM orders"""
)
def locale_texts(spark, d):
    k = F.col("o_orderkey")
    tenth = F.pmod(k, F.lit(1000)) / F.lit(10.0)
    return table(spark, d, "orders").select("o_orderkey", S.thousands(k * 1000).alias("count"), L.percent_text(tenth).alias("percent"), L.usd_text(tenth).alias("usd"), L.size_text(k % 2000).alias("size"), L.duration_text(k % 9000).alias("duration"), L.date_time_text(F.col("o_orderdate")).alias("at"))


_LONG = "CASE p_partkey % 5 WHEN 0 THEN '-' || p_partkey || '00000000000000000000000' WHEN 1 THEN p_partkey || '.50' WHEN 2 THEN p_partkey || 'e3' WHEN 3 THEN '-0.000' || p_partkey ELSE p_partkey || '0000000000000000000000.25' END"


@query(f"SELECT p_partkey, 'number' AS kind, dense_rank() OVER (ORDER BY CASE WHEN p_partkey % 5 = 2 THEN CAST(p_partkey * 1000 AS DECIMAL(38, 9)) ELSE TRY_CAST({_LONG} AS DECIMAL(38, 9)) END) AS place FROM part")
def order_keys(spark, d):
    from pyspark.sql import Window as W

    rows = table(spark, d, "part").select("p_partkey", S.order_key(F.expr(_LONG)).alias("k"))
    return rows.select("p_partkey", "k.kind", F.dense_rank().over(W.orderBy("k.number")).alias("place"))


@query(f"SELECT doc_id, 't-' || CASE WHEN s = '' THEN 'diger' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(translate(lower(translate(text, '{T.CAPITALS}', '{T.SMALL}')), '{T.LETTERS}', '{T.ASCII_LETTERS}')), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents WHERE text IS NOT NULL)")
def theme_slugs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT p_partkey, 'sha256:' || left(sha256('deterministic-proxy/v1|' || p_name), 12) AS hash FROM part")
def prompt_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", A.prompt_hashed(F.lit("deterministic-proxy/v1"), F.col("p_name")).alias("hash"))


# --- progress and cost ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 100.0::DOUBLE WHEN 'O' THEN round(40.0::DOUBLE + 50.0::DOUBLE * least(1.0::DOUBLE, (o_orderkey % 130) / 100.0::DOUBLE), 1) ELSE 20.0::DOUBLE END AS progress FROM orders")
def stage_progress(spark, d):
    stage = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "analyzing").otherwise("preprocessing")
    return table(spark, d, "orders").select("o_orderkey", S.stage_progress(stage, (F.col("o_orderkey") % 130) / 100.0).alias("progress"))


@query("SELECT o_orderkey AS call, CAST(sum(o_orderkey % 16 / 16.0::DOUBLE) OVER (ORDER BY o_orderkey) AS DOUBLE) AS so_far FROM orders")
def running_cost(spark, d):
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), (F.col("o_orderkey") % 16 / 16.0).alias("cost"))
    return C.running_cost(calls).select("call", "so_far")


# Prices of quarters of a millionth: rounding to six digits meets halves, which the printed form rounds by the binary value.
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(format('{:.6f}', o_orderkey / 1000000.0::DOUBLE * 0.25::DOUBLE + 500 / 1000000.0::DOUBLE * 0.5::DOUBLE) AS DOUBLE) END AS cost FROM orders")
def token_cost(spark, d):
    rate = F.when(F.col("o_orderkey") % 4 != 0, 0.25)
    return table(spark, d, "orders").select("o_orderkey", S.token_cost(F.col("o_orderkey"), F.lit(500), rate, F.lit(0.5)).alias("cost"))


# --- checks of stored rows -----------------------------------------------------------------------------


@query("SELECT o_orderkey, 'total' AS rule FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'cache' FROM orders WHERE o_orderkey % 10 > 5")
def usage_violations(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(10).alias("prompt_tokens"), F.lit(5).alias("completion_tokens"), F.when(k % 7 == 0, 16).otherwise(15).alias("total_tokens"), F.lit(5).alias("cached_tokens"), (k % 10).alias("cache_write_tokens"))
    return K.usage_violations(rows, "o_orderkey")


@query(
    """WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'analyzing' END AS status, o_orderkey % 2 = 0 AS e, o_orderkey % 3 = 0 AS t FROM orders)
    SELECT job_id, 'error missing' AS rule FROM j WHERE status = 'failed' AND NOT e UNION ALL SELECT job_id, 'error' FROM j WHERE status <> 'failed' AND e UNION ALL SELECT job_id, 'estimate' FROM j WHERE status <> 'analyzing' AND t"""
)
def job_violations(spark, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("analyzing")
    return K.job_violations(table(spark, d, "orders").select(k.alias("job_id"), status.alias("status"), F.when(k % 2 == 0, "{}").alias("error"), F.when(k % 3 == 0, 1.5).alias("estimated_seconds_remaining")), "job_id")


@query(
    """WITH u AS (SELECT c_custkey AS upload_id, ['ready', 'failed', 'processing'][1 + c_custkey % 3] AS status, c_custkey % 2 = 0 AS p, c_custkey % 5 = 0 AS e FROM customer)
    SELECT upload_id, 'profile' AS rule FROM u WHERE p <> (status = 'ready') UNION ALL SELECT upload_id, 'error' FROM u WHERE e <> (status = 'failed')"""
)
def upload_violations(spark, d):
    k = F.col("c_custkey")
    status = F.element_at(F.array(F.lit("ready"), F.lit("failed"), F.lit("processing")), (k % 3 + 1).cast("int"))
    return K.upload_violations(table(spark, d, "customer").select(k.alias("upload_id"), status.alias("status"), F.when(k % 2 == 0, "{}").alias("profile"), F.when(k % 5 == 0, "{}").alias("error")), "upload_id")


@query("SELECT o_orderkey, o_orderpriority AS model FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def whitelisted_requests(spark, d):
    catalog = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("5-LOW",)], "model_id string")
    return K.whitelisted(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model")), catalog).select("o_orderkey", "model")


@query(f"SELECT event_type, coalesce(epoch(TIMESTAMP '{NOW}') - floor(epoch(min(ts))) <= 86400 * 180, false) AS fresh FROM events GROUP BY event_type")
def price_freshness(spark, d):
    prices = table(spark, d, "events").select("event_type", F.col("ts").alias("updated_at"))
    return K.is_fresh(prices, F.lit(NOW).cast("timestamp"), 86400 * 180, ("event_type",))


@query(
    """WITH r AS (SELECT CAST(n_nationkey AS VARCHAR) AS model_id, n_nationkey % 3 AS m, n_nationkey AS k FROM nation)
    SELECT model_id, CASE WHEN m = 0 THEN (k + 1) / 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS in_rate, CASE WHEN m = 0 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS out_rate, CASE WHEN m = 0 THEN 'live' ELSE 'fallback' END AS price_source FROM r"""
)
def catalog_prices(spark, d):
    """A captured catalog, its entries from nations: a third valid, a third negative, a third without an id of text."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    price = F.when(k % 3 == 1, "-1").otherwise(F.format_string("%.9f", (k + 1) / 1_000_000_000.0))
    ident = F.when(k % 3 == 2, k.cast("string")).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
    item = F.concat(F.lit('{"id":'), ident, F.lit(',"pricing":{"prompt":"'), price, F.lit('","completion":"0.000002"}}'))
    payload = n.agg(F.concat(F.lit('{"data":['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("payload"))
    models = n.select(k.cast("string").alias("model_id"), F.lit(1.0).alias("in_rate"), F.lit(3.0).alias("out_rate"))
    return C.prices(models, K.catalog_of(payload))


@query(
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 'completed' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'analyzing' END AS status,
    CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'old' END AS report FROM orders"""
)
def guarded_reports(spark, d):
    k = F.col("o_orderkey")
    jobs = table(spark, d, "orders").select(k.alias("job_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("analyzing").alias("status"), (k % 5 == 0).alias("cancel_requested"), F.when(k % 7 == 0, "old").alias("report"))
    new = jobs.where("job_id % 2 = 0").select("job_id", F.lit("new").alias("report"))
    return K.guarded_report(jobs, new).select("job_id", "status", "report")


_BROKEN = ("rows", "redacted", "question ids", "question shares", "theme shares", "related")


@query("SELECT * FROM (VALUES ('valid', NULL), " + ", ".join(f"('{k}', '{k}')" for k in _BROKEN) + ") AS t(variant, rule) WHERE rule IS NOT NULL")
def broken_reports(spark, d):
    """A true report of the event types and copies of it, each with one invariant broken."""
    rows = table(spark, d, "events").select("event_id", "event_type")
    r = analyze(rows, F.col("event_id"), R.Request("event_type")).report
    s, q, t = F.col("preprocessing_summary"), F.col("top_questions"), F.col("themes")
    more = lambda c, n: c.withField(n, c[n] + 1)
    variants = {
        "valid": (s, q, t),
        "rows": (more(s, "total_rows"), q, t),
        "redacted": (s.withField("redacted_count", s["analyzed_count"] + 1), q, t),
        "question ids": (s, F.concat(q, F.slice(q, 1, 1)), t),
        "question shares": (s, F.transform(q, lambda e: e.withField("percentage", e["percentage"] + 0.1)), t),
        "theme shares": (s, q, F.transform(t, lambda e: e.withField("percentage", e["percentage"] + 0.1))),
        "related": (s, q, F.transform(t, lambda e: e.withField("related", F.concat(e["related"], F.array(F.lit("q0")))))),
    }
    reports = r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), a.alias("preprocessing_summary"), b.alias("top_questions"), c.alias("themes")) for k, (a, b, c) in variants.items()])).alias("v")).select("v.*")
    return A.report_violations(reports, "variant")


# --- files ---------------------------------------------------------------------------------------------


@query("SELECT doc_id AS row_ix FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 1")
def without_blank_rows(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(k.alias("row_ix"), F.when(k % 3 == 0, " \t").otherwise("x").alias("a"), F.when(k % 4 == 1, "y").alias("b"))
    return R.without_blank_rows(rows, ("row_ix",)).select("row_ix")


__all__ = ["ORACLE", "QUERIES"]
