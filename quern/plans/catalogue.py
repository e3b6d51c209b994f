"""The registered queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import cost as C
from ..operators import filters as R
from ..operators import mapping as M
from ..operators import preprocess as P
from ..operators import profile as PR
from ..operators import retention as RT
from ..operators.classify import Deterministic, signature_buckets, token_corpus
from ..streaming import jobs as ST
from . import sqltext as Q
from .analysis import analyze

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-06-15 12:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a small file that can't be split, dealt to all cores before the costly expressions.

    A scan with a split for each core keeps its splits: no shuffle of texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _spread(_docs(spark, d).select(F.col("doc_id").alias("row_ix"), F.col("text").alias("value")))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return P.messages(_values(spark, d))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return P.groups(_messages(spark, d))


MSG = "WITH " + Q.messages("documents", "doc_id", "text")
GRP = f"{MSG}, {Q.GROUPS}"
QST = f"{GRP}, {Q.QUESTIONS}"


# --- text -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {Q.normalize('text')} AS normalized FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {Q.redact('text')} AS masked, {Q.redact('text')} <> text AS redacted FROM documents")
def redact_pii(spark, d):
    m = T.redact(F.col("text"))
    return _docs(spark, d).select("doc_id", m.alias("masked"), (m != F.col("text")).alias("redacted"))


@query(f"SELECT page_id, {Q.redact('html')} AS masked FROM pages")
def redact_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.redact(F.col("html")).alias("masked"))


@query(
    "WITH m AS (SELECT "
    + Q.redact("text")
    + " AS masked FROM documents) "
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(count(*) FILTER (contains(masked, '{k}')) AS BIGINT) AS n FROM m" for k in ("[EPOSTA]", "[BAGLANTI]", "[TELEFON]", "[KIMLIK]", "[NUMARA]"))
)
def pii_counts(spark, d):
    masks = (T.EMAIL_MASK, T.URL_MASK, T.PHONE_MASK, T.ID_MASK, T.NUMBER_MASK)
    one = _docs(spark, d).select(T.redact(F.col("text")).alias("m")).agg(*[F.count_if(F.contains("m", F.lit(k))).alias(k) for k in masks])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("n")) for k in masks])).alias("x")).select("x.*")


@query(f"WITH r AS (SELECT doc_id, {Q.redact(Q.collapse('text'))} AS x FROM documents) SELECT doc_id, {Q.truncate('x', 80)} AS sample FROM r")
def truncate_sample(spark, d):
    return _docs(spark, d).select("doc_id", T.sanitize_sample(F.col("text"), 80).alias("sample"))


@query(f"{MSG} SELECT row_ix, record_id FROM m WHERE status = 'analyzed'")
def record_ids(spark, d):
    return P.analyzed(_messages(spark, d)).select("row_ix", "record_id")


@query(f"{MSG} SELECT row_ix, array_to_string({Q.tokens('key')}, ' ') AS tokens FROM m")
def tokens(spark, d):
    return _messages(spark, d).select("row_ix", F.array_join(T.tokens(F.col("key")), " ").alias("tokens"))


@query(f"{MSG}, k AS MATERIALIZED (SELECT row_ix, {Q.tokens('key')} AS toks FROM m) SELECT row_ix, array_to_string({Q.signature('toks')}, ' ') AS signature FROM k")
def signature(spark, d):
    return _messages(spark, d).select("row_ix", F.array_join(T.signature(F.col("key")), " ").alias("signature"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(v, '^[ \\t\\r\\n]*[=+\\-@]') THEN '''' || v ELSE v END AS guarded FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' =' WHEN p_partkey % 3 = 1 THEN '-' ELSE '' END || p_name AS v FROM part)")
def formula_guard(spark, d):
    v = F.concat(F.when(F.col("p_partkey") % 3 == 0, " =").when(F.col("p_partkey") % 3 == 1, "-").otherwise(""), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.formula_guard(v).alias("guarded"))


@query("SELECT p_partkey, 't-' || CASE WHEN s = '' THEN 'diger' ELSE s END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("""SELECT c_custkey, sha256('{"account":' || c_custkey || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}') AS fingerprint FROM customer""")
def fingerprint(spark, d):
    fields = {"segment": S.json_text(F.col("c_mktsegment")), "nation": S.number_text(F.col("c_nationkey").cast("double")), "account": S.number_text(F.col("c_custkey").cast("double"))}
    return table(spark, d, "customer").select("c_custkey", F.sha2(S.canonical_json(fields), 256).alias("fingerprint"))


@query(f"{MSG} SELECT row_ix, '<kayit id=\"' || record_id || '\">' || regexp_replace(masked, '[<>]', ' ', 'g') || '</kayit>' AS rendered FROM m WHERE status = 'analyzed'")
def render_records(spark, d):
    return P.analyzed(_messages(spark, d)).select("row_ix", T.render_record(F.col("record_id"), F.col("masked")).alias("rendered"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def utc_text(spark, d):
    return table(spark, d, "events").select("event_id", S.utc_text(F.col("ts")).alias("iso"))


# --- messages ---------------------------------------------------------------------------------


@query(f"{MSG} SELECT row_ix, status FROM m")
def discard_status(spark, d):
    return _messages(spark, d).select("row_ix", "status")


SUMMARY = """SELECT count(*) AS total_rows, count(*) FILTER (status = 'analyzed') AS analyzed_count, count(*) FILTER (status = 'context') AS context_only_count,
    count(*) FILTER (status NOT IN ('analyzed', 'context')) AS discarded_count, count(*) FILTER (status = 'analyzed' AND redacted) AS redacted_count,
    count(DISTINCT record_id) FILTER (status = 'analyzed') AS unique_count, count(*) FILTER (status = 'analyzed') - count(DISTINCT record_id) FILTER (status = 'analyzed') AS duplicate_count FROM m"""


@query(f"{MSG} {SUMMARY}")
def preprocess_summary(spark, d):
    return P.summary(_messages(spark, d))


@query(f"{GRP} SELECT record_id, count, redacted_count FROM g")
def dedupe_frequency(spark, d):
    return _groups(spark, d).select("record_id", "count", "redacted_count")


@query("WITH " + Q.messages("events", "event_id", "event_type") + f", {Q.GROUPS} SELECT record_id, redacted_text, count FROM g")
def dedupe_events(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("row_ix"), F.col("event_type").alias("value"))
    return P.groups(P.messages(rows)).select("record_id", "redacted_text", "count")


@query(f"{GRP} SELECT record_id, redacted_text FROM g")
def representative_text(spark, d):
    return _groups(spark, d).select("record_id", "redacted_text")


@query(f"{GRP} SELECT record_id, array_to_string(examples, chr(10)) AS examples FROM g")
def examples_topk(spark, d):
    return _groups(spark, d).select("record_id", F.array_join("examples", "\n").alias("examples"))


# --- filters and profiles -----------------------------------------------------------------------

_FILTERS = (R.RowFilter("o_orderstatus", ("F", "O")), R.RowFilter("o_orderpriority", ("1-URGENT", "2-HIGH")))


@query("SELECT o_orderkey AS row_ix, CASE WHEN trim(o_orderstatus) IN ('F', 'O') AND trim(o_orderpriority) IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS value FROM orders")
def row_filter_preserving(spark, d):
    return R.values_keeping_rows(table(spark, d, "orders"), F.col("o_orderkey"), "o_orderpriority", _FILTERS)


@query("SELECT l_returnflag, count(*) AS total, count(*) FILTER (trim(l_returnflag) IN ('A', 'R') AND trim(l_linestatus) = 'F') AS included FROM lineitem GROUP BY l_returnflag")
def row_filter_and_or(spark, d):
    li = table(spark, d, "lineitem")
    ok = R.passes(li, (R.RowFilter("l_returnflag", ("A", "R")), R.RowFilter("l_linestatus", ("F",))))
    return li.groupBy("l_returnflag").agg(F.count("*").alias("total"), F.count_if(ok).alias("included"))


_PROFILED = {"customer": ("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "documents": ("doc_id", "text", "lang", "source", "n_chars"), "conversations": ("conv_id", "turn", "role", "text"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")}
_TEXTS = {"c_name", "c_mktsegment", "text", "lang", "source", "role", "o_orderstatus", "o_orderpriority"}


def _profile_sql(t: str, c: str) -> str:
    v = f"nullif(trim(CAST({c} AS VARCHAR), E' \\t\\n\\r\\x0b\\x0c'), '')"
    return f"""SELECT '{t}' AS sheet, '{c}' AS name, count({v}) AS non_empty_count, count(*) - count({v}) AS empty_count, least(count(DISTINCT {v}), 200000) AS unique_count,
        CAST(coalesce(sum(length({v})), 0) AS BIGINT) AS total_length, {'true' if c in _TEXTS else 'false'} AND coalesce(sum(length({v})) * 1.0 / count({v}), 0) >= 14.995 AS is_likely_text FROM {t}"""


@query(" UNION ALL ".join(_profile_sql(t, c) for t, cs in _PROFILED.items() for c in cs))
def column_profile(spark, d):
    out = None
    for t, cs in _PROFILED.items():
        p = PR.column_profile(table(spark, d, t), list(cs)).select(F.lit(t).alias("sheet"), "name", "non_empty_count", "empty_count", "unique_count", "total_length", "is_likely_text")
        out = p if out is None else out.unionByName(p)
    return out


@query(
    f"""WITH c AS (SELECT conv_id * 1000 + turn AS row_ix, unnest(['role', 'text']) AS name, unnest([role, text]) AS v FROM conversations),
    r AS (SELECT name, row_ix, {Q.redact(Q.collapse('v'))} AS x FROM c), s AS (SELECT name, min(row_ix) AS first, {Q.truncate('x', 80)} AS sample FROM r WHERE x <> '' GROUP BY name, sample),
    k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first, sample) AS k FROM s) SELECT name, string_agg(sample, ' | ' ORDER BY k) AS samples FROM k WHERE k <= 3 GROUP BY name"""
)
def sample_values(spark, d):
    t = table(spark, d, "conversations")
    return PR.sample_values(t, F.col("conv_id") * 1000 + F.col("turn"), ["role", "text"]).select("name", F.array_join("samples", " | ").alias("samples"))


@query("SELECT event_type AS sheet, count(*) AS row_count, count(*) > 100000 AS exceeds_limit FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*), (SELECT max(n) > 100000 FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) FROM events")
def sheet_rollup(spark, d):
    return PR.sheet_rows(table(spark, d, "events"), "event_type").select("sheet", F.col("row_count").cast("long").alias("row_count"), "exceeds_limit")


_LIKELY = "coalesce(avg(length(nullif(trim({c}, E' \\t\\n\\r\\x0b\\x0c'), ''))) >= 14.995, false)"


@query(
    f"""WITH p AS (SELECT {_LIKELY.format(c="text")} AS body, {_LIKELY.format(c="role")} AS who FROM conversations)
    SELECT unnest(['text', 'session', 'order', 'role', 'message_type']) AS field, unnest([CASE WHEN who THEN 'direction' WHEN body THEN 'body' END, 'session_id', NULL, 'direction', NULL]) AS name FROM p"""
)
def suggested_columns(spark, d):
    t = table(spark, d, "conversations")
    named = t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("Message_Order"), F.col("role").alias("direction"), F.col("text").alias("body"))
    return PR.suggested_columns(PR.column_profile(named))


# --- conversations ------------------------------------------------------------------------------

_CONV = R.Conversation("conv_id", "turn", "role", "kind")


def _conversation(spark, d):
    t = table(spark, d, "conversations").withColumn("kind", F.lit("text"))
    return R.conversation_rows(t, F.col("conv_id") * 1000 + F.col("turn"), "text", _CONV)


_CTX = (
    "WITH "
    + Q.messages("(SELECT *, conv_id * 1000 + turn AS r FROM conversations)", "r", "text")
    + ", "
    + """x AS (SELECT m.*, c.role, c.conv_id FROM m JOIN conversations c ON m.row_ix = c.conv_id * 1000 + c.turn WHERE c.role IN ('user', 'assistant') AND status IN ('analyzed', 'courtesy')),
    w AS (SELECT *, list({'role': role, 'text': masked}) OVER (PARTITION BY conv_id ORDER BY row_ix ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ctx FROM x),"""
    + f"""n AS (SELECT row_ix, role, masked, key, redacted, status, ctx, left(sha256('target' || chr(0) || key || array_to_string(list_transform(coalesce(ctx, []), lambda t: chr(31) || t.role || chr(0) || {Q.normalize('t.text')}), '')), 16) AS id FROM w)"""
)


@query(f"{_CTX} SELECT row_ix, CAST(coalesce(len(ctx), 0) AS INTEGER) AS turns, coalesce(array_to_string(list_transform(ctx, lambda t: t.role || ': ' || t.text), chr(10)), '') AS context FROM n WHERE role = 'user' AND status = 'analyzed'")
def context_window(spark, d):
    rows = P.contextual_messages(_conversation(spark, d), _CONV).where("status = 'analyzed'")
    return rows.select("row_ix", F.size("context").alias("turns"), F.array_join(F.transform("context", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("context"))


@query(f"{_CTX} SELECT id AS record_id, count(*) AS count FROM n WHERE role = 'user' AND status = 'analyzed' GROUP BY id")
def contextual_groups(spark, d):
    return P.groups(P.contextual_messages(_conversation(spark, d), _CONV)).select("record_id", "count")


@query(
    f"""{_CTX} SELECT (SELECT count(*) FROM conversations) AS total_rows, count(*) FILTER (role = 'user' AND status = 'analyzed') AS analyzed_count, count(*) FILTER (role = 'assistant') AS context_only_count,
    (SELECT count(*) FROM conversations) - count(*) FILTER (role = 'user' AND status = 'analyzed') - count(*) FILTER (role = 'assistant') AS discarded_count,
    count(*) FILTER (role = 'user' AND status = 'analyzed' AND redacted) AS redacted_count, count(DISTINCT id) FILTER (role = 'user' AND status = 'analyzed') AS unique_count,
    count(*) FILTER (role = 'user' AND status = 'analyzed') - count(DISTINCT id) FILTER (role = 'user' AND status = 'analyzed') AS duplicate_count FROM n"""
)
def contextual_summary(spark, d):
    return P.summary(P.contextual_messages(_conversation(spark, d), _CONV))


@query(
    """WITH e AS (SELECT event_id AS source_row, CAST(user_id AS VARCHAR) AS session_id, CAST(floor(value) AS BIGINT) AS o FROM events),
    l AS (SELECT *, lag(o) OVER (PARTITION BY session_id ORDER BY source_row) AS b FROM e) SELECT source_row, session_id, CAST(o AS VARCHAR) AS message_order FROM l WHERE o < b"""
)
def order_violations(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("s"), F.floor("value").alias("o"), F.lit("user").alias("r"), F.lit("text").alias("k"), F.lit("x").alias("t"))
    c = R.Conversation("s", "o", "r", "k")
    return P.order_violations(R.conversation_rows(e, F.col("event_id"), "t", c), c)


# --- classification and counts ----------------------------------------------------------------


@query(f"{QST} SELECT array_to_string(signature, ' ') AS signature, count, n_records FROM buckets")
def signature_bucket_counts(spark, d):
    return signature_buckets(_groups(spark, d)).select(F.array_join("signature", " ").alias("signature"), "count", "n_records")


@query(f"{QST} SELECT token, freq FROM corpus")
def token_frequencies(spark, d):
    return token_corpus(_groups(spark, d))


@query(f"{QST} SELECT question_id, array_to_string(signature, ' ') AS signature, count FROM q")
def question_numbering(spark, d):
    return Deterministic().questions(_groups(spark, d)).select("question_id", F.array_join("signature", " ").alias("signature"), "count")


@query(f"{QST} SELECT question_id, theme_id, theme_name FROM q")
def theme_assign(spark, d):
    return Deterministic().questions(_groups(spark, d)).select("question_id", "theme_id", "theme_name")


def _analysis(spark, d, top_n=10):
    return analyze(_spread(_docs(spark, d)), F.col("doc_id"), R.Request("text", top_n=top_n))


_N = "(SELECT count(*) FROM m WHERE status = 'analyzed')"
TOP = f"{QST}, top AS (SELECT question_id, canonical_question, position, theme_id, count, signature FROM q ORDER BY count DESC, question_id LIMIT 10)"


@query(f"{TOP} SELECT question_id, canonical_question, count, {Q.percentage('count', _N)} AS percentage FROM top")
def top_questions(spark, d):
    return _analysis(spark, d).top.select("question_id", "canonical_question", "count", "percentage")


@query(
    f"""{TOP}, ex AS (SELECT t.question_id, s.count, s.record_id, unnest(s.examples) AS example, generate_subscripts(s.examples, 1) AS pos FROM top t JOIN s USING (signature)),
    f AS (SELECT question_id, example, min((-count, record_id, pos)) AS first FROM ex GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first) AS k FROM f)
    SELECT question_id, string_agg(example, chr(10) ORDER BY k) AS examples FROM k WHERE k <= 3 GROUP BY question_id"""
)
def question_examples(spark, d):
    return _analysis(spark, d).top.select("question_id", F.array_join("examples", "\n").alias("examples"))


@query(f"{QST} SELECT theme_id, arg_min(theme_name, position) AS name, CAST(sum(count) AS BIGINT) AS count, {Q.percentage('sum(count)', _N)} AS percentage FROM q GROUP BY theme_id")
def themes(spark, d):
    return _analysis(spark, d).themes.select("theme_id", "name", "count", "percentage")


@query(f"{TOP} SELECT theme_id, string_agg(question_id, ',' ORDER BY position) AS related FROM top GROUP BY theme_id")
def related_questions(spark, d):
    return _analysis(spark, d).themes.where(F.size("related") > 0).select("theme_id", F.array_join("related", ",").alias("related"))


@query(
    f"""{QST}, t AS (SELECT theme_id, CAST(sum(count) AS BIGINT) AS count FROM q GROUP BY theme_id), r AS (SELECT *, row_number() OVER (ORDER BY count DESC, theme_id) AS k, count(*) OVER () AS n FROM t)
    SELECT CASE WHEN n <= 6 OR k <= 5 THEN theme_id ELSE 'other' END AS label, CAST(sum(count) AS BIGINT) AS count FROM r GROUP BY 1"""
)
def theme_fold(spark, d):
    return A.folded_themes(_analysis(spark, d).themes).select("label", "count")


@query(f"{TOP} SELECT question_id, count::DOUBLE / max(count) OVER () AS bar, count::DOUBLE / sum(count) OVER () AS segment FROM top")
def display_shares(spark, d):
    return A.display_shares(_analysis(spark, d).top).select("question_id", "bar", "segment")


@query()
def report(spark, d):
    return _analysis(spark, d).report


@query("SELECT 'none' AS rule WHERE false")
def report_violations(spark, d):
    return A.report_violations(_analysis(spark, d).report)


# --- mappings ----------------------------------------------------------------------------------

# A mapping as a model might return it: some records twice, some never, some unknown, some of unlisted categories.
_MAPPED = """mapped AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, doc_id % 7 AS chunk, doc_id AS pos, 'c' || (doc_id % 5) AS category FROM labels
    UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id % 11, doc_id + 1000000000, 'c' || (doc_id % 6) FROM labels WHERE doc_id % 4 = 0
    UNION ALL SELECT 'x' || doc_id, 0, doc_id, 'c0' FROM labels WHERE quality = 0)"""
_FIRST = f"""WITH {_MAPPED}, known AS (SELECT * FROM mapped WHERE record_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) AND category IN ('c0', 'c1', 'c2', 'c3')),
    one AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY chunk, pos) AS k FROM known)"""


def _mapping(spark, d):
    lb = table(spark, d, "labels")
    make = lambda rows, prefix, chunk, cat, later=0: rows.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("record_id"), chunk.cast("long").alias("chunk"), (F.col("doc_id") + later).alias("pos"), cat.alias("category"))
    cat = lambda n: F.concat(F.lit("c"), (F.col("doc_id") % n).cast("string"))
    mapped = make(lb, "", F.col("doc_id") % 7, cat(5)).union(make(lb.where("doc_id % 4 = 0"), "", F.col("doc_id") % 11, cat(6), 1_000_000_000)).union(make(lb.where("quality = 0"), "x", F.lit(0), F.lit("c0")))
    cats = spark.createDataFrame([(f"c{i}",) for i in range(4)], "category string")
    groups = _docs(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), F.lit(1).cast("long").alias("count"))
    return mapped, cats, groups


@query(f"{_FIRST} SELECT record_id, category FROM one WHERE k = 1 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unassigned' FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT record_id FROM one)")
def repaired_assignments(spark, d):
    return M.repaired(*_mapping(spark, d))[0]


@query(
    f"""{_FIRST}, t AS (SELECT m.*, m.record_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) AS known, m.category IN ('c0', 'c1', 'c2', 'c3') AS listed, o.chunk AS c1, o.pos AS p1
        FROM mapped m LEFT JOIN (SELECT * FROM one WHERE k = 1) o ON m.record_id = o.record_id)
    SELECT code, CAST(n AS BIGINT) AS n FROM (SELECT 'LLM_UNKNOWN_RECORD_ID' AS code, (SELECT count(*) FROM t WHERE NOT known OR (NOT listed AND (c1 IS NULL OR (chunk, pos) <= (c1, p1)))) AS n
    UNION ALL SELECT 'LLM_DUPLICATE_ASSIGNMENT', (SELECT count(*) FROM t WHERE known AND c1 IS NOT NULL AND (chunk, pos) > (c1, p1))
    UNION ALL SELECT 'LLM_UNASSIGNED_RECORDS', (SELECT count(*) FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT record_id FROM one))) WHERE n > 0"""
)
def mapping_warnings(spark, d):
    return M.repaired(*_mapping(spark, d))[1]


@query(f"WITH {_MAPPED} SELECT CAST(doc_id AS VARCHAR) AS record_id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT record_id FROM mapped)")
def unassigned_anti(spark, d):
    mapped, _, groups = _mapping(spark, d)
    return M.unassigned(groups, mapped)


@query(f"WITH {_MAPPED} SELECT record_id, count(*) - 1 AS extra FROM mapped GROUP BY record_id HAVING count(*) > 1")
def duplicate_assignments(spark, d):
    return M.duplicate_assignments(_mapping(spark, d)[0])


@query(f"WITH {_MAPPED} SELECT record_id, count(*) AS n FROM mapped WHERE record_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) GROUP BY record_id")
def unknown_ids(spark, d):
    mapped, _, groups = _mapping(spark, d)
    return M.unknown_ids(mapped, groups)


@query(f"WITH {_MAPPED} SELECT record_id, chunk, pos, category FROM mapped WHERE category NOT IN ('c0', 'c1', 'c2', 'c3')")
def missing_category(spark, d):
    mapped, cats, _ = _mapping(spark, d)
    return M.missing_categories(mapped, cats).select("record_id", "chunk", "pos", "category")


@query("SELECT (SELECT count(*) FROM (SELECT text FROM documents EXCEPT SELECT text FROM benchmark)) AS only_documents, (SELECT count(*) FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)) AS both_, (SELECT count(*) FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)) AS either")
def message_sets(spark, d):
    a, b = _docs(spark, d).select("text"), table(spark, d, "benchmark").select("text")
    sides = a.select("text", F.lit(1).alias("s")).union(b.select("text", F.lit(2))).groupBy("text").agg(F.bit_or("s").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 1).alias("only_documents"), F.count_if(F.col("s") == 3).alias("both_"), F.count("*").alias("either"))


# --- cost ----------------------------------------------------------------------------------------

_TOKENS = "CAST(length('<kayit id=\"' || record_id || '\">' || redacted_text || '</kayit>') // 3 + 12 AS BIGINT)"


@query(f"{GRP} SELECT record_id, {_TOKENS} AS tokens FROM g")
def record_tokens(spark, d):
    return C.sized(_groups(spark, d)).select("record_id", F.col("tokens").cast("long").alias("tokens"))


@query(
    f"""WITH RECURSIVE {GRP.removeprefix("WITH ")}, o AS (SELECT record_id, {_TOKENS} AS tokens, row_number() OVER (ORDER BY count DESC, record_id) AS i FROM g),
    walk AS (SELECT i, record_id, tokens, 0 AS chunk, 1 AS records, tokens AS used FROM o WHERE i = 1
        UNION ALL SELECT o.i, o.record_id, o.tokens, CASE WHEN w.records >= 120 OR w.used + o.tokens > 12000 THEN w.chunk + 1 ELSE w.chunk END,
            CASE WHEN w.records >= 120 OR w.used + o.tokens > 12000 THEN 1 ELSE w.records + 1 END, CASE WHEN w.records >= 120 OR w.used + o.tokens > 12000 THEN o.tokens ELSE w.used + o.tokens END
        FROM walk w JOIN o ON o.i = w.i + 1) SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS records, CAST(sum(tokens) AS BIGINT) AS tokens FROM walk GROUP BY chunk"""
)
def chunks(spark, d):
    return C.chunk_sizes(C.chunks(C.sized(_groups(spark, d))))


_SIZES = ORACLE["chunks"].replace("SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS records, CAST(sum(tokens) AS BIGINT) AS tokens FROM walk GROUP BY chunk", "")


@query(
    f"""{_SIZES}, sizes AS (SELECT chunk, count(*) AS records, sum(tokens) AS tokens FROM walk GROUP BY chunk),
    map_calls AS (SELECT count(*) AS chunks, coalesce(sum(tokens), 0) + count(*) * 900 AS prompt, count(*) * 200 + coalesce(sum(records), 0) * 60 AS completion FROM sizes),
    rounds AS (
        SELECT retain, CASE WHEN chunks > 1 THEN 20 * chunks ELSE 0 END AS left_, CAST(prompt AS DOUBLE) AS prompt, CAST(completion AS DOUBLE) AS completion FROM map_calls, (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) AS t(retain)
        UNION ALL
        SELECT retain, CASE WHEN left_ <= 500 OR greatest((left_ + 499) // 500, CAST(floor(left_ * retain + 0.999) AS BIGINT)) >= left_ THEN 1 ELSE greatest((left_ + 499) // 500, CAST(floor(left_ * retain + 0.999) AS BIGINT)) END,
            prompt + 700 * (left_ // 500 + CASE WHEN left_ % 500 > 1 THEN 1 ELSE 0 END) + 24 * (left_ - CASE WHEN left_ % 500 = 1 THEN 1 ELSE 0 END),
            completion + 200 * (left_ // 500 + CASE WHEN left_ % 500 > 1 THEN 1 ELSE 0 END) + 50 * (left_ - CASE WHEN left_ % 500 = 1 THEN 1 ELSE 0 END)
        FROM rounds WHERE left_ > 1
    ), costs AS (SELECT retain, CAST(format('{{:.6f}}', max(prompt) / 1000000 * 0.15::DOUBLE + max(completion) / 1000000 * 0.6::DOUBLE) AS DOUBLE) AS cost FROM rounds GROUP BY retain)
    SELECT min(cost) FILTER (retain = 0.5) AS expected_cost, min(cost) FILTER (retain = 0.8) AS upper_cost, min(cost) FILTER (retain = 0.5) > 5.0 AS exceeds FROM costs"""
)
def cost_estimate(spark, d):
    sizes = C.chunk_sizes(C.chunks(C.sized(_groups(spark, d))))
    return C.cost_decision(C.map_estimate(sizes, 900), 0.15, 0.6, 5.0, 700)


@query(
    """SELECT conv_id, CAST(format('{:.6f}', (p - c - w) / 1000000.0::DOUBLE * 0.15::DOUBLE + c / 1000000.0::DOUBLE * 0.075::DOUBLE + w / 1000000.0::DOUBLE * 0.15::DOUBLE + o / 1000000.0::DOUBLE * 0.6::DOUBLE) AS DOUBLE) AS cost FROM (SELECT conv_id, p, o, least(p // 2, p)::DOUBLE AS c, least(p // 4, p - least(p // 2, p))::DOUBLE AS w
    FROM (SELECT conv_id, sum(length(text)) FILTER (role <> 'assistant') AS p, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS o FROM conversations GROUP BY conv_id) WHERE p IS NOT NULL)"""
)
def usage_cost(spark, d):
    n = F.length("text")
    calls = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", n)).alias("p"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).alias("o")).where("p is not null")
    half, quarter = F.floor(F.col("p") / 2), F.floor(F.col("p") / 4)
    return calls.select("conv_id", S.usage_cost(F.col("p"), F.col("o"), half, quarter, F.lit(0.15), F.lit(0.6), F.lit(0.075), F.lit(None).cast("double")).alias("cost"))


@query(
    """WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS model_id, p_size / 10.0::DOUBLE AS in_rate, p_size / 5.0::DOUBLE AS out_rate, p_partkey % 4 AS k FROM part)
    SELECT model_id, CASE WHEN k = 0 THEN 0.25::DOUBLE ELSE in_rate END AS in_rate, CASE WHEN k = 0 THEN 1.5::DOUBLE ELSE out_rate END AS out_rate, CASE WHEN k = 0 THEN 'live' ELSE 'fallback' END AS price_source FROM m"""
)
def price_fallback_join(spark, d):
    """Every part a model: a quarter have a live price, a quarter a negative one, a quarter one that is no number, a quarter none."""
    p = table(spark, d, "part")
    k, ident = F.col("p_partkey") % 4, F.col("p_partkey").cast("string").alias("model_id")
    models = p.select(ident, (F.col("p_size") / 10.0).alias("in_rate"), (F.col("p_size") / 5.0).alias("out_rate"))
    live = p.where(k < 3).select(ident, F.when(k == 0, "0.00000025").when(k == 1, "-1").otherwise("x").alias("prompt"), F.lit("0.0000015").alias("completion"))
    return C.prices(models, live)


# --- retention -------------------------------------------------------------------------------------

_JOBS = f"""jobs AS (SELECT o_orderkey AS job_id, o_custkey AS upload_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'analyzing' END AS status, o_orderkey % 5 = 0 AS cancel_requested,
    o_orderkey % 3 <> 0 AND o_orderstatus = 'F' AS has_report, TIMESTAMP '{NOW}' - to_hours(CAST(o_orderkey % 72 AS INTEGER)) AS updated_at FROM orders),
    uploads AS (SELECT c_custkey AS upload_id, 'k' || c_custkey AS storage_key, TIMESTAMP '{NOW}' - to_hours(CAST(c_custkey % 60 AS INTEGER)) AS updated_at FROM customer),
    objects AS (SELECT 'k' || event_id AS key, TIMESTAMP '{NOW}' - to_hours(CAST(event_id % 50 AS INTEGER)) AS last_modified FROM events)"""
_OLD = f"TIMESTAMP '{NOW}' - INTERVAL 24 HOURS"


def _tables(spark, d):
    now = F.lit(NOW).cast("timestamp")
    back = lambda c, n: F.timestamp_seconds(F.unix_timestamp(now) - (F.col(c) % n) * 3600)
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("analyzing")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("upload_id"), status.alias("status"), (F.col("o_orderkey") % 5 == 0).alias("cancel_requested"), F.when((F.col("o_orderkey") % 3 != 0) & (F.col("o_orderstatus") == "F"), "{}").alias("report"), back("o_orderkey", 72).alias("updated_at"))
    uploads = table(spark, d, "customer").select(F.col("c_custkey").alias("upload_id"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("storage_key"), back("c_custkey", 60).alias("updated_at"))
    objects = table(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), back("event_id", 50).alias("last_modified"))
    return jobs, uploads, objects, now


@query(f"WITH {_JOBS} SELECT job_id FROM jobs WHERE status IN ('completed', 'failed', 'cancelled') AND updated_at < {_OLD}")
def expired_jobs(spark, d):
    jobs, _, _, now = _tables(spark, d)
    return RT.expired_jobs(jobs, now).select("job_id")


@query(f"WITH {_JOBS} SELECT upload_id FROM uploads u WHERE updated_at < {_OLD} AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.upload_id = u.upload_id AND (status NOT IN ('completed', 'failed', 'cancelled') OR (has_report AND j.updated_at >= {_OLD})))")
def expired_uploads_not_exists(spark, d):
    jobs, uploads, _, now = _tables(spark, d)
    return RT.expired_uploads(uploads, jobs, now).select("upload_id")


@query(f"WITH {_JOBS} SELECT key FROM objects WHERE last_modified < {_OLD} AND key NOT IN (SELECT storage_key FROM uploads)")
def orphan_objects(spark, d):
    _, uploads, objects, now = _tables(spark, d)
    return RT.orphan_objects(objects, uploads, now).select("key")


@query(f"WITH {_JOBS} SELECT job_id, upload_id FROM jobs WHERE NOT cancel_requested AND status NOT IN ('completed', 'failed', 'cancelled')")
def live_jobs(spark, d):
    return RT.live_jobs(_tables(spark, d)[0]).select("job_id", "upload_id")


@query(f"WITH {_JOBS} SELECT job_id, storage_key FROM jobs JOIN uploads USING (upload_id) WHERE status = 'analyzing'")
def jobs_with_uploads(spark, d):
    jobs, uploads, _, _ = _tables(spark, d)
    return jobs.where("status = 'analyzing'").join(uploads.select("upload_id", "storage_key"), "upload_id").select("job_id", "storage_key")


@query(
    f"""WITH {_JOBS}, j1 AS (SELECT * FROM jobs WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND updated_at < {_OLD})),
    gu AS (SELECT upload_id, storage_key FROM uploads u WHERE updated_at < {_OLD} AND NOT EXISTS (SELECT 1 FROM j1 j WHERE j.upload_id = u.upload_id AND (status NOT IN ('completed', 'failed', 'cancelled') OR (has_report AND j.updated_at >= {_OLD})))),
    go AS (SELECT key FROM objects WHERE last_modified < {_OLD} AND key NOT IN (SELECT storage_key FROM uploads WHERE upload_id NOT IN (SELECT upload_id FROM gu)) UNION SELECT storage_key FROM gu)
    SELECT 'jobs' AS kind, (SELECT count(*) FROM jobs) - (SELECT count(*) FROM j1) AS removed UNION ALL SELECT 'uploads', (SELECT count(*) FROM gu) UNION ALL SELECT 'objects', (SELECT count(*) FROM go)"""
)
def sweep_counts(spark, d):
    jobs, uploads, objects, now = _tables(spark, d)
    return RT.sweep(jobs, uploads, objects, now)["counts"]


@query(
    f"""WITH {_JOBS} SELECT job_id, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN NULL WHEN job_id % 100 = 0 THEN 270.0::DOUBLE
    ELSE round(least((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(updated_at)) / 1000.0::DOUBLE * (100.0::DOUBLE - job_id % 100) / (job_id % 100), 2700.0::DOUBLE), 1) END AS eta FROM jobs"""
)
def eta(spark, d):
    jobs, _, _, now = _tables(spark, d)
    return jobs.select("job_id", S.eta(F.col("status"), (F.col("job_id") % 100).cast("double"), F.col("updated_at"), now).alias("eta"))


# --- streams -----------------------------------------------------------------------------------------


@query(ORACLE["dedupe_events"].replace("SELECT record_id, redacted_text, count FROM g", "SELECT record_id, count FROM g"))
def stream_dedupe(spark, d):
    return ST.dedupe_counts(spark, f"{d}/events.parquet", "event_id", "event_type")


@query(f"{_CTX} SELECT row_ix, CAST(coalesce(len(ctx), 0) AS INTEGER) AS turns, id AS record_id FROM n WHERE role = 'user' AND status = 'analyzed'")
def stream_context(spark, d):
    return ST.contextual_ids(spark, f"{d}/conversations.parquet").select("row_ix", F.size("context").alias("turns"), "record_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_first_events(spark, d):
    return ST.first_events(spark, f"{d}/events.parquet")


@query(
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    c AS (SELECT user_id, event_id, ts, event_type, i FROM e WHERE i = 1 UNION ALL
        SELECT n.user_id, n.event_id, n.ts, n.event_type, n.i FROM c, LATERAL (SELECT * FROM e WHERE e.user_id = c.user_id AND e.ts >= c.ts + INTERVAL 24 HOURS ORDER BY i LIMIT 1) n)
    SELECT e.event_id, c.event_id AS claim_id, CASE WHEN e.event_id = c.event_id THEN 'claimed' WHEN e.event_type = c.event_type THEN 'replay' ELSE 'conflict' END AS outcome
    FROM e ASOF JOIN c ON e.user_id = c.user_id AND e.i >= c.i"""
)
def stream_idempotency(spark, d):
    events = ST.read_table(spark, f"{d}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("fingerprint"), "ts")
    return ST.run_to_end(ST.claims(events), "append")
