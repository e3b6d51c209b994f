"""DuckDB forms of the text expressions, as an independent check of them."""

from __future__ import annotations

from ..functions import text as T

BLANK = r"[\s\pZ\x{85}\x{1c}-\x{1f}]"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'))"


def normalize(x: str) -> str:
    lower = f"lower(translate({x}, '{T.CAPITALS}', '{T.SMALL}'))"
    return collapse(rf"regexp_replace({lower}, '[^\p{{L}}\p{{N}}_\s\pZ]', ' ', 'g')")


def _guarded(x: str, pattern: str, mask: str) -> str:
    """RE2 has no look-around: neighbours are captured, and a second pass takes matches that shared one."""
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^0-9])({pattern})($|[^0-9])', '\1{mask}\3', 'g')"
    return x


def redact(x: str) -> str:
    x = rf"regexp_replace({x}, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}', '{T.EMAIL_MASK}', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b(?:https?://|www\.)\S+', '{T.URL_MASK}', 'g')"
    x = _guarded(x, r"(?:\+90[\s.\-]?|0)?[\s.\-]?\(?5\d{2}\)?[\s.\-]?\d{3}[\s.\-]?\d{2}[\s.\-]?\d{2}", T.PHONE_MASK)
    x = _guarded(x, r"[1-9]\d{10}", T.ID_MASK)
    return _guarded(x, r"\d{7,12}", T.NUMBER_MASK)


def truncate(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE rtrim(left({x}, {most - 1})) || '…' END"


def tokens(key: str) -> str:
    return rf"list_filter(regexp_extract_all({key}, '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 3 AND t NOT IN ({quoted(dict.fromkeys(T.STOPWORDS))}))"


def signature(toks: str) -> str:
    return f"list_sort(list_filter({toks}, lambda x, i: list_position({toks}, x) = i)[1:3])"


def status(value: str, text: str, key: str) -> str:
    masks = quoted(m.strip("[]").lower().replace("i", "ı") for m in (T.EMAIL_MASK, T.URL_MASK, T.PHONE_MASK, T.ID_MASK, T.NUMBER_MASK))
    system = (
        r"(?i)^\s*\[?(sistem|system|bot|otomatik)($|[^\p{L}\p{N}_])",
        r"(?i)^\s*(görüşme|gorusme|oturum|session)\s+(başladı|basladi|bitti|sonlandı)",
        r"(?i)^\s*(null|n/?a|-{2,}|\.{2,})\s*$",
    )
    is_system = " OR ".join(f"regexp_matches({text}, '{p}')" for p in system)
    return f"""CASE WHEN {value} IS NULL THEN 'null' WHEN {text} = '' THEN 'blank' WHEN length({text}) < 3 THEN 'short' WHEN {is_system} THEN 'system'
        WHEN {normalize(text)} IN ({quoted(T.COURTESY)}) THEN 'courtesy' WHEN {key} = '' THEN 'empty'
        WHEN len(list_filter(string_split({key}, ' '), lambda w: w NOT IN ({masks}))) = 0 THEN 'only_masks' ELSE 'analyzed' END"""


def messages(table: str, row_ix: str, value: str) -> str:
    """CTEs up to m (row_ix, status, masked, key, redacted, record_id)."""
    return f"""m0 AS (SELECT {row_ix} AS row_ix, {value} AS value, {collapse(value)} AS body FROM {table}),
        m1 AS MATERIALIZED (SELECT *, {redact("body")} AS masked FROM m0), m2 AS MATERIALIZED (SELECT *, {normalize("masked")} AS key FROM m1),
        m AS MATERIALIZED (SELECT row_ix, {status("value", "body", "key")} AS status, masked, key, masked <> body AS redacted, left(sha256(key), 16) AS record_id FROM m2)"""


GROUPS = """spelled AS (SELECT record_id, masked, count(*) AS n, count(*) FILTER (redacted) AS r, min(row_ix) AS first, any_value(key) AS key FROM m WHERE status = 'analyzed' GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, first) AS k FROM spelled),
        g AS MATERIALIZED (SELECT record_id, any_value(key) AS key, min(masked) FILTER (k = 1) AS redacted_text, CAST(sum(n) AS BIGINT) AS count, CAST(sum(r) AS BIGINT) AS redacted_count,
            list(masked ORDER BY k) FILTER (k <= 3) AS examples FROM ranked GROUP BY record_id)"""

HEADING = "CASE WHEN trim(text) = '' THEN 'Boş mesaj' ELSE CASE WHEN left({t}, 1) = 'ß' THEN 'SS' ELSE upper(left({t}, 1)) END || substr({t}, 2) END".format(t=f"({truncate('trim(text)', 120)})")

QUESTIONS = f"""s0 AS MATERIALIZED (SELECT *, {tokens("key")} AS toks FROM g), s AS MATERIALIZED (SELECT *, {signature("toks")} AS signature FROM s0),
        buckets AS (SELECT signature, CAST(sum(count) AS BIGINT) AS count, count(*) AS n_records, arg_max(redacted_text, (count, record_id)) AS text FROM s GROUP BY signature),
        corpus AS (SELECT token, CAST(sum(count) AS BIGINT) AS freq FROM (SELECT unnest(signature) AS token, count FROM s) GROUP BY token),
        numbered AS (SELECT *, row_number() OVER (ORDER BY len(signature) = 0, count DESC, signature) AS position FROM buckets),
        chosen AS (SELECT position, arg_max(token, (freq, token)) AS token FROM (SELECT position, unnest(signature) AS token FROM numbered) JOIN corpus USING (token) GROUP BY position),
        q AS MATERIALIZED (SELECT signature, position, count, 'q' || position AS question_id,
            CASE WHEN len(signature) = 0 THEN 'Sınıflandırılamayan kısa mesajlar' ELSE {HEADING} END AS canonical_question,
            CASE WHEN len(signature) = 0 THEN 't-diger' ELSE 't-' || token END AS theme_id,
            CASE WHEN len(signature) = 0 THEN 'Diğer' ELSE CASE WHEN left(token, 1) = 'ß' THEN 'Ss' ELSE upper(left(token, 1)) END || lower(substr(token, 2)) END AS theme_name
            FROM numbered LEFT JOIN chosen USING (position))"""


def percentage(c: str, t: str) -> str:
    return f"CASE WHEN {t} = 0 THEN 0.0::DOUBLE ELSE (((2 * {c} * 1000 + {t}) // (2 * {t}))::DOUBLE / 10.0::DOUBLE) END"
