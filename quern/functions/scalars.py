"""Numbers, times and JSON as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

#: Fixed values of the estimates.
CHARS_PER_TOKEN, RECORD_OVERHEAD = 3, 12
MAP_BASE, MAP_PER_RECORD = 200, 60
REDUCE_BASE, REDUCE_PER_CATEGORY, REDUCE_PROMPT_PER_CATEGORY = 200, 50, 24
EXPECTED_RETAIN, CAUTIOUS_RETAIN = 0.50, 0.80
HARD_TIMEOUT = 45 * 60
TERMINAL = ("completed", "failed", "cancelled")
#: Progress at the start of each stage, in percent.
STAGES = {"queued": 0.0, "validating": 5.0, "preprocessing": 20.0, "analyzing": 40.0, "aggregating": 90.0, "completed": 100.0, "failed": 100.0, "cancelled": 100.0}


def percentage(count: Column, total: Column) -> Column:
    """count of total in percent, one decimal, halves up; integer arithmetic, 0 of an empty total."""
    c, t = count.cast("long"), total.cast("long")
    up = 2 * c * 1000 + t
    tenths = (up - F.pmod(up, F.nullif(2 * t, F.lit(0)))) / F.nullif(2 * t, F.lit(0))
    return F.coalesce(tenths / F.lit(10.0), F.lit(0.0))


def record_tokens(rendered: Column) -> Column:
    return F.floor(F.length(rendered) / CHARS_PER_TOKEN) + RECORD_OVERHEAD


def half_even(value: Column, digits: int) -> Column:
    """A double rounded to decimal digits, halves to even, by its binary value and not by the decimals it prints as.

    5e-7 lies just under the half of a millionth and goes down. value * 10**digits is split into
    the product that a double holds and its error, which is exact as 10**digits has few bits.
    """
    scale, v = F.lit(10.0**digits), value.cast("double")
    split = v * F.lit(134217729.0)
    high = split - (split - v)
    product = v * scale
    error = (high * scale - product) + (v - high) * scale
    below = F.floor(product)
    over = (product - below - 0.5) + error
    up = F.when((over > 0) | ((over == 0) & (below % 2 != 0)), 1).otherwise(0)
    # From 2**44 on products of six digits have no halves, and what is not finite stays as it is.
    return F.when(F.abs(product) < 2.0**50, (below + up) / scale).otherwise(v)


def token_cost(prompt: Column, completion: Column, in_rate: Column, out_rate: Column, digits: int = 6) -> Column:
    """USD of tokens at rates a million; 0 where a rate is unknown."""
    cost = prompt / 1_000_000 * in_rate + completion / 1_000_000 * out_rate
    return F.coalesce(half_even(cost, digits), F.lit(0.0))


def catalog_cost(prompt: Column, completion: Column, model: Column, in_rate: Column, out_rate: Column) -> Column:
    """The same to four digits, at a catalog's rates; a model that the catalog lacks is an error."""
    missing = F.raise_error(F.concat(F.lit("no price of model "), F.coalesce(model, F.lit("null"))))
    known = in_rate.isNotNull() & out_rate.isNotNull()
    return F.when(known, token_cost(prompt, completion, in_rate, out_rate, 4)).otherwise(missing.cast("double"))


def usage_cost(prompt: Column, completion: Column, cached: Column, written: Column, in_rate: Column, out_rate: Column, read_rate: Column, write_rate: Column) -> Column:
    """The same with cache rates: cached and written tokens are clamped to the prompt, unknown cache rates are the input rate."""
    zero = F.lit(0)
    p = F.greatest(zero, prompt)
    c = F.least(F.greatest(zero, cached), p)
    w = F.least(F.greatest(zero, written), F.greatest(zero, prompt - c))
    regular = F.greatest(zero, prompt - c - w)
    cost = regular / 1_000_000 * in_rate + c / 1_000_000 * F.coalesce(read_rate, in_rate) + w / 1_000_000 * F.coalesce(write_rate, in_rate) + completion / 1_000_000 * out_rate
    return F.coalesce(half_even(cost, 6), F.lit(0.0))


def casefold(c: Column) -> Column:
    """Lower case for comparison: sharp s as two letters, final sigma as any other."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def order_key(value: Column) -> Column:
    """struct(kind, number, text): numbers sort as numbers, other values as folded text; kind is error for NaN and infinities.

    number is (sign, magnitude, digits): where the first digit stands, then the digits from
    there as text, so numbers of any length compare exactly. Below zero both are turned round.
    """
    plain = collapse(value)
    not_finite = plain.rlike(r"(?i)^[+-]?(s?nan\d*|inf|infinity)$")
    is_number = plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    mantissa = F.regexp_extract(plain, r"^[+-]?([0-9.]+)", 1)
    power = F.coalesce(F.regexp_extract(plain, r"[eE]([+-]?[0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    whole = F.regexp_replace(F.split_part(mantissa, F.lit("."), F.lit(1)), "^0+", "")
    fraction = F.split_part(mantissa, F.lit("."), F.lit(2))
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+|0+$", "")
    place = F.when(whole != "", F.length(whole)).otherwise(F.length(F.regexp_replace(fraction, "^0+", "")) - F.length(fraction)) + power
    negative = F.startswith(plain, F.lit("-"))
    sign = F.when(digits == "", 0).when(negative, -1).otherwise(1)
    # A shorter run of digits is the lesser number, but the greater one below zero: "~" sorts after all digits.
    shown = F.when(sign < 0, F.concat(F.translate(digits, "0123456789", "9876543210"), F.lit("~"))).otherwise(digits)
    number = F.struct(sign.alias("sign"), (sign * place).alias("magnitude"), shown.alias("digits"))
    kind = F.when(not_finite, "error").when(is_number, "number").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(is_number, number).alias("number"), casefold(value).alias("text"))


def price_per_million(value: Column) -> Column:
    """A price per token as text, a million times; null unless it is finite and not negative."""
    parsed = F.trim(value).try_cast("decimal(38,18)")
    return F.when(parsed >= 0, (parsed * 1_000_000).cast("double"))


def eta(status: Column, progress: Column, created: Column, now: Column, hard_timeout: int = HARD_TIMEOUT) -> Column:
    elapsed = F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(created)) / 1000.0)
    left = F.round(F.least(elapsed * (100.0 - progress) / F.nullif(progress, F.lit(0.0)), F.lit(float(hard_timeout))), 1)
    return F.when(status.isin(*TERMINAL), F.lit(None).cast("double")).when(progress <= 0, F.lit(float(hard_timeout // 10))).otherwise(left)


def stage_progress(stage: Column, done: Column) -> Column:
    """Progress in percent: where a stage starts, and during the analysis the share done of the way to the next."""
    start = F.element_at(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair]), stage)
    way = STAGES["aggregating"] - STAGES["analyzing"]
    return F.when(stage == "analyzing", F.round(start + way * F.least(F.lit(1.0), done), 1)).otherwise(start)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def number_text(value: Column) -> Column:
    """A number as canonical JSON has it: integral values without a fraction, others by their shortest digits.

    The exponent of Java's own form is undone from 0.0001 to below 10**16 and has two digits
    elsewhere.
    """
    java = F.abs(value).cast("string")
    power = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.replace(F.split_part(java, F.lit("E"), F.lit(1)), F.lit("."), F.lit("")), "0+$", "")
    first, rest = F.substring(digits, 1, 1), F.substr(digits, F.lit(2))
    scientific = F.concat(first, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    moved = F.when(power == -4, F.concat(F.lit("0.000"), digits)).when((power >= 7) & (power < 16), F.concat(F.left(digits, power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(scientific)
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.when(power.isNull(), java).otherwise(moved))
    integral = (value % 1 == 0) & (F.abs(value) < 1e21)
    return F.when(integral, value.cast("decimal(38,0)").cast("string")).otherwise(text)


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with sorted keys and no spaces from columns that are JSON texts already; null values are null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_text(value: Column) -> Column:
    """A string as a JSON string; null stays null."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "n", "\r": "r", "\t": "t", "\b": "b", "\f": "f"}
    plain = escaped
    for i in range(32):
        escaped = F.replace(escaped, F.lit(chr(i)), F.lit("\\" + short.get(chr(i), f"u{i:04x}")))
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def thousands(value: Column) -> Column:
    """A count with dots between thousands."""
    return F.translate(F.format_number(value, 0), ",", ".")
