"""From messages to groups of equal messages with true frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .filters import Conversation

LEAST_LENGTH, EXAMPLES = 3, 3


def message_status(value: Column, least_length: int = LEAST_LENGTH) -> dict[str, Column]:
    """Expressions for a message: status, collapsed text, masked text and key form.

    status says which rule discards it, in this order, or is analyzed.
    """
    text = T.collapse(value)
    masked = T.redact(text)
    key = T.normalize(masked)
    status = (
        F.when(value.isNull(), "null")
        .when(text == "", "blank")
        .when(F.length(text) < least_length, "short")
        .when(T.is_system(text), "system")
        .when(T.is_courtesy(text), "courtesy")
        .when(key == "", "empty")
        .when(T.is_only_masks(key), "only_masks")
        .otherwise("analyzed")
    )
    return {"status": status, "text": text, "masked": masked, "key": key}


def messages(values: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(row_ix, status, masked, key, redacted, record_id) of rows (row_ix, value)."""
    x = message_status(F.col("value"), least_length)
    rows = values.select("row_ix", "value", x["text"].alias("_text")).withColumn("masked", T.redact(F.col("_text"))).withColumn("key", T.normalize(F.col("masked")))
    status = F.when(F.col("value").isNull(), "null").when(F.col("_text") == "", "blank").when(F.length("_text") < least_length, "short").when(T.is_system(F.col("_text")), "system")
    # Masks leave at least as many words as they take in, more than any courtesy has; so a courtesy is its own masked text.
    status = status.when((F.col("masked") == F.col("_text")) & F.col("key").isin(*T.COURTESY), "courtesy")
    status = status.when(F.col("key") == "", "empty").when(T.is_only_masks(F.col("key")), "only_masks").otherwise("analyzed")
    return rows.select("row_ix", status.alias("status"), "masked", "key", (F.col("masked") != F.col("_text")).alias("redacted"), T.record_id(F.col("key")).alias("record_id"))


def analyzed(rows: DataFrame) -> DataFrame:
    """The rows that count. A plain filter would be pushed below the columns it reads, and their
    patterns would run several times a row; a generator's input is computed once."""
    row = F.when(F.col("status") == "analyzed", F.array(F.struct(*rows.columns)))
    return rows.select(F.explode(row).alias("_row")).select("_row.*")


def summary(rows: DataFrame) -> DataFrame:
    """One row of counters from rows with status, redacted and record_id."""
    ok = F.col("status") == "analyzed"
    out = rows.agg(
        F.count("*").alias("total_rows"),
        F.count_if(ok).alias("analyzed_count"),
        F.count_if(F.col("status") == "context").alias("context_only_count"),
        F.count_if(~F.col("status").isin("analyzed", "context")).alias("discarded_count"),
        F.count_if(ok & F.col("redacted")).alias("redacted_count"),
        F.count_distinct(F.when(ok, F.col("record_id"))).alias("unique_count"),
    )
    return out.withColumn("duplicate_count", F.col("analyzed_count") - F.col("unique_count"))


def groups(rows: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(record_id, key, redacted_text, count, redacted_count, examples[, context]) of analyzed rows.

    The spelling seen most stands for the group, of equals the one seen first; examples are the
    first few in that order. Rows are counted by spelling first, which combines before the
    shuffle; the window then ranks spellings, not rows.
    """
    return _grouped(analyzed(rows), examples)


def every_group(rows: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """The same with status, and for each status of other rows one row without texts: what groups and summary are made of in one pass."""
    ok = F.col("status") == "analyzed"
    texts = [F.when(ok, F.col(c)).alias(c) for c in ("record_id", "key", "masked", *(["context"] if "context" in rows.columns else []))]
    return _grouped(rows.select("status", "row_ix", "redacted", *texts), examples, "status")


def summary_of(every: DataFrame) -> DataFrame:
    """The counters of summary from every_group."""
    ok = F.col("status") == "analyzed"
    total = lambda test, c="count": F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0).cast("long"))
    out = every.agg(
        total(F.lit(True)).alias("total_rows"),
        total(ok).alias("analyzed_count"),
        total(F.col("status") == "context").alias("context_only_count"),
        total(~F.col("status").isin("analyzed", "context")).alias("discarded_count"),
        total(ok, "redacted_count").alias("redacted_count"),
        F.count_distinct("record_id").alias("unique_count"),
    )
    return out.withColumn("duplicate_count", F.col("analyzed_count") - F.col("unique_count"))


def _grouped(ok: DataFrame, examples: int, *keys: str) -> DataFrame:
    extra = [F.any_value("context").alias("context")] if "context" in ok.columns else []
    # The key follows from the id; as a grouping column it leaves numbers alone to aggregate, which hash in place.
    spelled = ok.groupBy(*keys, "record_id", "key", "masked").agg(F.count("*").alias("n"), F.count_if("redacted").alias("r"), F.min("row_ix").alias("first"), *extra)
    rank = F.row_number().over(W.partitionBy("record_id").orderBy(F.desc("n"), "first"))
    ranked = spelled.withColumn("k", rank)
    top = F.collect_list(F.when(F.col("k") <= max(1, examples), F.struct("k", "masked")))
    more = [F.any_value("context").alias("context")] if extra else []
    out = ranked.groupBy(*keys, "record_id", "key").agg(F.sum("n").alias("count"), F.sum("r").alias("redacted_count"), top.alias("_top"), *more)
    out = out.withColumn("examples", F.transform(F.array_sort("_top"), lambda x: x["masked"])).drop("_top")
    return out.withColumn("redacted_text", F.get("examples", F.lit(0)))


# --- conversations ----------------------------------------------------------------------------


class ConversationOrderError(ValueError):
    """A session's order goes back; source_row is the first such row."""

    def __init__(self, source_row: int) -> None:
        super().__init__(f"conversation order goes back at row {source_row}")
        self.source_row = source_row


def role_of(role: Column, c: Conversation) -> Column:
    return F.when(role.isin(*c.user_roles), "user").when(role.isin(*c.assistant_roles), "assistant")


def eligible(rows: DataFrame, c: Conversation) -> DataFrame:
    """rows with canonical role and with whether they take part in a session's order at all."""
    known = F.col("included") & F.col("role").isNotNull() & F.col("message_type").isNotNull() & F.col("text").isNotNull()
    who = role_of(F.col("role"), c)
    part = known & who.isNotNull() & F.col("message_type").isin(*c.context_types) & F.col("session_id").isNotNull() & F.col("message_order").isNotNull()
    return rows.withColumn("who", who).withColumn("takes_part", F.coalesce(part, F.lit(False)))


def order_violations(rows: DataFrame, c: Conversation) -> DataFrame:
    """(source_row, session_id, message_order) of rows whose order is before the one before, of another kind, or not finite."""
    from ..functions.scalars import order_key

    seen = eligible(rows, c).where("takes_part").withColumn("k", order_key(F.col("message_order")))
    before = F.lag("k").over(W.partitionBy("session_id").orderBy("source_row"))
    back = F.when(F.col("k.kind") == "number", F.col("k.number") < F.col("b.number")).otherwise(F.col("k.text") < F.col("b.text"))
    bad = (F.col("k.kind") == "error") | (F.col("b").isNotNull() & ((F.col("k.kind") != F.col("b.kind")) | back))
    return seen.withColumn("b", before).where(bad).select("source_row", "session_id", "message_order")


def bounded(turns: Column, max_tokens: int) -> Column:
    """The newest turns that fit 3 characters a token: the one that overflows is cut, then stripped at its end."""
    start = F.struct(F.array().cast("array<struct<role:string,text:string>>").alias("kept"), F.lit(max_tokens * 3).alias("left"))

    def step(acc: Column, turn: Column) -> Column:
        cut = F.when(F.length(turn["text"]) > acc["left"], T.rstrip(F.substring(turn["text"], F.lit(1), acc["left"]))).otherwise(turn["text"])
        taken = F.struct(F.concat(F.array(F.struct(turn["role"].alias("role"), cut.alias("text"))), acc["kept"]).alias("kept"), (acc["left"] - F.length(cut)).alias("left"))
        return F.when((acc["left"] <= 0) | (cut == ""), acc).otherwise(taken)

    return F.aggregate(F.reverse(turns), start, step, lambda acc: acc["kept"])


def contextual_messages(rows: DataFrame, c: Conversation, least_length: int = LEAST_LENGTH, check: bool = True) -> DataFrame:
    """(row_ix, status, masked, key, redacted, record_id, context) of conversation rows.

    Targets are user messages of target types; status analyzed marks those that count, context
    the other rows fit to be context. Only rows that count have a context and an id. Rows pass
    once: a session's window holds its fit rows, which loses no target, and each other row has
    one of its own. With check, a session whose order goes back is an error.
    """
    if check and (bad := order_violations(rows, c).agg(F.min("source_row")).first()[0]) is not None:
        raise ConversationOrderError(bad)
    x = message_status(F.col("text"), least_length)
    rows = eligible(rows, c).withColumn("_text", x["text"]).withColumn("masked", T.redact(F.col("_text"))).withColumn("key", T.normalize(F.col("masked")))
    fit = F.col("takes_part") & (F.length("_text") >= least_length) & ~T.is_system(F.col("_text")) & (F.col("key") != "") & ~T.is_only_masks(F.col("key"))
    target = F.col("takes_part") & (F.col("who") == "user") & F.col("message_type").isin(*c.target_types)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)) & (F.col("_text") != "")).withColumn("target", F.coalesce(target, F.lit(False)))
    status = F.when(F.col("target") & F.col("fit") & ~T.is_courtesy(F.col("_text")), "analyzed").when(F.col("fit") & ~F.col("target"), "context").otherwise("discarded")
    rows = rows.withColumn("status", status)
    rows = rows.select("source_row", "session_id", "who", "status", "masked", "key", "fit", (F.col("fit") & (F.col("masked") != F.col("_text"))).alias("redacted"))
    own = F.when(~F.col("fit"), F.col("source_row"))
    before = W.partitionBy(F.when(F.col("fit"), F.col("session_id")), own).orderBy("source_row").rowsBetween(-c.max_turns, -1)
    turn = F.struct(F.col("who").alias("role"), F.col("masked").alias("text"))
    counts = F.col("status") == "analyzed"
    rows = rows.withColumn("_turns", F.collect_list(turn).over(before)).withColumn("context", F.when(counts, bounded(F.col("_turns"), c.max_tokens)))
    record = F.when(counts, T.contextual_id(F.col("key"), F.col("context")))
    return rows.select(F.col("source_row").alias("row_ix"), "status", "masked", "key", "redacted", record.alias("record_id"), "context")
