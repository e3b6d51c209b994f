"""Structured Streaming forms: running frequencies, session context, and first claims of a key."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from ..functions.scalars import order_key
from ..operators import preprocess as P
from ..operators.filters import Conversation, conversation_rows
from ..operators.tables import scratch_path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table's rows."""
    batch = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(batch.schema)
    return source.option("pathGlobFilter", name).parquet(folder) if len(batch.inputFiles()) == 1 and os.path.basename(batch.inputFiles()[0]) == name else source.parquet(path)


def run_to_end(stream: DataFrame, mode: str, latest_by: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is there and returns its result from a written table.

    Batches are written under their number, so a batch that runs again replaces itself. In
    update mode the latest row of each key counts.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")

    def sink(df: DataFrame, n: int) -> None:
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/n={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    schema = Y.StructType([*stream.schema.fields, Y.StructField("_batch", Y.IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows") if q.lastProgress else spark.createDataFrame([], schema)
    if latest_by:
        rest = [c for c in stream.columns if c not in latest_by]
        return rows.groupBy(*latest_by).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*latest_by, "x.*")
    return rows.drop("_batch")


def dedupe_stream(values: DataFrame) -> DataFrame:
    """(record_id, count) of a stream of (row_ix, value), updated as messages come."""
    return P.messages(values).where("status = 'analyzed'").groupBy("record_id").agg(F.count("*").alias("count"))


def dedupe_counts(spark: SparkSession, path: str, row_ix: str, value: str) -> DataFrame:
    rows = read_table(spark, path).select(F.col(row_ix).alias("row_ix"), F.col(value).alias("value"))
    return run_to_end(dedupe_stream(rows), "update", ("record_id",))


def context_stream(rows: DataFrame, c: Conversation, on_disorder: str = "raise", idle_seconds: int | None = None, lateness: str = "1 hour") -> DataFrame:
    """(row_ix, context, late) of the rows of conversations: the turns before each, up to the bound.

    rows: (session_id, row_ix, who, text, fit, message_order's key as kind, number and folded). State
    of a session, as JSON: its last turns, and the key of the order of its last row. Rows of
    a micro-batch are taken by row_ix. A row whose order goes back, is of another kind or
    isn't finite fails the stream with ConversationOrderError; with on_disorder="mark" it
    comes out as late, and changes no state. With idle_seconds rows have a time `ts`, and
    a session that had no row for so long has ended: a row that comes later begins it anew, and
    once the watermark has passed that time its state is dropped.
    """
    most = c.max_turns
    times = ["us"] if idle_seconds is not None else []

    def over(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, last, newest = json.loads(state.get[0]) if state.exists else ([], None, 0)
        pdf = pd.concat(list(frames)).sort_values("row_ix")
        out = []
        for ix, who, text, fit, kind, sign, magnitude, digits, folded, *us in pdf[["row_ix", "who", "text", "fit", "kind", "sign", "magnitude", "digits", "folded", *times]].itertuples(index=False):
            if us:
                if newest and us[0] - newest >= idle_seconds * 1_000_000:
                    turns, last = [], None
                newest = max(newest, int(us[0]))
            now = [kind, [int(sign), int(magnitude), digits] if kind == "number" else folded]
            late = kind == "error" or (last is not None and (last[0] != kind or now[1] < last[1]))
            if late and on_disorder == "raise":
                raise P.ConversationOrderError(int(ix))
            if late:
                out.append((ix, [], True))
                continue
            last = now
            if fit:
                out.append((ix, [{"role": r, "text": t} for r, t in turns], False))
                turns = [*turns, [who, text]][-most:]
        if times:
            state.setTimeoutTimestamp(max(newest // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        state.update((json.dumps([turns, last, newest]),))
        yield pd.DataFrame({"row_ix": pd.Series([r[0] for r in out], dtype="int64"), "context": pd.Series([r[1] for r in out], dtype=object), "late": pd.Series([r[2] for r in out], dtype=bool)})

    if times:
        rows = rows.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("session_id").applyInPandasWithState(over, "row_ix long, context array<struct<role:string,text:string>>, late boolean", "state string", "append", "EventTimeTimeout" if times else "NoTimeout")


def ordered_turns(rows: DataFrame, c: Conversation) -> DataFrame:
    """What context_stream takes, from conversation rows."""
    rows = P.eligible(rows, c).where("takes_part").withColumn("k", order_key(F.col("message_order")))
    x = P.message_status(F.col("text"))
    rows = rows.withColumn("masked", x["masked"]).withColumn("status", x["status"])
    number = [F.coalesce(f"k.number.{n}", F.lit(0)).cast("long").alias(n) for n in ("sign", "magnitude")]
    return rows.select("session_id", F.col("source_row").alias("row_ix"), "who", F.col("masked").alias("text"), F.col("status").isin("analyzed", "courtesy").alias("fit"), "k.kind", *number, F.coalesce("k.number.digits", F.lit("")).alias("digits"), F.col("k.text").alias("folded"))


def contextual_ids(spark: SparkSession, path: str) -> DataFrame:
    """(row_ix, context, record_id) of the targets of a conversation table, its contexts kept by a stream."""
    c = Conversation("conv_id", "turn", "role", "kind")
    named = lambda df: conversation_rows(df.withColumn("kind", F.lit("text")), F.col("conv_id") * 1000 + F.col("turn"), "text", c)
    seen = run_to_end(context_stream(ordered_turns(named(read_table(spark, path)), c), c), "append").where("not late")
    x = P.message_status(F.col("text"))
    targets = P.eligible(named(spark.read.parquet(path)), c).where("takes_part and who = 'user'").withColumn("key", x["key"]).withColumn("status", x["status"]).where("status = 'analyzed'")
    met = targets.select(F.col("source_row").alias("row_ix"), "key").join(seen, "row_ix").withColumn("context", P.bounded(F.col("context"), c.max_tokens))
    return met.select("row_ix", "context", T.contextual_id(F.col("key"), F.col("context")).alias("record_id"))


def claims(events: DataFrame, ttl_seconds: int = 86_400, lateness: str = "1 hour") -> DataFrame:
    """(event_id, claim_id, outcome) of a stream of (event_id, key, fingerprint, ts).

    The first event of a key claims it for the time to live; later ones within it are replays
    if their fingerprint is the claim's, else conflicts. Neither lengthens the claim: it ends
    ttl_seconds after the claiming event, and the next event claims anew. Events of a
    micro-batch are taken by (ts, event_id). Once the watermark, `lateness` behind the latest
    event, has passed the end of a claim its state is dropped; events before the watermark are too late to count.
    """

    def over(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        claim, until, fingerprint = state.get if state.exists else (None, None, None)
        pdf = pd.concat(list(frames)).sort_values(["us", "event_id"])
        out = []
        for event, us, told in pdf[["event_id", "us", "fingerprint"]].itertuples(index=False):
            if claim is None or us >= until:
                claim, until, fingerprint = int(event), int(us) + ttl_seconds * 1_000_000, told
                out.append((event, claim, "claimed"))
            else:
                out.append((event, claim, "replay" if told == fingerprint else "conflict"))
        state.update((claim, until, fingerprint))
        state.setTimeoutTimestamp(max(-(-until // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "claim_id", "outcome"])

    timed = events.select("event_id", "key", "fingerprint", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("key").applyInPandasWithState(over, "event_id long, claim_id long, outcome string", "claim long, until long, fingerprint string", "append", "EventTimeTimeout")


def first_events(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, event_id): of each user the first event, from running minima."""
    s = read_table(spark, path).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return run_to_end(s, "update", ("user_id",))
