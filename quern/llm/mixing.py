"""Mixing sources to target weights by a low-discrepancy schedule of slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

#: Words are the runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The golden ratio's fraction, and those of it times 2**20 and 2**40: slots are multiplied in three parts, so that large numbers keep their fraction.
GOLDEN = (0.6180339887498949, 0.607787409740351, 0.2909558982617013)
PART = 1 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def point(slot: Column) -> Column:
    """The fraction of slot times the golden ratio, exact to 30 bits for slots below 2**60."""
    parts = (F.pmod(slot, F.lit(PART)), F.pmod(F.floor(slot / PART), F.lit(PART)), F.floor(slot / (PART * PART)))
    x = parts[0] * F.lit(GOLDEN[0]) + parts[1] * F.lit(GOLDEN[1]) + parts[2] * F.lit(GOLDEN[2])
    return x - F.floor(x)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, null last, have the weights in turn and share all words; a target
    stops at `most` times its source's size, and the excess is shared by weight among the
    rest until none is above. That fixed point is a water level: sources in the order of cap
    by weight are full one after the other while their share at the level that the rest
    would have exceeds their cap. A row for each source goes through one task here: a
    summary, whose counts were combined before.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(order, F.lit(len(weights))) + 1).cast("int"))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = W.orderBy("_ratio", "_rank")
    before = full.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    capped = (
        by.withColumn("_rank", order)
        .withColumn("_w", turn)
        .withColumn("_cap", F.lit(most) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    )
    first = F.min(F.when(F.col("_open"), F.struct("_ratio", "_rank", "_level"))).over(every)
    return (
        capped.withColumn("_first", first)
        .withColumn("_full", F.coalesce(F.struct("_ratio", "_rank") < F.struct("_first._ratio", "_first._rank"), F.lit(True)))
        .select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_first._level") * F.col("_w")).alias("target"), F.col("_rank").alias("source_rank"))
    )


def slot_schedule(targets: DataFrame, block: int, chunk: int = 1 << 14) -> DataFrame:
    """(slot, source_rank, k, begin, end): which block of which source fills each slot.

    Slot i's point, the fraction of i times the golden ratio, falls in one source's interval
    of the cumulated targets. k ranks the slots of a source: counts by chunk of slots are
    cumulated, then slots are ranked within their chunk, so no task sees a whole source. The
    blocks of a source share its target equally; block k is words [begin, end) of its
    stream. A source with a target but no point gets one slot after all others.
    """
    spark = targets.sparkSession
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = W.orderBy("source_rank").rowsBetween(W.unboundedPreceding, 0)
    share = (
        targets.withColumn("_all", F.sum("target").over(every))
        .withColumn("_hi", F.try_divide(F.sum("target").over(upto), F.col("_all")))
        .withColumn("_lo", F.coalesce(F.lag("_hi").over(W.orderBy("source_rank")), F.lit(0.0)))
        .withColumn("_words", F.round("target").cast("long"))
        .where("target > 0")
    )
    share = materialise(share, "shares")
    total = share.agg(F.max("_all")).first()[0] or 0.0
    slots = max(1, int(-(-total // block))) if total else 0
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("_x"))
    # The intervals are cut at a grid of cells, so a point finds its source by an equality join.
    cells = 4096
    grid = share.select("source_rank", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells).cast("long")))).alias("_cell"))
    placed = points.withColumn("_cell", F.floor(F.col("_x") * cells)).join(grid, "_cell").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi")))
    placed = placed.select("slot", "source_rank", (F.col("slot") / F.lit(chunk)).cast("long").alias("_chunk"))
    counts = placed.groupBy("source_rank", "_chunk").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(W.partitionBy("source_rank").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.join(offsets.select("source_rank", "_chunk", "_off"), ["source_rank", "_chunk"]).withColumn("k", F.col("_off") + F.row_number().over(W.partitionBy("source_rank", "_chunk").orderBy("slot")) - 1)
    ranked = materialise(ranked.select("slot", "source_rank", "k"), "slots")
    number = ranked.groupBy("source_rank").agg(F.count("*").alias("_n"))
    # Written, it has a known size: a row for each source, which rows meet without a shuffle while it is small.
    share = materialise(share.join(number, "source_rank", "left").withColumn("_n", F.coalesce("_n", F.lit(1).cast("long"))), "shares")
    late = share.join(number.select("source_rank"), "source_rank", "left_anti").select((F.lit(slots) + F.col("source_rank")).cast("long").alias("slot"), "source_rank", F.lit(0).cast("long").alias("k"))
    cut = lambda k: F.floor(k * (F.col("_words") / F.col("_n")) + F.lit(1e-6)).cast("long")
    return (
        ranked.union(late)
        .join(share.select("source_rank", "_words", "_n"), "source_rank")
        .select("slot", "source_rank", "k", cut(F.col("k")).alias("begin"), F.when(F.col("k") + 1 == F.col("_n"), F.col("_words")).otherwise(cut(F.col("k") + 1)).alias("end"), "_n", "_words")
    )


def _streams(docs: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """docs with the offset of each row's first word in its source's shuffled stream.

    Rows are shuffled by the MD5 of doc_id. Offsets are cumulated over `buckets` ranges of
    that hash first and then within a range, so that a hot source is as many tasks as it has
    ranges.
    """
    keyed = (
        docs.join(targets, F.col("source").eqNullSafe(F.col("_tsource")))
        .withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("_b", F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"), F.lit(1 << 32)) * buckets / F.lit(float(1 << 32)))
        .withColumn("_b", F.floor("_b"))
    )
    sums = keyed.groupBy("source_rank", "_b").agg(F.sum("size").alias("_bsum"))
    start = sums.withColumn("_start", F.coalesce(F.sum("_bsum").over(W.partitionBy("source_rank").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("source_rank", "_b").orderBy("_h", "size").rowsBetween(W.unboundedPreceding, -1)
    return keyed.join(start.select("source_rank", "_b", "_start"), ["source_rank", "_b"]).withColumn("_off", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block: int = 512, buckets: int = 1024) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, slots) for every row of docs.

    docs needs doc_id, text and source. size counts words, a null text has none. taken is how
    many words the schedule's blocks take from the row, repeats counted, and slots has, for
    each pass over its source that takes any, the first slot that does. A source's stream is its rows shuffled by
    a hash of doc_id, repeated up to `most` times; its slots' blocks cover the first `target`
    words of it, rounded. So no row is taken more than `most` times. Rows of equal doc_id
    stay rows of their own; null ids and a null source are values like others. Empty tables
    give no rows; a table without words gives targets and takings of 0.
    """
    sized = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    targets = materialise(source_targets(sized, weights, most), "targets")
    slots = materialise(slot_schedule(targets, block), "schedule")
    named = targets.select(F.col("source").alias("_tsource"), "source_rank", "source_size", "target")
    rows = materialise(_streams(sized, named, buckets).select("doc_id", "source", "size", "source_size", "target", "source_rank", "_off"), "streams")
    number = materialise(slots.groupBy("source_rank").agg(F.max("_n").alias("_n"), F.max("_words").alias("_words")), "blocks")
    # A row's words on pass c are [first, last) of the stream; the blocks that they meet follow from block sizes alone.
    spans = (
        rows.where("size > 0")
        .join(number, "source_rank")
        .withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("_first", F.col("_off") + F.col("_pass") * F.col("source_size"))
        .where("_first < _words")
        .withColumn("_last", F.least(F.col("_first") + F.col("size"), F.col("_words")))
        .withColumn("_each", F.col("_words") / F.col("_n"))
        .withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("_first") / F.col("_each")) - 1), F.least(F.col("_n") - 1, F.floor((F.col("_last") - 1) / F.col("_each")) + 1))))
    )
    met = spans.join(slots.select("source_rank", "k", "slot", "begin", "end"), ["source_rank", "k"]).withColumn("_got", F.least("_last", "end") - F.greatest("_first", "begin")).where("_got > 0")
    by_pass = met.groupBy("source_rank", "_off", "_pass").agg(F.sum("_got").alias("_got"), F.min("slot").alias("_slot"))
    got = by_pass.groupBy("source_rank", "_off").agg(F.sum("_got").alias("taken"), F.sort_array(F.collect_list("_slot")).alias("slots"))
    none = F.array().cast("array<bigint>")
    held = rows.where("size > 0").join(got, ["source_rank", "_off"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("slots", none).alias("slots"))
    return held.union(rows.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long"), none))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The documents of the mix in the order of the schedule, with all their columns.

    A row stands once for each pass over its source that takes words of it, at the first slot
    that does. Texts are not cut: the one row at which a source's target ends stands whole.
    Rows alike in doc_id, source and size must have different texts or be alike in all
    columns; then they are numbered. Names of columns don't matter.
    """
    taken = mix(docs, weights, most).where("size > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_size"), "slots")
    taken = materialise(taken, "mix")
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    i, t, w = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text", "source"))
    rows = rows.withColumn("_words", n_words(t))
    same = i.eqNullSafe(F.col("_id")) & w.eqNullSafe(F.col("_src")) & (F.col("_words") == F.col("_size"))
    if not taken.groupBy("_id", "_src", "_size").count().where("count > 1").isEmpty():
        taken = taken.withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_src", "_size").orderBy("slots")))
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(i, w, "_words").orderBy(F.xxhash64(*[f"c{k}" for k in range(len(names))]))))
        same = same & (F.col("_n") == F.col("_nth"))
    met = rows.join(taken.where(F.size("slots") > 0), same).withColumn("_slot", F.explode("slots"))
    ordered = met.select("_slot", *[f"c{k}" for k in range(len(names))]).repartitionByRange("_slot").sortWithinPartitions("_slot")
    return ordered.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
