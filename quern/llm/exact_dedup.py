"""Exact dedup, native: local, salted and global combining of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise


def _keyed(docs: DataFrame, salts: int) -> DataFrame:
    """docs with _text (null as empty), its digest _d and the row's salt _s."""
    return (
        docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
        .withColumn("_d", F.unhex(F.sha2("_text", 256)))
        .withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    )


def text_groups(docs: DataFrame, salts: int = 64) -> DataFrame:
    """Groups of equal texts: (_d, _s, _text, _keep, _n, _variants), a row for each salt of a group.

    Stage 1 deduplicates each task's own rows and stage 2 merges them by (digest, salt): the
    two halves of the first aggregation. Stage 3 combines the salt winners by digest. The text
    itself is among the grouping keys of every stage, so a digest that two texts share makes
    two groups; _variants counts them, and _text is kept only if there are several.
    """
    keyed = _keyed(docs.select("doc_id", "text"), salts)
    salted = keyed.groupBy("_d", "_s", "_text").agg(F.max("doc_id").alias("_k"), F.count("*").alias("_c"))
    whole = salted.repartition("_d").groupBy("_d", "_text").agg(F.max("_k").alias("_keep"), F.sum("_c").alias("_n"), F.collect_set("_s").alias("_salts"))
    return (
        whole.withColumn("_variants", F.count("*").over(W.partitionBy("_d")))
        .withColumn("_text", F.when(F.col("_variants") > 1, F.col("_text")))
        .select("_d", F.explode("_salts").alias("_s"), "_text", "_keep", "_n", "_variants")
    )


def with_groups(docs: DataFrame, salts: int = 64) -> DataFrame:
    """docs, all columns, with keep_id, group_size, kept and text_sha256 of each row.

    docs needs doc_id and text; a null text counts as empty. The largest doc_id of a group
    stays. Null ids lose against any other; if a group has no other, keep_id is null and one
    of its rows stays. Of rows that repeat a kept id and text exactly one is kept. Columns of
    docs whose names are those of the result are replaced. An empty table gives no rows.

    A row meets its group by (digest, salt), so a text that a third of all rows have is dealt
    to as many tasks as there are salts; raise them with the cluster.
    """
    groups = materialise(text_groups(docs, salts), "groups")
    made = ("keep_id", "group_size", "kept", "text_sha256")
    names = [c for c in docs.columns if c not in made]
    # Columns of docs go under numbers meanwhile, so that none of them has a name that is used here.
    numbered = docs.select("doc_id", "text", *[F.col(c).alias(f"c{k}") for k, c in enumerate(names) if c not in ("doc_id", "text")])
    rows = _keyed(numbered, salts)
    g = groups.select(F.col("_d").alias("_gd"), F.col("_s").alias("_gs"), F.col("_text").alias("_gt"), "_keep", "_n", "_variants")
    same = (F.col("_d") == F.col("_gd")) & (F.col("_s") == F.col("_gs"))
    if groups.where("_variants > 1").isEmpty():
        # Stage 3 found one text for each digest, so equal digests are equal texts here.
        joined = rows.drop("_text").join(g, same)
    else:
        joined = rows.join(g, same & (F.col("_gt").isNull() | (F.col("_gt") == F.col("_text")))).drop("_text")
    first = F.row_number().over(W.partitionBy("_d", "_s", "_gt", "doc_id").orderBy(F.lit(0)))
    one_salt_of_nulls = F.col("_keep").isNull() | (F.col("doc_id") == F.col("_keep"))
    joined = joined.withColumn("_kept", F.coalesce(one_salt_of_nulls, F.lit(False)) & (first == 1))
    return joined.select(
        *[F.col(c if c in ("doc_id", "text") else f"c{k}").alias(c) for k, c in enumerate(names)],
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.lower(F.hex("_d")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, salts: int = 64) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of equal texts.

    The rows that with_groups keeps; of rows that repeat a kept id and text any one stays.
    The winner of each stage carries its row's other columns along, so texts
    move twice, to the salted and to the global merge, and no row is looked up afterwards.
    """
    rest = F.struct(F.col("text").isNull().alias("no_text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"])
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    packed = docs.select("doc_id", "text", rest.alias("_row"), rank.alias("_rank"))
    keyed = _keyed(packed, salts).select("_d", "_s", "_text", "_row", "_rank")
    winner = [F.max("_rank").alias("_rank"), F.max_by("_row", "_rank").alias("_row")]
    salted = keyed.groupBy("_d", "_s", "_text").agg(*winner)
    whole = salted.repartition("_d").groupBy("_d", "_text").agg(*winner)
    text = F.when(~F.col("_row.no_text"), F.col("_text")).alias("text")
    return whole.select(*[text if c == "text" else F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
