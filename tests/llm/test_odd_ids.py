"""Ids at both ends, null and repeated ones, by value; and how hot ids are dealt."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup, fingerprints, mixing, warc_zip

KINDS = "doc_id long, text string, source string"
LO, HI = -(1 << 63), (1 << 63) - 1


def edits_by_brute_force(df):
    """(doc_id, text) -> edited text, in the order that the docstring states."""
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    out = []
    for k, r in enumerate(rows):
        n, nxt = len(r.text) // 3, rows[(k + 1) % len(rows)].text
        out.append((r.doc_id, hashlib.sha256((r.text[: len(r.text) - n] + nxt[:n]).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 3, 16, 64])
@pytest.mark.parametrize("kind", ["ends", "nulls", "one id", "few", "none"])
def test_edits_of_any_ids(spark, kind, buckets):
    r = random.Random(buckets)
    text = lambda: " ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(r.randrange(30)))
    ids = {
        "ends": [HI, LO, None, LO, HI, 0, None, LO + 1, -1],
        "nulls": [None if k % 5 < 3 else k for k in range(300)],
        "one id": [7 if k % 3 else k for k in range(300)],
        "few": [1, None],
        "none": [],
    }[kind]
    df = spark.createDataFrame([(i, None if k % 50 == 3 else text() + str(k % 40), "s") for k, i in enumerate(ids)], KINDS).repartition(3)
    got = sorted(((x.doc_id, x.edited_sha256) for x in fingerprints.with_edits(df, buckets).collect()), key=repr)
    assert got == edits_by_brute_force(df)


def test_hot_ids_are_dealt_to_many_buckets(spark):
    for hot in (None, 5):
        df = spark.createDataFrame([(hot if k % 5 < 3 else k, f"text {k}", "s") for k in range(2000)], KINDS)
        keyed, _ = fingerprints._bucketed(df, 16)
        counts = sorted(r["count"] for r in keyed.groupBy("_b").count().collect())
        assert sum(counts) == 2000 and counts[-1] <= 2 * counts[len(counts) // 2]


@pytest.mark.parametrize("hot", [None, 4])
def test_copies_with_one_id(spark, hot):
    rows = [(hot if k % 5 < 3 else k, "same text of a hundred bytes " * 4, "s") for k in range(1000)]
    df = spark.createDataFrame(rows, KINDS).repartition(4)
    got = exact_dedup.with_groups(df).collect()
    assert len(got) == 1000 and {(r.keep_id, r.group_size) for r in got} == {(999, 1000)} and [r.doc_id for r in got if r.kept] == [999]
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    least = min(i for i, _, _ in rows if i is not None)
    told = warc_zip.mark_revisits(pages).collect()
    assert len(told) == 1000 and all(r.refers_to == (None if r.page_id == least else least) for r in told)
    taken = mixing.mix(df).collect()
    assert len(taken) == 1000 and sum(r.taken for r in taken) == pytest.approx(taken[0].target, abs=1)


def test_copies_with_only_null_ids_keep_one(spark):
    df = spark.createDataFrame([(None, "x", "s")] * 300 + [(3, "y", "s"), (3, "y", "s"), (None, None, "s"), (None, "", None)], KINDS).repartition(5)
    got = exact_dedup.with_groups(df).collect()
    kept = sorted((r.text or "", r.doc_id, r.keep_id, r.group_size) for r in got if r.kept)
    assert len(got) == 304 and kept == [("", None, None, 2), ("x", None, None, 300), ("y", 3, 3, 2)]
