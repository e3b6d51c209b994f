"""Quartile bucket digests of texts and how alike two digests are."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

BUCKETS = 256
#: Which bytes of a window of five make a triplet, each kind hashed with its own seed.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: The difference that digests of unrelated counts have on average, from which the likeness is 0.
FAR = 416
BLOCK = 1 << 20


def _counts(texts: list[bytes]) -> np.ndarray:
    """Triplets by bucket, a row for each text. Windows never reach over the end of a text."""
    n = len(texts)
    sizes = np.fromiter((len(t) for t in texts), np.int64, n)
    buf = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    counts = np.zeros(n * BUCKETS, np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(buf))
    for seed, (a, b, c) in enumerate(TRIPLETS):
        m = len(buf) - c
        if m <= 0:
            continue
        x = buf[a : a + m] << np.uint32(16) | buf[b : b + m] << np.uint32(8) | buf[c : c + m]
        x += np.uint32((seed * 0x51ED270B + 0x9E3779B9) & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        x *= np.uint32(0x297A2D39)
        key = owner[:m] + (x >> np.uint32(24))
        counts += np.bincount(key[left[:m] > c], minlength=n * BUCKETS)
    return counts.reshape(n, BUCKETS)


def _digest(counts: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Hex of a length byte, a byte of quartile ratios, and two bits a bucket: in which quarter its count is."""
    s = np.sort(counts, axis=1)
    q = np.stack([s[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3)], axis=1)
    codes = (counts[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8)
    packed = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    length = np.minimum(255, np.round(np.log1p(sizes) * 12)).astype(np.uint8)
    top = np.maximum(q[:, 2], 1)
    ratios = (np.minimum(15, q[:, 0] * 16 // top) << 4 | np.minimum(15, q[:, 1] * 16 // top)).astype(np.uint8)
    rows = np.concatenate([length[:, None], ratios[:, None], packed], axis=1)
    return [r.tobytes().hex() for r in rows]


def fingerprint(texts: list[str]) -> list[str]:
    """The digest of each text. It depends on the text's UTF-8 bytes alone; null counts as empty."""
    out: list[str] = []
    block: list[bytes] = []
    size = 0
    for t in [*texts, None]:
        if t is not None or len(out) + len(block) < len(texts):
            b = (t or "").encode()
            block.append(b)
            size += len(b)
        if block and (size >= BLOCK or len(out) + len(block) == len(texts)):
            out += _digest(_counts(block), np.fromiter((len(b) for b in block), np.int64, len(block)))
            block, size = [], 0
    return out[: len(texts)]


def _unpacked(digests: list[str]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), -1)
    p = raw[:, 2:]
    codes = np.stack([p >> 6, p >> 4 & 3, p >> 2 & 3, p & 3], axis=2).reshape(len(raw), BUCKETS)
    head = np.stack([raw[:, 0], raw[:, 1] >> 4, raw[:, 1] & 15], axis=1)
    return np.concatenate([head, codes], axis=1).astype(np.int16)


def likeness(one: list[str], other: list[str]) -> np.ndarray:
    """1 less the bounded difference of digests: buckets of opposite quarters count double,
    lengths count beyond a factor of about 1.3, quartile ratios beyond a sixteenth."""
    if not len(one):
        return np.zeros(0)
    d = np.abs(_unpacked(list(one)) - _unpacked(list(other)))
    codes = d[:, 3:]
    far = codes.sum(axis=1) + 3 * (codes == 3).sum(axis=1) + np.maximum(0, d[:, 0] - 3) + 2 * np.maximum(0, d[:, 1:3] - 1).sum(axis=1)
    return 1 - np.minimum(1.0, far / FAR)


def _two_fingerprints(text: pd.Series, edited: pd.Series) -> pd.DataFrame:
    a, b = fingerprint(text.tolist()), fingerprint(edited.tolist())
    return pd.DataFrame({"a": a, "b": b, "near": likeness(a, b)})


def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(likeness(a.tolist(), b.tolist()))


def _bucketed(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """docs with a bucket _b of neighbours and their order (_known, _k, _h), and the first row's order of each bucket with the bucket before it.

    Documents stand in the falling order of _known, _k and _h: null ids last, and rows of one id by
    the turned hash of their text. Buckets end at quantiles of the ids; an id that spans several has
    its rows dealt to these by ranges of the hash, and so have null ids to buckets of their own.
    The driver holds some numbers for each bucket.
    """
    shares = [k / buckets for k in range(1, buckets)]
    n, n_known, cuts = docs.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", shares, 20 * buckets) if shares else F.lit(None)).first()
    unknown = min(buckets, -(-(n - n_known) * buckets // max(1, n_known)))
    # The cuts with how many stand below each, and how many buckets its own rows have.
    cuts = sorted(cuts or ())
    values = sorted(set(cuts))
    below, own = [bisect_left(cuts, v) for v in values] + [len(cuts)], [cuts.count(v) for v in values] + [1]
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    table = listed(values)
    hashed = F.bitwise_not(F.xxhash64("text"))
    keyed = docs.withColumns({"_known": F.col("doc_id").isNotNull(), "_k": F.coalesce("doc_id", F.lit(0).cast("long")), "_h": hashed})

    def halved(at, step):
        return F.when((at + step <= len(values)) & (F.get(table, at + step - 1) < F.col("_k")), at + step).otherwise(at)

    # How many distinct cuts lie below an id, found by halving.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(values).bit_length()))])
    keyed = keyed.withColumn("_i", F.aggregate(steps, F.lit(0), halved) if values else F.lit(0))
    share = F.col("_h").cast("double") / 2.0**64 + 0.5
    spread = lambda m: F.least(m - 1, F.floor(share * m))
    mine = F.coalesce(F.get(table, F.col("_i")) == F.col("_k"), F.lit(False)) if values else F.lit(False)
    known = F.get(listed(below), F.col("_i")) + F.when(mine, spread(F.get(listed(own), F.col("_i")))).otherwise(F.lit(0))
    bucket = F.when(F.col("_known"), known).otherwise(spread(F.lit(unknown)) - unknown)
    keyed = keyed.withColumn("_b", bucket.cast("int")).drop("_i")
    heads = sorted((r["_b"], *r["h"]) for r in keyed.groupBy("_b").agg(F.max(F.struct("_known", "_k", "_h")).alias("h")).collect())
    rows = [(*key, heads[(i + 1) % len(heads)][0]) for i, (_, *key) in enumerate(heads)]
    return keyed, docs.sparkSession.createDataFrame(rows, "_known boolean, _k long, _h long, _to int")


def with_edits(docs: DataFrame, buckets: int = 0) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to that and to the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Documents follow each other by descending doc_id, null last, repeats of an id by a hash
    of their texts; after the last comes the first. The edited text has its last third of characters replaced
    by the first as many of the next document's. A null text counts as empty; an empty table
    gives no rows; other columns are ignored.

    Documents are dealt to buckets of neighbours, so one shuffle brings every document
    to its next; the first row of each bucket also goes, as a marked copy, to the bucket whose
    last row it follows. Rows of one id that are alike to the letter are one bucket's.
    """
    spark = docs.sparkSession
    two_fingerprints = F.pandas_udf(_two_fingerprints, "struct<a:string,b:string,near:double>")
    alike = F.pandas_udf(_likeness, "double")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed, heads = _bucketed(docs, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A row for each bucket is broadcast; of rows alike any one is the first.
    first = keyed.drop("_b").join(F.broadcast(heads), ["_known", "_k", "_h"]).groupBy("_known", "_k", "_h", "_to").agg(F.min("text").alias("text"))
    first = first.select(F.lit(None).cast("long").alias("doc_id"), "text", "_known", "_k", "_h", F.col("_to").alias("_b"), F.lit(True).alias("_copy"))
    keyed = keyed.withColumn("_copy", F.lit(False)).unionByName(first)
    order = W.partitionBy("_b").orderBy("_copy", F.desc("_known"), F.desc("_k"), F.desc("_h"), "text")
    n = F.length("text")
    rows = keyed.withColumn("_next", F.lead("text").over(order)).withColumn("n_chars", n.cast("long"))
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - third), F.coalesce(F.substring("_next", F.lit(1), third), F.lit(""))))
    rows = rows.withColumn("_r", F.row_number().over(order)).withColumn("edited_sha256", F.sha2("_edited", 256)).withColumn("_f", two_fingerprints("text", "_edited"))
    # What follows needs digests alone; written, they are the only rows that the second window deals out.
    made = materialise(rows.select("_b", "_r", "_copy", "doc_id", "n_chars", "edited_sha256", F.col("_f.a").alias("fingerprint"), F.col("_f.b").alias("edited_fingerprint"), F.col("_f.near").alias("near_edited")), "fingerprints")
    made = made.withColumn("_nf", F.lead("fingerprint").over(W.partitionBy("_b").orderBy("_r"))).where("not _copy")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", alike("fingerprint", "_nf").alias("near_next"))
