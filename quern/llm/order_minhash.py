"""Near-duplicate documents by Order MinHash and aligned shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import handed_back, materialise
from .near import BROADCAST_IDS, key_of, similar, with_leader
from .shingles import U, labelled, mix, shingles, word_hashes

#: With a share s of common shingles two texts agree in one of SKETCHES with 1 - (1 - s**LEAST)**SKETCHES: 0.9998 at 0.8.
SKETCHES, LEAST = 16, 4
#: Characters of texts that are hashed together; their arrays take some 100 bytes for each.
BLOCK = 1 << 18


def sketches(texts: list[str | None], k: int = 5, number: int = SKETCHES, least: int = LEAST) -> list[tuple[int, bytes, list[int]]]:
    """(shingles, signature, keys) of each text.

    Sketch j orders a text's occurrence-labelled shingles by a hash of its own, samples the
    `least` smallest and keeps them in text order; its key hashes j and that sequence, so
    texts agree in it only if they have the same shingles in the same order there. The
    signature hashes all words in order. Case and amounts of white space don't count.
    """
    h, counts = word_hashes([(t or "").lower().encode() for t in texts])
    s, n = shingles(h, counts, k)
    x = labelled(s, n)
    factor = mix(np.arange(1, number + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    out, at, word_at = [], 0, 0
    for size, words in zip(n.tolist(), counts.tolist()):
        own, w = x[at : at + size], h[word_at : word_at + words]
        at, word_at = at + size, word_at + words
        place = np.arange(1, words + 1, dtype=np.uint64)
        signature = np.array([mix(w + place * U(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64), mix(w ^ mix(place)).sum(dtype=np.uint64)]).tobytes()
        if not size:
            out.append((0, signature, []))
            continue
        order = own[None, :] * factor[:, None]
        order ^= order >> U(29)
        if size > least:
            places = np.sort(np.argpartition(order, least, axis=1)[:, :least], axis=1)
        else:
            places = np.tile(np.arange(size), (number, 1))
        key = mix(np.arange(number, dtype=np.uint64) + U(77))
        for c in range(places.shape[1]):
            key = mix(key * U(0xFF51AFD7ED558CCD) + own[places[:, c]])
        out.append((size, signature, key_of(key).tolist()))
    return out


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    fields = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def over(batches):
        for b in batches:
            ids, texts = b.column(0).cast(pa.int64()), b.column(1)
            at = 0
            while at < len(b):
                size, to = 0, at
                while to < len(b) and (size < BLOCK or to == at):
                    size += len(texts[to].as_py() or "")
                    to += 1
                got = sketches(texts[at:to].to_pylist(), k)
                yield pa.RecordBatch.from_arrays([ids[at:to], *(pa.array(c, f.type) for c, f in zip(zip(*got), list(fields)[1:]))], schema=fields)
                at = to

    return docs.select("doc_id", "text").mapInArrow(handed_back(over), "node bigint, n int, sig binary, keys array<bigint>")


def near_classes(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every row: a class is a component of near-duplicate links.

    Two texts are linked if at least `least` of their k-word shingles (labelled by occurrence,
    common to all of both) align in order. Candidates share one of the sketches; of texts with
    the same words only the least doc_id is sketched on. class_id is the least doc_id of the
    class, which is kept. Texts without words are classes of their own, null texts too. Rows of
    null doc_id get class_id null, size 1 and are kept; rows that repeat a doc_id are one node
    and all have its class, and stay together. An empty table gives no rows.
    """
    table = materialise(_sketched(docs, k), "sketches")
    nodes = table.where("node is not null")
    # Texts of the same words, whatever their number, become one node before any candidate is formed.
    wordy = nodes.where("n > 0").withColumn("sig", F.hex("sig"))
    same = materialise(with_leader(wordy.select("node", "sig"), ["sig"]).where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")), "same")
    alone = wordy.join(same.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    members = alone.select("node", "n", F.explode("keys").alias("key"))
    roots = similar(members, docs.select(F.col("doc_id").alias("node"), "text"), k, True, least, same)
    label = roots.groupBy("node").agg(F.min("root").alias("root"))
    # Rows of one class meet its size by (class, salt): the class of a third of all rows is dealt out.
    sized = with_leader(label, ["root"]).select("node", "root", F.col("members").alias("_size"))
    out = table.select("node").join(sized, "node", "left")
    return out.select(F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("class_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("class_size"), (F.coalesce("root", F.lit(None).cast("long")).isNull() | (F.col("root") == F.col("node"))).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, all columns, that stay: of each class the one of least doc_id."""
    gone = near_classes(docs, k, least).where("not kept").select(F.col("doc_id").alias(_other_name(docs))).distinct()
    gone = materialise(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def _other_name(docs: DataFrame) -> str:
    """A name that no column of docs has."""
    return "x" + "_".join(docs.columns)
