"""Substring dedup of paragraphs: MinHash bands, exact Jaccard, removal by components."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop
from .common import materialise_hashes as materialise
from .near import key_of, similar, with_leader
from .passages import blocks, cut, near_spans, passage_rows, passage_runs, repeated_spans
from .shingles import U, labelled, line_counts, mix, shingles, word_hashes

#: A pair of Jaccard index s agrees in a band with 1 - (1 - s**ROWS)**BANDS: 0.997 at 0.8. Recall is bought with candidates, which are verified.
BANDS, ROWS = 8, 3
#: Paragraphs that one task may number.
ROW_BITS = 36


def banded(h: np.ndarray, counts: np.ndarray, k: int, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, signature, keys) of each paragraph of counts words, all having words; h are the words' hashes."""
    s, n = shingles(h, counts, k)
    x = labelled(s, n)
    starts = np.cumsum(n) - n
    keys = np.zeros((len(n), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(n), mix(np.array([b + 1], np.uint64))[0], np.uint64)
        for r in range(rows):
            factor = mix(np.array([b * rows + r + 101], np.uint64))[0] | U(1)
            v = x * factor
            v ^= v >> U(31)
            key = mix(key * U(0xFF51AFD7ED558CCD) + np.minimum.reduceat(v, starts))
        keys[:, b] = key
    first = np.cumsum(counts) - counts
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(first, counts).astype(np.uint64) + U(1)
    signature = np.stack([np.add.reduceat(mix(h + place * U(0xC2B2AE3D27D4EB4F)), first), np.add.reduceat(mix(h ^ mix(place)), first)], axis=1)
    return n, signature, keys


def units(counts: list[int], least: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of lines that are paragraphs, from the number of words of each line.

    A paragraph ends with the line by which it has `least` words; lines that are left at the end
    belong to the last one. So every line is in one paragraph, and only a whole text can
    have fewer words.
    """
    out, start, words = [], 0, 0
    for i, n in enumerate(counts):
        words += n
        if words >= least:
            out.append((start, i + 1))
            start, words = i + 1, 0
    if start < len(counts) and out:
        out[-1] = (out[-1][0], len(counts))
    elif words:
        out.append((0, len(counts)))
    return out


def _table(docs: DataFrame, k: int, least_words: int) -> DataFrame:
    """(node, doc_id, version, a, b, wa, wb, n, s1, s2, keys, text) of all paragraphs: lines a to b, words wa to wb.

    node numbers the rows of a task, below the number of the task; written once and read from
    there, it is unique whatever doc_id is.
    """
    kinds = {"node": pa.int64(), "doc_id": pa.int64(), "version": pa.int64(), "a": pa.int32(), "b": pa.int32(), "wa": pa.int32(), "wb": pa.int32(), "n": pa.int32(), "s1": pa.int64(), "s2": pa.int64(), "keys": pa.list_(pa.int64()), "text": pa.string()}
    fields = pa.schema(list(kinds.items()))

    def over(batches):
        from pyspark import TaskContext

        context, number = TaskContext.get(), 0
        base = (context.partitionId() if context else 0) << ROW_BITS
        for block in blocks(batches):
            found, lowered = [], [text.lower().encode() for _, _, text in block]
            words, to = line_counts(lowered).tolist(), 0
            for i, version, text in block:
                lines = text.split("\n")
                counts, to = words[to : to + len(lines)], to + len(lines)
                ends = [0, *accumulate(counts)]
                found += [(i, version, a, b, ends[a], ends[b], "\n".join(lines[a:b])) for a, b in units(counts, least_words)]
            if not found:
                continue
            ids, versions, a, b, wa, wb, texts = zip(*found)
            # Every word of a text is in one of its paragraphs.
            n, sig, keys = banded(word_hashes(lowered)[0], np.subtract(wb, wa), k)
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(key_of(keys).ravel()))
            columns = (np.arange(number, number + len(found)) + base, ids, versions, a, b, wa, wb, n.astype(np.int32), key_of(sig[:, 0].copy()), key_of(sig[:, 1].copy()), listed, texts)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds.values())], schema=fields)
            number += len(found)

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return rows.mapInArrow(over, "node long, doc_id long, version long, a int, b int, wa int, wb int, n int, s1 long, s2 long, keys array<long>, text string")


def removals(docs: DataFrame, k: int = 5, least: float = 0.8, least_words: int = 20) -> DataFrame:
    """(doc_id, version, a, b, wa, wb, kept_doc_id, kept_version, kept_a): lines [a, b), words [wa, wb), that repeat an earlier paragraph, and that one.

    Paragraphs are lines of least_words words or more, with the shorter ones before them (see
    `units`). Two are linked if their k-word shingles have a Jaccard index of `least` or
    more; of each component the paragraph of least (doc_id, version, a) stays.
    version is the hash of the text: rows of equal doc_id and text are
    one document, others of equal doc_id are documents of their own. Rows without doc_id or
    text are passed over.
    """
    table = materialise(_table(docs, k, least_words), "paragraphs")
    same = with_leader(table.select("node", "s1", "s2"), ["s1", "s2"]).where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    same = materialise(same, "same")
    alone = table.select("node", "keys").join(same.select(F.col("u").alias("node")), "node", "left_anti")
    members = alone.select("node", F.explode("keys").alias("key"))
    roots = similar(members, table.select("node", "text"), k, False, least, same, once=True).groupBy("node").agg(F.min("root").alias("root"))
    placed = table.select("node", "b", "wa", "wb", F.struct("doc_id", "version", "a").alias("place")).join(roots, "node").select("root", "place", "b", "wa", "wb")
    met = with_leader(placed, ["root"], "place").where("place <> leader")
    out = materialise(met.select("place.*", "b", "wa", "wb", *[F.col(f"leader.{c}").alias(f"kept_{c}") for c in ("doc_id", "version", "a")]), "removals")
    drop(table, same)
    return out


def without_repeats(docs: DataFrame, k: int = 5, least: float = 0.8, least_words: int = 20) -> DataFrame:
    """docs, all columns, text without what repeats, with n_removed, removed_words and removed_bytes.

    Paragraphs go that `removals` names, and of all lines the words of passages that repeat an
    earlier one of passages.LENGTH words, or are near one, wherever its lines end. n_removed counts lines that
    are removed or cut. A null text counts as empty. Columns of docs named like the added
    ones are replaced, other names don't matter.
    """
    made = ("n_removed", "removed_words", "removed_bytes")
    rest = [c for c in docs.columns if c not in made]
    at = rest.index("text")
    part = lambda rows, lines: rows.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"), F.lit(lines).alias("lines"), *(F.col(c).cast("long").alias(as_) for as_, c in (("a", "a"), ("b", "b"), ("wa", "wa" if lines else "a"), ("wb", "wb" if lines else "b"))))
    removed = removals(docs, k, least, least_words)
    found = materialise(passage_runs(passage_rows(docs)), "passage-runs")
    gone = part(removed, True).union(part(repeated_spans(docs, found), False))
    listed = lambda rows: rows.groupBy("gone_id", "gone_version").agg(F.collect_set(F.struct("lines", "a", "b", "wa", "wb")).alias("gone"))
    first = materialise(listed(gone), "gone")
    near = part(near_spans(docs, found, least, first), False)
    gone = listed(first.select("gone_id", "gone_version", F.explode("gone").alias("g")).select("gone_id", "gone_version", "g.*").union(near))
    rows = docs.select(*[(F.coalesce(F.col(c), F.lit("")) if c == "text" else F.col(c)).alias(f"c{i}") for i, c in enumerate(rest)])
    rows = rows.join(gone, (F.col(f"c{rest.index('doc_id')}") == F.col("gone_id")) & (F.xxhash64(f"c{at}") == F.col("gone_version")), "left")
    rows = rows.select(*[f"c{i}" for i in range(len(rest))], "gone")

    def over(batches):
        for b in batches:
            got = []
            for t, found in zip(b.column(at), b.column(len(rest)).to_pylist()):
                found = found or ()
                got.append(cut(t.as_py(), {x for r in found if r["lines"] for x in range(r["a"], r["b"])}, [(r["a"], r["b"]) for r in found if not r["lines"]]))
            text, hit, words, size = zip(*got) if got else ((), (), (), ())
            columns = [pa.array(text, pa.string()) if i == at else b.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hit, pa.int64()), pa.array(words, pa.int64()), pa.array(size, pa.int64())], names=[*rest, *made])

    schema = docs.select(*rest).schema
    for name in made:
        schema = schema.add(name, "long")
    return rows.mapInArrow(over, schema)
