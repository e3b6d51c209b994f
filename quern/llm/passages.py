"""Passages of LENGTH words that repeat, wherever their lines end.

Every window of LENGTH words is a paragraph of its own here, and its MinHash, the least hash of
its 5-word shingles, the band in which it collides with others. Windows that follow each other
and have their MinHash at one place are a run, and its words are its context. Runs whose
MinHash occurs once hold nothing that repeats; runs with equal contexts repeat as a whole; of
other runs that share half a window around the MinHash every window is compared by its own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop
from .common import materialise_hashes as materialise
from .near import key_of, rows_of, similar, with_leader
from .shingles import _SPACE, U, _power, mix, shingles, word_hashes

LENGTH, K = 50, 5
#: Words beside the MinHash's shingle that must be equal on one side for windows around it to be compared.
SIDE = 12
#: Where the MinHash stands in the windows around it that are compared.
PLACES = (0, 11, 22, 33, 45)
#: Words of the pieces, besides those SIDE words, of which one must be equal too, at about.
PIECE = 11
#: Words beside the MinHash's shingle that a window has at least on one of its sides.
HALF = (LENGTH - K + 1) // 2
#: Characters of texts that are hashed together, so few that the arrays stay in a processor's caches.
BLOCK = 1 << 18


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends, in bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])))
    return edge[0::2], edge[1::2]


def _hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words from start to stop, the same wherever they stand."""
    p, q = _power(len(h) + 1)
    out = []
    for x in (mix(h ^ U(0x5851F42D4C957F2D)), mix(h + U(0x2545F4914F6CDD1D))):
        sums = np.concatenate([[U(0)], np.cumsum(x * p[:-1])])
        out.append(key_of(mix((sums[stop] - sums[start]) * q[start])))
    return out[0], out[1]


def runs(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, place of the MinHash) of the runs of texts of counts words, places within all of h.

    The MinHash is the least of a window's shingle hashes, the leftmost of equals: both follow
    from the window alone.
    """
    none = np.zeros(0, np.int64)
    if not len(counts) or counts.max() < LENGTH:
        return none, none, none, none
    s = shingles(h, np.array([len(h)]), K)[0]
    bits = U(max(24, int(len(s)).bit_length()))
    least, width = s >> bits << bits | np.arange(len(s), dtype=np.uint64), LENGTH - K + 1
    done = 1
    while done < width:
        step = min(done, width - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[owner])
    at, own = (least[valid] & ((U(1) << bits) - U(1))).astype(np.int64), owner[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    return own[first], valid[first], np.diff(np.append(first, len(valid))), at[first]


def blocks(batches):
    """(doc_id, version, text, rest of the columns) of rows, BLOCK characters of texts at a time."""
    block, size = [], 0
    for b in batches:
        rest = [b.column(i).to_pylist() for i in range(3, b.num_columns)]
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), *rest):
            text = row[2].as_py()
            block.append((*row[:2], text, *row[3:]))
            size += len(text)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _again(own: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which entries have the key of an earlier one of the same text."""
    order = np.lexsort((at, key, own))
    out = np.zeros(len(at), bool)
    out[order[1:]] = (own[order][1:] == own[order][:-1]) & (key[order][1:] == key[order][:-1])
    return out


def _found(batches):
    """(context, left, right, before, after, doc_id, version, start, number, at, inner) of the runs.

    left and right hash half a window with the MinHash, before and after SIDE words with it, 0 where
    the text has none; at is its place; inner runs repeat one of the same text.
    """
    for block in blocks(batches):
        h, counts = word_hashes([t.lower().encode() for _, _, t in block])
        own, start, number, at = runs(h, counts)
        if not len(own):
            continue
        ends = np.cumsum(counts)
        begins = ends - counts
        sums = _hashes(h, np.concatenate([start, np.maximum(at - HALF, 0), at, np.maximum(at - SIDE, 0), at]), np.concatenate([start + number + LENGTH - 1, at + K, np.minimum(at + K + HALF, len(h)), at + K, np.minimum(at + K + SIDE, len(h))]))
        n = len(at)
        # A context's hash has the place of the MinHash in it.
        whole, second = (x[:n].view(np.uint64) for x in sums)
        context = key_of(mix(whole ^ mix(second + (at - start).astype(np.uint64))))
        left = np.where(at - HALF >= begins[own], sums[0][n : 2 * n] | 1, 0)
        right = np.where(at + K + HALF <= ends[own], sums[0][2 * n : 3 * n] & ~1, 0)
        before = np.where(at - SIDE >= begins[own], sums[0][3 * n : 4 * n] | 1, 0)
        after = np.where(at + K + SIDE <= ends[own], sums[0][4 * n :] & ~1, 0)
        ids, versions = np.array([i for i, _, _ in block], np.int64), np.array([v for _, v, _ in block], np.int64)
        columns = (context, left, right, before, after, ids[own], versions[own], (start - begins[own]).astype(np.int32), number.astype(np.int32), (at - begins[own]).astype(np.int32), _again(own, context, start))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["context", "left", "right", "before", "after", "doc_id", "version", "start", "number", "at", "inner"])


def _windows(batches):
    """(h1, h2, doc_id, version, start, inner) of each window of the open runs; inner are those that repeat one of the same text."""
    for block in blocks(batches):
        h, counts = word_hashes([t.lower().encode() for _, _, t, _ in block])
        begins = np.cumsum(counts) - counts
        spans = [(begins[k], k, r["start"], r["number"]) for k, row in enumerate(block) for r in row[3]]
        base, own, start, number = (np.array(c, np.int64) for c in zip(*spans))
        at = np.repeat(start - np.cumsum(number) + number, number) + np.arange(number.sum())
        h1, h2 = _hashes(h, at + np.repeat(base, number), at + np.repeat(base, number) + LENGTH)
        own = np.repeat(own, number)
        ids, versions = np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], np.int64)
        inner = _again(own, h1 ^ key_of(mix(h2.view(np.uint64))), at)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h1, h2, ids[own], versions[own], at.astype(np.int32), inner)], names=["h1", "h2", "doc_id", "version", "start", "inner"])


def passage_rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def joined(spans: DataFrame) -> DataFrame:
    """(doc_id, version, a, b) with the union of spans of LENGTH words or more, in fewer rows.

    Spans of a text that begin within LENGTH words of each other leave no gap between them.
    """
    near = F.floor(F.col("a") / LENGTH).cast("int").alias("_near")
    return spans.groupBy("doc_id", "version", near).agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_near")


def passage_runs(rows: DataFrame) -> DataFrame:
    """The runs of all texts of rows (doc_id, version, text), see `_found`."""
    return rows.mapInArrow(_found, "context long, left long, right long, before long, after long, doc_id long, version long, start int, number int, at int, inner boolean")


def pieces(place: int, after: bool) -> list[tuple[int, int]]:
    """The pieces of a window with its MinHash at `place` that the words on the side looked at do not cover.

    A change of a word is in one of them at most, or in two at the ends; of three or more one stays.
    """
    lo, hi = (place, min(LENGTH, place + K + SIDE)) if after else (max(0, place - SIDE), place + K)
    out = []
    for a, b in ((0, lo), (hi, LENGTH)):
        n = round((b - a) / PIECE)
        out += [(a + (b - a) * j // n, a + (b - a) * (j + 1) // n) for j in range(n)]
    return out


def _around(batches):
    """(node, doc_id, version, a, s1, s2, keys, text) of the windows around the places of each text.

    A key is the MinHash's side, its place in the window and one piece of the window's other words.
    """
    from pyspark import TaskContext

    context, number = TaskContext.get(), 0
    base = (context.partitionId() if context else 0) << 36
    names = ["node", "doc_id", "version", "a", "s1", "s2", "keys", "text"]
    # Halves are told apart by their last bit: 1 for the words before a MinHash.
    parts = {(i, side): pieces(place, not side) for i, place in enumerate(PLACES) for side in (0, 1)}
    for block in blocks(batches):
        texts = [t.encode() for _, _, t, _ in block]
        h, counts = word_hashes([t.lower().encode() for _, _, t, _ in block])
        begins = np.cumsum(counts) - counts
        at, own, window, seeds, spans = [], [], [], [], []
        for k, row in enumerate(block):
            met: dict[int, int] = {}
            for seed in row[3]:
                for i, place in enumerate(PLACES):
                    a = seed["at"] - place
                    if 0 <= a <= counts[k] - LENGTH:
                        if a not in met:
                            met[a] = len(at)
                            at.append(a)
                            own.append(k)
                        for span in parts[i, seed["key"] & 1]:
                            window.append(met[a])
                            seeds.append((seed["key"] * 8 + i) % (1 << 64))
                            spans.append(span)
        if not at:
            continue
        start, window, spans = np.array(at, np.int64) + begins[own], np.array(window), np.array(spans, np.int64)
        s1, s2 = _hashes(h, start, start + LENGTH)
        piece = _hashes(h, start[window] + spans[:, 0], start[window] + spans[:, 1])[0].view(np.uint64)
        keys = key_of(mix(np.array(seeds, np.uint64) ^ mix(piece + spans[:, 0].astype(np.uint64) * U(0x9FB21C651E98DF25))))
        order = np.lexsort((keys, window))
        keys, window = keys[order], window[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (window[1:] != window[:-1])
        listed = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(window[new], minlength=len(at)))]).astype(np.int32), pa.array(keys[new]))
        bounds = {k: word_bounds(texts[k]) for k in set(own)}
        shown = [texts[k][bounds[k][0][a] : bounds[k][1][a + LENGTH - 1]].decode() for k, a in zip(own, at)]
        ids, versions = np.array([x[0] for x in block], np.int64)[own], np.array([x[1] for x in block], np.int64)[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(at)) + base), pa.array(ids), pa.array(versions), pa.array(at, pa.int32()), pa.array(s1), pa.array(s2), listed, pa.array(shown)], names=names)
        number += len(at)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each element of lists of structs, and the elements' fields."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in lists.flatten().flatten()]


def _left(batches):
    """(doc_id, version, at, key) of each text's MinHashes, by either side, but for those whose words go anyhow."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            b = batch.slice(k, 256)
            own, (at, before, after) = _flat(b.column(2))
            of, (wa, wb) = _flat(b.column(3))
            sizes = np.zeros(b.num_rows, np.int64)
            np.maximum.at(sizes, own, at + K)
            np.maximum.at(sizes, of, wb)
            base = np.cumsum(sizes + 1) - sizes - 1
            step = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
            np.add.at(step, base[of] + wa, 1)
            np.add.at(step, base[of] + wb, -1)
            # How many words stay before each word.
            stay = np.concatenate([[0], np.cumsum(np.cumsum(step) <= 0)])
            left = stay[base[own] + at + K] > stay[base[own] + at]
            ids, versions = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for key in (before, after):
                some = left & (key != 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own[some]]), pa.array(versions[own[some]]), pa.array(at[some].astype(np.int32)), pa.array(key[some])], names=["doc_id", "version", "at", "key"])


def _framed(batches):
    """(doc_id, version, a) of windows that begin and end with a shingle that the leader of their cluster has too."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            b = batch.slice(k, 2048)
            texts = [t.lower().encode() for column in (3, 4) for t in b.column(column).to_pylist()]
            s, n = shingles(*word_hashes(texts), K)
            ends, half = np.cumsum(n), b.num_rows
            begins = ends - n
            led, at = s[begins[half] :], begins[half:] - begins[half]
            keep = np.ones(half, bool)
            for edge in (s[begins[:half]], s[ends[:half] - 1]):
                keep &= np.logical_or.reduceat(led == np.repeat(edge, n[half:]), at)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)], names=["doc_id", "version", "a"]).filter(pa.array(keep))


def near_spans(docs: DataFrame, found: DataFrame | None = None, least: float = 0.8, gone: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, a, b): windows of LENGTH words that are near an earlier one, by an exact Jaccard index of `least` or more.

    Runs whose MinHash has SIDE equal words on one side are candidates: of two windows that near
    each other one word in nine shingles differs at most, so words on one side of a
    MinHash stay the same. Windows around such a MinHash, at each of PLACES, are compared where they
    have it at one place and one more piece is equal, and clustered; of each cluster the first stays, and of the others those go that begin and end as
    some of it does, so that no window reaches over the end of a passage. Runs that repeat as a whole are left out, and so
    is what goes anyhow by gone (gone_id, gone_version, gone: words from wa to wb): what it repeats is there earlier.
    """
    rows = passage_rows(docs)
    found = materialise(passage_runs(rows), "passage-runs") if found is None else found
    again = found.where("not inner").groupBy("context").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").drop("_last")
    seeds = found.where("not inner").join(materialise(again, "whole-runs"), "context", "left").where("_first is null or doc_id = _first")
    seeds = seeds.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "before", "after")).alias("_found"))
    if gone is None:
        seeds = seeds.withColumn("gone", F.lit(None).cast("array<struct<wa:bigint,wb:bigint>>"))
    else:
        seeds = seeds.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")
    words = F.transform("gone", lambda g: F.struct(g["wa"].alias("wa"), g["wb"].alias("wb")))
    seeds = seeds.select("doc_id", "version", "_found", words.alias("gone")).mapInArrow(_left, "doc_id long, version long, at int, key long")
    seeds = materialise(seeds, "seeds")
    # Places by their hash: numbers are aggregated without a sort.
    place = F.xxhash64("doc_id", "version", "at")
    met = seeds.groupBy("key").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi")).where("_lo < _hi").select("key")
    met = seeds.join(materialise(met, "seed-keys"), "key").groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "key")).alias("_seeds"))
    met = materialise(met, "met-seeds")
    texts = rows_of(rows, met.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "version"]).join(met, ["doc_id", "version"])
    windows = texts.select("doc_id", "version", "text", "_seeds").mapInArrow(_around, "node long, doc_id long, version long, a int, s1 long, s2 long, keys array<long>, text string")
    windows = materialise(windows, "near-windows")
    same = with_leader(windows.select("node", "s1", "s2"), ["s1", "s2"]).where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    same = materialise(same, "same-windows")
    members = windows.select("node", "keys").join(same.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.explode("keys").alias("key"))
    roots = similar(members, windows.select("node", "text"), K, False, least, same, once=True).groupBy("node").agg(F.min("root").alias("root"))
    placed = windows.select("node", F.struct("doc_id", "version", "a", "node").alias("place")).join(roots, "node").select("root", "place")
    later = with_leader(placed, ["root"], "place").where("place.doc_id > leader.doc_id or place.doc_id = leader.doc_id and place.version = leader.version and place.a > leader.a")
    later = later.select("place.doc_id", "place.version", "place.a", F.col("place.node").alias("node"), F.col("leader.node").alias("leader"))
    texts = windows.select("node", "text")
    told = later.join(texts, "node").join(texts.select(F.col("node").alias("leader"), F.col("text").alias("first")), "leader").select("doc_id", "version", "a", "text", "first")
    out = told.mapInArrow(_framed, "doc_id long, version long, a int")
    out = materialise(joined(out.select("doc_id", "version", "a", (F.col("a") + LENGTH).alias("b"))), "near-spans")
    drop(seeds, met, windows, same)
    return out


def repeated_spans(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, a, b): spans of words whose union is what repeats an earlier window of LENGTH words.

    Earlier is before in the same text, or in a text of smaller doc_id; texts of one doc_id don't
    count as earlier than each other. version is the hash of the text, so that rows that
    repeat a doc_id have spans of their own texts. Case and amounts of white space don't
    count. Rows without doc_id are passed over.

    Hot passages: least ids combine before their shuffle, and runs meet them in joins of
    plain exchanges, which AQE splits.
    """
    rows = passage_rows(docs)
    found = materialise(passage_runs(rows), "passage-runs") if found is None else found
    # A window that repeats has HALF words on one side of its MinHash, so its run shares that half.
    # A run may come twice from here on, by either half; nothing that follows counts runs.
    sides = found.where("not inner").select("context", "doc_id", "version", "start", "number", F.explode(F.array("left", "right")).alias("side")).where("side <> 0")
    # Runs of one context need no look at their windows, unless others share a half with them.
    common = sides.groupBy("side").agg(F.count("*").alias("_n"), F.min("context").alias("_lo"), F.max("context").alias("_hi")).where("_n > 1")
    shared = materialise(sides.join(materialise(common.select("side", (F.col("_lo") < F.col("_hi")).alias("kinds")), "halves"), "side").drop("side"), "shared-runs")
    again = shared.groupBy("context").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").drop("_last")
    told = shared.join(again, "context", "left").withColumn("sure", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)))
    told = materialise(told.where("sure or kinds").select("doc_id", "version", "start", "number", "sure"), "told-runs")
    drop(shared)
    open_ = told.where("not sure").groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "number")).alias("_runs"))
    open_ = materialise(open_, "open-runs")
    texts = rows_of(rows, open_.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "version"]).join(open_, ["doc_id", "version"])
    windows = materialise(texts.select("doc_id", "version", "text", "_runs").mapInArrow(_windows, "h1 long, h2 long, doc_id long, version long, start int, inner boolean"), "windows")
    outer = windows.where("not inner")
    least = outer.groupBy("h1", "h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").drop("_last")
    later = outer.join(least, ["h1", "h2"]).where("doc_id > _first")
    span = lambda df, n: df.select("doc_id", "version", F.col("start").alias("a"), (F.col("start") + n + LENGTH - 1).alias("b"))
    whole = span(found.where("inner"), F.col("number")).union(span(told.where("sure"), F.col("number")))
    return joined(whole.union(span(later, F.lit(1))).union(span(windows.where("inner"), F.lit(1))))


def cut(text: str, gone: set[int], spans: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """(text left, lines removed or cut, words removed, bytes removed) without the lines `gone` and the words of spans.

    A line goes with its line feed if all its words go; of other lines what is left stays, and
    of white space what lies between removed words goes too.
    """
    if not gone and not spans:
        return text, 0, 0, 0
    # Every line with a line feed, the last one too, which goes at the end.
    raw = text.encode() + b"\n"
    starts, ends = word_bounds(raw)
    line_ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    line_starts = np.concatenate([[0], line_ends[:-1]])
    first = np.searchsorted(starts, np.append(line_starts, len(raw)))
    counts = np.diff(first)
    drop = np.zeros(len(starts) + 1, bool)
    for a, b in spans:
        drop[a:b] = True
    drop = drop[: len(starts)]
    mine = np.diff(np.concatenate([[0], np.cumsum(drop)])[first])
    whole = (counts > 0) & (mine == counts)
    whole[[i for i in gone if i < len(whole)]] = True
    part = ~whole & (mine > 0)
    line = np.repeat(np.arange(len(counts)), counts)
    out = np.flatnonzero(drop & part[line])
    # Words that follow each other in one line go with the white space between them.
    new = np.ones(len(out) + 1, bool)
    new[1:-1] = (out[1:] != out[:-1] + 1) | (line[out[1:]] != line[out[:-1]])
    cuts = np.concatenate([np.stack([line_starts[whole], line_ends[whole]], 1), np.stack([starts[out[new[:-1]]], ends[out[new[1:]]]], 1)])
    kept, at = [], 0
    for a, b in cuts[np.argsort(cuts[:, 0])].tolist():
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    left = b"".join(kept)[:-1]
    return left.decode(), int(whole.sum() + part.sum()), int(counts[whole].sum() + mine[part].sum()), len(raw) - 1 - len(left)
