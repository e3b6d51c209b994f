"""Repeated byte strings across documents, by merged Burrows-Wheeler transforms of what may repeat.

Every string of LENGTH bytes has one anchor, the least hash of its grams; equal strings have
equal anchors at equal places. So texts fall into runs of string starts with a common anchor,
and a run's bytes are its context. A run whose anchor occurs once holds nothing that repeats.
Runs with equal contexts repeat as a whole. Of different contexts around one anchor some
strings may be equal: their transforms are built in shards and merged by interleave
refinement, and the intervals of suffixes with a common prefix of LENGTH bytes are the
repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .near import rows_of
from .shingles import U, _power, mix

LENGTH, GRAM = 100, 36
GRAMS = LENGTH - GRAM + 1
#: Bytes of a super-letter of the transforms; LENGTH is a multiple. A byte alphabet takes LENGTH refinements, this one 2.
LETTER = 50
BLOCK = 1 << 20
#: Rows that one range of ids may number.
RANGE_BITS = 36
SHARD, MERGED = 1 << 16, 1 << 21


class Hashed:
    """Hashes of any part of a buffer from prefix sums."""

    def __init__(self, buf: np.ndarray) -> None:
        p, self.q = _power(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + U(1)) * p[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.q[start])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, number, anchor hash, context hash) of the runs of string starts with one anchor.

    A string's anchor is the least of its gram hashes, to 40 bits, and the leftmost of equals:
    both follow from the string alone.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH or sizes.max() < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashed = Hashed(buf)
    n = len(buf) - GRAM + 1
    gram = mix((hashed.sums[GRAM:] - hashed.sums[:n]) * hashed.q[:n])
    bits = U(max(24, int(n).bit_length()))
    least = gram >> bits << bits | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < GRAMS:
        least = np.minimum(least[: len(least) - (GRAMS - width)], least[GRAMS - width :])
    anchor = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[owner])
    a, o = anchor[valid], owner[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(valid)))
    start, at, own = valid[first], a[first], o[first]
    context = mix(hashed.of(start, start + number + LENGTH - 1) + (at - start).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F) + number.astype(np.uint64))
    return own, start - (ends - sizes)[own], number, gram[at], context


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Documents (key, bytes) in blocks of about BLOCK bytes, by key within a block."""
    block, size = [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            block.append((i, raw))
            size += len(raw)
            if size >= BLOCK:
                block.sort()
                yield [i for i, _ in block], [t for _, t in block]
                block, size = [], 0
    if block:
        block.sort()
        yield [i for i, _ in block], [t for _, t in block]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each block; one that repeats a run of the block is sure to go and needs no partner (sure = true)."""
    for keys, texts in _blocks(batches):
        own, start, number, anchor, context = runs(texts)
        if not len(own):
            continue
        both = mix(anchor ^ mix(context))
        order = np.argsort(both, kind="stable")
        again = np.zeros(len(both), bool)
        again[order[1:]] = both[order[1:]] == both[order[:-1]]
        doc = np.array(keys, np.int64)[own]
        spread = mix(both + doc.view(np.uint64))  # sure runs meet no others, so they are dealt out evenly
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(again, spread, anchor).view(np.int64), context.view(np.int64), doc, start.astype(np.int32), number.astype(np.int16), again)], names=["anchor", "context", "key", "start", "number", "sure"])


# --- transforms and their merging -----------------------------------------------------------------


class Shard:
    """The transform of the letter chains of some contexts, with the places of its suffixes.

    A chain is every LETTER-th position of a context. rows: for each suffix in order its
    (context, position), position -1 for the empty suffix that ends a chain. before: the
    letter that precedes it, 0 if it is a whole chain.
    """

    def __init__(self, context: np.ndarray, at: np.ndarray, letters: list[np.ndarray], before: np.ndarray, chain: np.ndarray, ends: int, last: np.ndarray) -> None:
        order = np.lexsort((chain, *letters[::-1]))
        self.context = np.concatenate([np.full(ends, -1), context[order]])
        self.at = np.concatenate([np.full(ends, -1), at[order]])
        self.before = np.concatenate([last, before[order]])
        self.ends = ends


def shards_of(contexts: list[bytes]) -> list[Shard]:
    """Transforms of the contexts, SHARD positions or so each, over one alphabet of super-letters."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    hashed = Hashed(np.frombuffer(b"".join(contexts), np.uint8))
    n = np.maximum(0, sizes - LETTER + 1)
    base = np.cumsum(sizes) - sizes
    context = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where = base[context] + at
    letter = np.unique(hashed.of(where, where + LETTER), return_inverse=True)[1].astype(np.int64) + 1
    index = np.arange(len(at))
    letters, step, alive = [letter], LETTER, True
    while alive:  # the letters that follow, 0 beyond the end
        inside = at + step < n[context]
        alive = bool(inside.any())
        if alive:
            letters.append(np.where(inside, letter[np.where(inside, index + step, 0)], 0))
            step += LETTER
    before = np.where(at >= LETTER, letter[np.where(at >= LETTER, index - LETTER, 0)], 0)
    tail = at + LETTER >= n[context]  # the last letters of chains
    # Chains in the order of their ends, so that an empty suffix stands at its chain's number.
    residue = at % LETTER
    chain = context * LETTER + residue
    out, lo = [], 0
    cuts = np.searchsorted(np.cumsum(n), np.arange(SHARD, int(n.sum()) + SHARD, SHARD))
    bounds = np.append(0, np.cumsum(n))
    for c in np.unique(np.minimum(cuts + 1, len(n))):
        a, b = bounds[lo], bounds[c]
        lo = c
        if a == b:
            continue
        part = slice(a, b)
        ends = tail[part]
        by_chain = np.argsort(chain[part][ends])
        out.append(Shard(context[part], at[part], [x[part] for x in letters], before[part], chain[part], int(ends.sum()), letter[part][ends][by_chain]))
    return out


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common, context, at): suffixes of all shards in the order of their first `depth` letters.

    The interleave names the shard of each suffix. Starting from the shards one after the
    other, each round reads the shards' transforms in its order and deals the entries stably
    to their letters: after k rounds it is right for prefixes of k letters. Blocks of equal
    prefixes split on the way; common[i] is the length, in letters, of the prefix that suffix
    i shares with the one before it, `depth` at most.
    """
    ends = np.array([s.ends for s in shards])
    head = np.repeat(np.arange(len(shards)), ends)
    z = np.repeat(np.arange(len(shards)), [len(s.before) for s in shards])
    before = np.concatenate([s.before for s in shards])
    block = np.zeros(len(z), np.int64)
    common = np.full(len(z), depth, np.int64)
    common[0] = 0
    for k in range(depth):
        letter = np.empty(len(z), np.int64)
        letter[np.argsort(z, kind="stable")] = before
        inner = np.flatnonzero(letter)
        order = inner[np.argsort(letter[inner], kind="stable")]
        z = np.concatenate([head, z[order]])
        first, old = np.concatenate([-1 - np.arange(len(head)), letter[order]]), np.concatenate([np.zeros(len(head), np.int64), block[order]])
        new = np.ones(len(z), bool)
        new[1:] = (first[1:] != first[:-1]) | (old[1:] != old[:-1])
        common[new & (common == depth)] = k
        block = np.cumsum(new)
    place = np.argsort(z, kind="stable")
    context, at = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    context[place] = np.concatenate([s.context for s in shards])
    at[place] = np.concatenate([s.at for s in shards])
    return common, context, at


def repeated(contexts: list[bytes], number: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which strings of the contexts also start earlier: a flag for each of number[i] starts of context i, one after the other.

    rank orders the contexts' documents, start places a context in its document.
    """
    flags = np.zeros(int(number.sum()), bool)
    shards = shards_of(contexts)
    if not shards:
        return flags
    common, context, at = merged(shards, LENGTH // LETTER)
    interval = np.cumsum(common < LENGTH // LETTER)
    real = (context >= 0) & (at < number[np.maximum(context, 0)])
    interval, context, at = interval[real], context[real], at[real]
    order = np.lexsort((start[context] + at, rank[context], interval))
    i = interval[order]
    later = np.zeros(len(i), bool)
    later[1:] = i[1:] == i[:-1]
    base = np.cumsum(number) - number
    flags[(base[context] + at)[order][later]] = True
    return flags


def _spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of each document."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - shift)[np.append(first[1:] - 1, len(doc) - 1)]


def _merged_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove from the contexts that share an anchor; rows come by anchor, groups stay whole."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(rows: pa.Table) -> pa.RecordBatch:
        contexts = [x.as_buffer().to_pybytes() for x in rows.column("bytes").combine_chunks()]
        number, start, key = (rows.column(c).to_numpy().astype(np.int64) for c in ("number", "start", "key"))
        flags = repeated(contexts, number, key, start)
        owner = np.repeat(np.arange(len(number)), number)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        doc, a, b = _spans(key[owner][flags], at[flags], at[flags] + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["key", "a", "b"])

    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= MERGED:
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield flush(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held) // max(1, len(rows)) * (len(rows) - cut)
    if held and sum(map(len, held)):
        yield flush(pa.Table.from_batches(held))


# --- the operator ---------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row that sorts as doc_id does, null last; rows that repeat an id follow each other by text.

    Unless ids repeat or are null the key is the id. Otherwise rows are dealt to ranges of (id,
    text) and numbered there, below the number of the range; written once and read from
    there, keys stay what they are.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("key"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, n = TaskContext.get(), 0
        base = (context.partitionId() if context else 0) << RANGE_BITS
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(np.arange(n, n + len(b), dtype=np.int64) + base)], names=["doc_id", "text", "key"])
            n += len(b)

    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text").repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return materialise(rows.mapInArrow(numbered, "doc_id bigint, text string, key bigint"), "keyed")


def removed_spans(keyed: DataFrame) -> DataFrame:
    """(key, a, b): spans of bytes, some overlapping, whose union is what repeats an earlier string of LENGTH bytes."""
    found = keyed.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_anchored, "anchor bigint, context bigint, key bigint, start int, number smallint, sure boolean")
    same = W.partitionBy("anchor", "context").orderBy("key", "start")
    whole = W.partitionBy("anchor").orderBy("context", "key", "start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = found.repartition("anchor").withColumn("_nth", F.row_number().over(same)).withColumn("_kinds", F.first("context").over(whole) != F.last("context").over(whole))
    # An equal context that starts earlier removes a run; the first of several contexts has to be looked into.
    found = found.withColumn("sure", F.col("sure") | (F.col("_nth") > 1)).where("sure or _kinds").select("anchor", "key", "start", "number", "sure")
    found = materialise(found, "runs")
    open_ = found.where("not sure")
    by_doc = open_.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "number")).alias("_runs"))
    texts = rows_of(keyed.select("key", F.coalesce("text", F.lit("")).cast("binary").alias("bytes")), materialise(open_.select("key").distinct(), "keys"), "key")
    cut = texts.join(by_doc, "key").select("key", "bytes", F.explode("_runs").alias("_r")).select("key", "_r.*", F.substring("bytes", F.col("_r.start") + 1, F.col("_r.number") + F.lit(LENGTH - 1)).alias("bytes"))
    grouped = cut.select("anchor", "key", "start", "number", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    merged_ = grouped.mapInArrow(_merged_groups, "key bigint, a int, b int")
    return found.where("sure").select("key", F.col("start").alias("a"), (F.col("start") + F.col("number") + LENGTH - 1).alias("b")).union(merged_)


def _cut(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, t, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = t.as_buffer().to_pybytes()
            kept, at, gone, n = [], 0, 0, 0
            for s in sorted(spans or [], key=lambda s: s["a"]):
                a, b = s["a"], s["b"]
                if n and a <= at:
                    gone += max(0, b - at)
                    at = max(at, b)
                else:
                    kept.append(raw[at:a])
                    n, gone, at = n + 1, gone + b - a, b
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((i, len(raw), gone, n, hashlib.sha256(left).hexdigest(), *([left] if with_bytes else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        cols = list(zip(*out)) if out else [[]] * (5 + with_bytes)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: len(cols)])


def without_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the remaining bytes on demand.

    Texts are taken as UTF-8 bytes, null as empty. Each byte goes that a string of LENGTH
    bytes covers which also starts earlier: in a row of smaller doc_id, or before in the same
    one. Null ids come after all others, and rows that repeat an id are documents of their
    own, ordered by text. Texts of fewer than LENGTH bytes stay. Other columns are ignored.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    spans = removed_spans(keyed).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    rows = keyed.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), "key").join(spans, "key", "left")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes
    return rows.select("doc_id", "bytes", "_spans").mapInArrow(lambda b: _cut(b, with_bytes), schema)
