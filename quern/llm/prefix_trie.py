"""The trie of conversation prefixes, by preorder intervals.

Conversations are sequences of turns. Every turn is a letter (a digest of role and text), and a
prefix is known by a hash that is a sum over its letters, so that it can be computed in pieces:
a conversation may lie in many partitions. Distinct nodes are ranked in lexicographic order,
subtrees are intervals of ranks, and what a subtree holds is a difference of prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise

#: Four sums modulo this prime make a prefix's hash, each over 30 bits of a turn's digest.
PRIME = (1 << 31) - 1
LANE = (1 << 31) - 1
BASES = [int(hashlib.sha256(f"prefix lane {k}".encode()).hexdigest(), 16) % (PRIME - 2) + 2 for k in range(4)]
#: The turns that a rebuilt conversation takes from the head of its base are fewer than this.
HEAD = 9
#: Conversations of one digest chunk: those whose ids agree but for the last bits.
CHUNK_BITS = 12
NODE = ["depth", "ha", "hb"]


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo PRIME."""
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def _split(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    return [a >> 31, a & LANE, b >> 31, b & LANE]


def _packed(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return lanes[0] << 31 | lanes[1], lanes[2] << 31 | lanes[3]


def _letters(xa: np.ndarray, xb: np.ndarray) -> list[np.ndarray]:
    low = (1 << 30) - 1
    return [(xa >> 30) + 1, (xa & low) + 1, (xb >> 30) + 1, (xb & low) + 1]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their conversations: place and hash within the part that this task has."""
    pid = TaskContext.get().partitionId()
    conv, at, carry = None, 0, [0, 0, 0, 0]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, xa, xb = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        first = np.r_[True, ids[1:] != ids[:-1]]
        goes_on = conv is not None and ids[0] == conv
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        place = np.arange(n) - start + 1
        head = np.cumsum(first) == 1
        if goes_on:
            place[head] += at
        sums = []
        for k, letter in enumerate(_letters(xa, xb)):
            terms = letter * powers(BASES[k], place) % PRIME
            total = np.cumsum(terms)
            before = np.where(start > 0, total[start - 1], 0)
            out = (total - before) % PRIME
            if goes_on:
                out[head] = (out[head] + carry[k]) % PRIME
            sums.append(out)
        conv, at, carry = ids[-1], int(place[-1]), [int(s[-1]) for s in sums]
        la, lb = _packed(sums)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, pid, np.int64)), pa.array(place.astype(np.int64)), pa.array(la), pa.array(lb), b.column(1), b.column(2), b.column(3)], names=["conv_id", "pid", "place", "la", "lb", "xa", "xb", "bytes"])


def _carried(parts: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """Of each partition whose first conversation began earlier: its id, how many of its turns came before, their hash.

    Two ids and, of conversations that lie in several partitions, a sum come to the driver for each partition.
    """
    ends = sorted((r["pid"], r["lo"], r["hi"]) for r in parts.groupBy("pid").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).collect())
    shared = sorted({b[1] for a, b in zip(ends, ends[1:]) if a[2] == b[1]})
    if not shared:
        return {}
    pieces: dict[int, list] = {}
    for r in parts.where(F.col("conv_id").isin(shared)).groupBy("conv_id", "pid").agg(F.max(F.struct("place", "la", "lb")).alias("last")).collect():
        pieces.setdefault(r["conv_id"], []).append((r["pid"], *r["last"]))
    out = {}
    for conv, runs in pieces.items():
        before, lanes = 0, [0, 0, 0, 0]
        for pid, n, la, lb in sorted(runs):
            if before:
                out[pid] = (conv, before, lanes)
            own = [la >> 31, la & LANE, lb >> 31, lb & LANE]
            lanes = [(h + pow(BASES[k], before, PRIME) * own[k]) % PRIME for k, h in enumerate(lanes)]
            before += n
    return out


def prefixes(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, pos, ha, hb, pa, pb, xa, bytes) of every turn, and the tables that this reads.

    pos counts from 1 in the order of turns; (ha, hb) is the hash of the prefix that ends here,
    (pa, pb) that of the one before. Rows are dealt by ranges of (conv_id, turn, digest, row), so
    no partition needs a whole conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    letters = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.octet_length(text).cast("long").alias("bytes"))
    letters = letters.select("conv_id", "turn", *(F.conv(F.substring("d", k, 15), 16, 10).cast("long").alias(c) for c, k in (("xa", 1), ("xb", 16))), "bytes", F.monotonically_increasing_id().alias("row"))
    letters = materialise(letters, "letters")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("xa"), F.col("xb"), F.col("row")]
    dealt = letters.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "xa", "xb", "bytes")
    parts = materialise(dealt.mapInArrow(_within, "conv_id bigint, pid bigint, place bigint, la bigint, lb bigint, xa bigint, xb bigint, bytes bigint"), "parts")
    drop(letters)
    carried = _carried(parts)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pid, place, la, lb, xa, xb = (b.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            lanes, pos = _split(la, lb), place.copy()
            for p in np.unique(pid):
                if int(p) in carried:
                    conv, before, add = carried[int(p)]
                    own = (pid == p) & (ids == conv)
                    pos[own] += before
                    for k in range(4):
                        lanes[k] = np.where(own, (add[k] + pow(BASES[k], before, PRIME) * lanes[k]) % PRIME, lanes[k])
            earlier = [(h - x * powers(BASES[k], pos)) % PRIME for k, (h, x) in enumerate(zip(lanes, _letters(xa, xb)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pos), *map(pa.array, (*_packed(lanes), *_packed(earlier))), b.column(5), b.column(7)], names=["conv_id", "pos", "ha", "hb", "pa", "pb", "xa", "bytes"])

    return parts.mapInArrow(whole, "conv_id bigint, pos bigint, ha bigint, hb bigint, pa bigint, pb bigint, xa bigint, bytes bigint"), [parts]


def _moved(h: tuple[Column, Column], own: tuple[Column, Column], cut: tuple[Column, Column], by: Column) -> tuple[Column, Column]:
    """The hash of base prefix h, followed by the conversation's own turns between `cut` and `own`, moved `by` places down."""

    def lanes(a: Column, b: Column) -> list[Column]:
        return [F.shiftright(a, 31), a.bitwiseAND(F.lit(LANE)), F.shiftright(b, 31), b.bitwiseAND(F.lit(LANE))]

    out = []
    for k, (x, y, z) in enumerate(zip(lanes(*h), lanes(*own), lanes(*cut))):
        back = F.element_at(F.array(*(F.lit(pow(BASES[k], -s, PRIME)).cast("long") for s in range(HEAD + 1))), (by + 1).cast("int"))
        out.append(F.pmod(x + F.pmod(y - z, F.lit(PRIME)) * back, F.lit(PRIME)))
    return F.shiftleft(out[0], 31).bitwiseOR(out[1]), F.shiftleft(out[2], 31).bitwiseOR(out[3])


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, h, b, base_head, length, ea, eb, ba, bb, ca, cb): each conversation with its head taken from its base.

    A conversation's base is conv_id - conv_id % 5 and it takes the first h turns of it, b of
    which exist; length and (ea, eb) are those of the rebuilt conversation, (ba, bb) the hash of
    what it takes, (ca, cb) that of its own first h turns. Only heads of at most 8 turns are joined.
    """
    head = F.struct("pos", "ha", "hb", "pa", "pb", "xa", "bytes")
    convs = turns.groupBy("conv_id").agg(F.max(F.struct("pos", "ha", "hb")).alias("last"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEAD, head))).alias("head"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    x = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(bases, "base", "left")
    x = x.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("long"))
    x = x.withColumn("b", F.least("h", F.coalesce(F.size("base_head"), F.lit(0)).cast("long"))).withColumn("b", F.greatest("b", F.lit(0).cast("long")))

    def hash_at(array: str, at: str) -> tuple[Column, Column]:
        # get() is null outside the array: the empty prefix, whose hash is zero.
        e = F.get(F.col(array), (F.col(at) - 1).cast("int"))
        return F.coalesce(e["ha"], F.lit(0).cast("long")), F.coalesce(e["hb"], F.lit(0).cast("long"))

    (ba, bb), (ca, cb) = hash_at("base_head", "b"), hash_at("head", "h")
    x = x.withColumns({"ba": ba, "bb": bb, "ca": ca, "cb": cb})
    ea, eb = _moved((F.col("ba"), F.col("bb")), (F.col("last.ha"), F.col("last.hb")), (F.col("ca"), F.col("cb")), F.col("h") - F.col("b"))
    more = F.col("last.pos") > F.col("h")
    return x.select(
        "conv_id", "h", "b", F.expr("filter(base_head, t -> t.pos <= b)").alias("base_head"),
        F.when(more, F.col("b") + F.col("last.pos") - F.col("h")).otherwise(F.col("b")).alias("length"),
        F.when(more, ea).otherwise(F.col("ba")).alias("ea"), F.when(more, eb).otherwise(F.col("bb")).alias("eb"), "ba", "bb", "ca", "cb",
    )


def summed(df: DataFrame, order: list[Column], sums: list[str], label: str) -> DataFrame:
    """df with its place in the order (`at`, from 0) and, of each column to sum, what stands before it (`before_<name>`).

    Dealt by ranges of the order; each task numbers and sums its own rows, and the partitions'
    totals, one row for each partition, give what came before them. Returns a written table's rows.
    """
    schema = df.schema
    names = schema.names

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, totals = TaskContext.get().partitionId(), 0, [0] * len(sums)
        for b in batches:
            n = b.num_rows
            columns = [pa.array(np.full(n, pid, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            for k, c in enumerate(sums):
                v = b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                run = np.cumsum(v)
                columns.append(pa.array(totals[k] + run - v))
                totals[k] += int(run[-1]) if n else 0
            at += n
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*names, "part", "at", *(f"before_{c}" for c in sums)])

    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema] + ["part bigint", "at bigint", *(f"before_{c} bigint" for c in sums)])
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(over, ddl), label)
    last = [F.max("at").alias("n"), *(F.max(F.col(f"before_{c}") + F.col(c)).alias(c) for c in sums)]
    offsets, run = [], [0] * (len(sums) + 1)
    for r in sorted(rows.groupBy("part").agg(*last).collect()):
        offsets.append((r["part"], *run))
        run = [run[0] + r["n"] + 1, *(x + r[c] for x, c in zip(run[1:], sums))]
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, "part bigint, o_at bigint" + "".join(f", o_{c} bigint" for c in sums))
    # One row for each partition, so the broadcast is as small as the number of tasks.
    out = rows.join(F.broadcast(table), "part").select(*names, (F.col("at") + F.col("o_at")).alias("at"), *((F.col(f"before_{c}") + F.col(f"o_{c}")).alias(f"before_{c}") for c in sums))
    out.scratch = rows.scratch
    return out


def ends_digests(members: DataFrame) -> DataFrame:
    """(depth, ha, hb, ends_sha256): SHA-256 of the ascending decimal ids of a node's own members, joined by commas.

    Ids that agree but for their last bits become one row first, so at most 4,096 ids meet in
    one value; what is digested in order is a stream of such rows.
    """
    chunks = members.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, names = None, None, [*NODE, "ends_sha256"]
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if key != node:
                    if digest:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=names)

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(over, "depth bigint, ha bigint, hb bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    preorder, subtree_end). Subtrees are the nodes with preorder in [preorder, subtree_end).

    Rows without conv_id belong to no conversation and are left out; a null role or text is
    empty; a null turn comes first; turns of equal number, repeated rows too, follow in the
    order of their digests; other columns have no effect; an empty table has no nodes.
    Texts are read once, for their digests; 120 bits of SHA-256 stand for a turn, and a prefix
    is the same if its length and four sums modulo 2^31 - 1 over its turns are.
    """
    turns, parts = prefixes(conversations)
    convs = materialise(rebuilt(turns), "convs")
    #: Equal conversations are one from here on, told by the least id and their number.
    ends = convs.groupBy(F.col("length").alias("depth"), F.col("ea").alias("ha"), F.col("eb").alias("hb")).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    ends = materialise(ends, "ends")
    reps = convs.join(ends.select(F.col("rep").alias("conv_id"), "n"), "conv_id").select(F.col("conv_id").alias("rep"), "n", "h", "b", "base_head", "ba", "bb", "ca", "cb")
    zero = F.lit(0).cast("long")
    top = reps.select("rep", "n", *(zero.alias(c) for c in ("depth", "ha", "hb", "pa", "pb", "xa", "bytes")))
    taken = reps.select("rep", "n", F.explode("base_head").alias("t")).select("rep", "n", F.col("t.pos").alias("depth"), *(F.col(f"t.{c}") for c in ("ha", "hb", "pa", "pb", "xa", "bytes")))
    own = turns.join(reps.drop("base_head").withColumnRenamed("rep", "conv_id"), "conv_id").where("pos > h")
    base, cut, by = (F.col("ba"), F.col("bb")), (F.col("ca"), F.col("cb")), F.col("h") - F.col("b")
    here, there = _moved(base, (F.col("ha"), F.col("hb")), cut, by), _moved(base, (F.col("pa"), F.col("pb")), cut, by)
    own = own.select(F.col("conv_id").alias("rep"), "n", (F.col("b") + F.col("pos") - F.col("h")).alias("depth"), here[0].alias("ha"), here[1].alias("hb"), there[0].alias("pa"), there[1].alias("pb"), "xa", "bytes")
    paths = materialise(top.unionByName(taken).unionByName(own), "paths")
    drop(*parts)

    nodes = paths.groupBy(*NODE).agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), *(F.max(c).alias(c) for c in ("pa", "pb", "xa", "bytes")))
    nodes = materialise(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ha"), F.col("pb").alias("hb")).agg(F.count("*").alias("n_children"))
    nodes_too = nodes.join(children, NODE, "left").join(ends.select(*NODE, F.lit(1).alias("ended")), NODE, "left")
    nodes_too = materialise(nodes_too.withColumns({"n_children": F.coalesce("n_children", zero), "ended": F.coalesce("ended", F.lit(0))}), "nodes")
    drop(nodes)
    nodes = nodes_too
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") + F.col("ended") > 1).alias("forked"))
    nodes = materialise(nodes.join(above, ["depth", "pa", "pb"], "left"), "nodes")
    drop(nodes_too)

    # A conversation's key: the turns it takes at forks, so that keys sort as conversations do. A path has a fork
    # only where another conversation leaves it, which is as long: at most the square root of twice the turns.
    turns_at_forks = paths.select("rep", *NODE).join(nodes.where("forked").select(*NODE, "xa"), NODE)
    keys = turns_at_forks.groupBy("rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "xa", "ha"))), lambda t: F.struct(t["xa"].alias("xa"), t["ha"].alias("ha"))).alias("key"))
    ranked = summed(ends.select("rep").join(keys, "rep", "left").withColumn("key", F.coalesce("key", F.expr("cast(array() as array<struct<xa:bigint,ha:bigint>>)"))).select("rep", "key"), [F.col("key"), F.col("rep")], [], "ranked")
    spans = paths.select("rep", *NODE).join(ranked.select("rep", "at"), "rep").groupBy(*NODE).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    placed = nodes.join(spans, NODE).select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "first", "last", leaf.alias("leaf"), saved.alias("saved"))
    placed = summed(placed, [F.col("first"), F.col("depth")], ["leaf", "saved"], "placed")
    drop(nodes, ranked, paths)

    # The subtree of a node ends where the nodes end that its last conversation adds to the trie.
    stops = placed.groupBy(F.col("first").alias("last")).agg((F.max("at") + 1).alias("subtree_end"), *(F.max(F.col(f"before_{c}") + F.col(c)).alias(f"to_{c}") for c in ("leaf", "saved")))
    digests = ends_digests(convs.select(F.col("length").alias("depth"), F.col("ea").alias("ha"), F.col("eb").alias("hb"), "conv_id"))
    out = placed.join(stops, "last").join(digests, NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("to_leaf") - F.col("before_leaf")).alias("n_leaves"), (F.col("to_saved") - F.col("before_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.col("at").alias("preorder"), "subtree_end",
    )
