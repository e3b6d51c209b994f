"""Hard negatives by a vector-approximation file: cells bound scores, and only what may enter a window is scored.

Rows are dealt at random into groups, anchors go by every group in blocks. A group holds its
rows as cell numbers, one byte a dimension. For a block of anchors a table for each dimension
gives the least product of each anchor with each cell; summed over dimensions by lookup it
bounds every score from below, and the width of the cells bounds it from above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise

CELLS = 64
#: Anchors of a block; rows that are bounded at a time; rows of a group at most, about; pairs that are scored at a time.
BLOCK, CHUNK, GROUP, PAIRS = 128, 4096, 65_536, 65_536
POSITIVES, NEGATIVES = 5, 10
#: Scores must be sums that 64 bits hold.
LARGEST = 1 << 62
NOWHERE = -(1 << 62)


def vectors(embeddings: DataFrame) -> DataFrame:
    """(uid, vec_id, label, comps) of the rows that take part, from a written table; uid tells repeated rows apart."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = x.where(F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
    x = x.select(F.monotonically_increasing_id().alias("uid"), "vec_id", moved.alias("label"), F.transform("v", lambda c: F.floor(c * 256)).alias("comps"))
    return materialise(x, "vectors")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Cells:
    """The cells of each dimension: equal widths from the least component to the largest."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low = low
        self.width = (high - low) // CELLS + 1
        most = int(max(abs(int(v)) for v in (*low, *high, 0)))
        if most * most * max(1, len(low)) >= LARGEST:
            raise ValueError("vectors have components too large for scores of 64 bits")
        self.kind = np.int32 if 4 * most * most * max(1, len(low)) < 1 << 31 else np.int64
        self.edges = low[:, None] + self.width[:, None] * np.arange(CELLS)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.low) // self.width).astype(np.uint8)

    def tables(self, anchors: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each dimension the least product of each anchor with each cell; and what the largest score is above the least."""
        at = np.where(anchors.T[:, None, :] >= 0, self.edges[:, :, None], (self.edges + self.width[:, None] - 1)[:, :, None])
        return list((at * anchors.T[:, None, :]).astype(self.kind)), np.abs(anchors) @ (self.width - 1)


def least_scores(tables: list[np.ndarray], codes: np.ndarray, n_anchors: int, kind: type) -> np.ndarray:
    """Lower bounds of the scores of rows and anchors, summed over dimensions by lookup."""
    out = np.zeros((len(codes), n_anchors), kind)
    for d, table in enumerate(tables):
        out += table[codes[:, d]]
    return out


def scores(x: np.ndarray, anchors: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact scores of pairs."""
    return np.concatenate([np.einsum("ij,ij->i", x[r[k : k + PAIRS]], anchors[b[k : k + PAIRS]]) for k in range(0, len(r), PAIRS)] or [np.zeros(0, np.int64)])


class Best:
    """The best rows of each list so far: (list, row, score), by score and then by the row's order."""

    def __init__(self, lists: int, most: int) -> None:
        self.most = most
        self.of, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(lists, NOWHERE)

    def add(self, of: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        if not len(of):
            return
        of, row, score = np.r_[self.of, of], np.r_[self.row, row], np.r_[self.score, score]
        order = np.lexsort((row, -score, of))
        of, row, score = of[order], row[order], score[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        keep = place < self.most
        self.of, self.row, self.score = of[keep], row[keep], score[keep]
        full = place[keep] == self.most - 1
        self.least[self.of[full]] = self.score[full]


def kth(bounds: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of the masked lower bounds of each anchor; so much its k best reach at least."""
    if len(bounds) < k:
        return np.full(bounds.shape[1], NOWHERE)
    return np.partition(np.where(mask, bounds, NOWHERE), len(bounds) - k, axis=0)[len(bounds) - k]


class Group:
    """Rows of one group in the order of (vec_id, uid), null ids last, as an approximation file with the exact vectors beside it."""

    def __init__(self, cells: Cells, parts: list[tuple]) -> None:
        uid, vec_id, unknown, label = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((uid, vec_id, unknown))
        self.uid, self.vec_id, self.unknown, self.label = uid[order], vec_id[order], unknown[order], label[order]
        self.x = np.concatenate([p[4] for p in parts])[order]
        self.cells, self.codes = cells, cells.codes(self.x)

    def bounds(self, anchors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, lower, upper) bounds of scores, some rows at a time."""
        tables, above = self.cells.tables(anchors)
        for k in range(0, len(self.uid), CHUNK):
            s = slice(k, k + CHUNK)
            low = least_scores(tables, self.codes[s], len(anchors), self.cells.kind).astype(np.int64)
            yield s, low, low + above

    def positives(self, a: Anchors) -> Best:
        """The best other rows of each anchor's label."""
        best = Best(len(a.uid), POSITIVES)
        for s, low, high in self.bounds(a.x):
            same = (self.label[s, None] == a.label) & (self.uid[s, None] != a.uid)
            r, b = np.nonzero(same & (high >= np.maximum(kth(low, same, POSITIVES), best.least)))
            r = r + s.start
            best.add(b, r, scores(self.x, a.x, r, b))
        return best

    def negatives(self, a: Anchors) -> Best:
        """The best rows of other labels in the window of each anchor and positive; a list for each of these."""
        best = Best(len(a.uid) * POSITIVES, NEGATIVES)
        for s, low, high in self.bounds(a.x):
            other = self.label[s, None] != a.label
            maybe = np.zeros(other.shape, bool)
            for p in range(POSITIVES):
                lo, hi = a.windows[p]
                sure = other & (low >= lo) & (high <= hi)
                at_least = np.maximum(np.maximum(kth(low, sure, NEGATIVES), best.least[p::POSITIVES]), lo)
                maybe |= other & (high >= at_least) & (low <= hi)
            r, b = np.nonzero(maybe)
            r = r + s.start
            score = scores(self.x, a.x, r, b)
            for p in range(POSITIVES):
                lo, hi = a.windows[p]
                inside = (score >= lo[b]) & (score <= hi[b])
                best.add(b[inside] * POSITIVES + p, r[inside], score[inside])
        return best


class Anchors:
    """A block of anchors: a row of numbers for each."""

    def __init__(self, block: bytes, width: int) -> None:
        m = np.frombuffer(block, np.int64)
        m = m.reshape(-1, 4 + width + 3 * POSITIVES)
        self.uid, self.vec_id, self.label, self.n = m[:, 0], m[:, 1], m[:, 2], m[:, 3]
        self.x, rest = np.ascontiguousarray(m[:, 4 : 4 + width]), m[:, 4 + width :]
        self.score, self.positive, self.unknown = (rest[:, k * POSITIVES : (k + 1) * POSITIVES] for k in range(3))
        there = np.arange(POSITIVES) < self.n[:, None]
        #: 30 positive <= 100 negative <= 90 positive, as least and largest score; no score fits a window that is not there.
        lo, hi = np.where(there, -(-3 * self.score // 10), -NOWHERE), np.where(there, 9 * self.score // 10, NOWHERE)
        self.windows = [(lo[:, p], hi[:, p]) for p in range(POSITIVES)]


def _blocks(anchors: DataFrame, width: int) -> DataFrame:
    """Anchors (uid, vec_id, label, comps, found) in blocks: one binary value for some of them."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.zeros((b.num_rows, 4 + width + 3 * POSITIVES), np.int64)
            for k in range(3):
                m[:, k] = b.column(k).to_numpy(zero_copy_only=False)
            m[:, 4 : 4 + width] = matrix(b.column(3), width)
            for row, found in zip(m, b.column(4).to_pylist()):
                row[3] = len(found)
                for p, f in enumerate(found):
                    at = 4 + width + p
                    row[at], row[at + POSITIVES], row[at + 2 * POSITIVES] = f["score"], f["vec_id"] or 0, f["vec_id"] is None
            yield pa.RecordBatch.from_arrays([pa.array([m[k : k + BLOCK].tobytes() for k in range(0, len(m), BLOCK)], pa.binary())], names=["block"])

    return anchors.select("uid", "vec_id", "label", "comps", "found").mapInArrow(over, "block binary")


def _met(rows: DataFrame, anchors: DataFrame, groups: int, width: int, cells: Cells, found: Callable[[Group, Anchors], tuple[list[np.ndarray], list[str]]], ddl: str) -> DataFrame:
    """What `found` gives for each group of rows and each block of anchors.

    A task holds one group at a time; blocks stream past it.
    """
    null = F.lit(None)
    held = rows.select(F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("at"), F.lit(0).alias("kind"), "uid", "vec_id", "label", "comps", null.cast("binary").alias("block"))
    passing = _blocks(anchors, width).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("at"), F.lit(1).alias("kind"), *(null.cast("long").alias(c) for c in ("uid", "vec_id", "label")), null.cast("array<bigint>").alias("comps"), "block")
    dealt = held.unionByName(passing).repartition(groups, "at").sortWithinPartitions("at", "kind")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, group = None, [], None
        for b in batches:
            ats, kinds = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.flatnonzero((ats[1:] != ats[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if i == j:
                    continue
                if ats[i] != at:
                    at, parts, group = ats[i], [], None
                run = b.slice(i, j - i)
                if not kinds[i]:
                    ids = run.column(3)
                    parts.append((run.column(2).to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), run.column(4).to_numpy(zero_copy_only=False), matrix(run.column(5), width)))
                    continue
                if not parts and group is None:
                    continue
                if group is None:
                    group, parts = Group(cells, parts), []
                for block in run.column(6):
                    columns, names = found(group, Anchors(block.as_py(), width))
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return dealt.mapInArrow(over, ddl)


def _ranges(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of rows, least, largest component of each dimension); a row for each task comes to the driver."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            width = max(len(low), int(np.diff(b.column(0).offsets.to_numpy()).max()))
            m = matrix(b.column(0), width)
            low, high = (np.pad(v, (0, width - len(v))) for v in (low, high))
            low, high = (np.minimum(low, m.min(0)), np.maximum(high, m.max(0))) if n else (m.min(0), m.max(0))
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([low], pa.list_(pa.int64())), pa.array([high], pa.list_(pa.int64()))], names=["n", "low", "high"])

    parts = [r for r in rows.select("comps").mapInArrow(over, "n bigint, low array<bigint>, high array<bigint>").collect() if r["n"]]
    width = max((len(r["low"]) for r in parts), default=0)
    low, high = (np.array([np.pad(np.array(r[c], np.int64), (0, width - len(r[c]))) for r in parts] or [[]], np.int64) for c in ("low", "high"))
    return sum(r["n"] for r in parts), low.min(0), high.max(0)


def _best(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best rows of each list; Spark keeps no more than `most` of a task before it shuffles them."""
    order: list[Column] = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("uid")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label, a null vector, or a null or non-finite component take no part. A
    row without vec_id is no anchor and comes last among equal scores; repeated rows count each,
    and a repeated anchor mines for itself; shorter vectors count as if filled up with zeros; other
    columns have no effect; an empty table, and one without anchors, gives no rows. Components whose scores could
    pass 62 bits raise an error.

    Work is a row and anchor at a time, but only lookups: exact scores are those of rows whose
    bounds may enter a window, or the positives. Every row of equal score counts.
    """
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    n, low, high = _ranges(rows)
    cells, width = Cells(low, high), len(low)
    groups = max(1, -(-n // GROUP), min(spark.sparkContext.defaultParallelism, n // 2048))
    none = F.expr("cast(array() as array<struct<score:bigint,vec_id:bigint>>)")
    anchors = rows.where(F.col("vec_id") % 100 == 0)

    def positives(g: Group, a: Anchors) -> tuple[list, list[str]]:
        best = g.positives(a)
        ids = pa.array(g.vec_id[best.row], mask=g.unknown[best.row])
        return [a.uid[best.of], best.score, ids, g.uid[best.row]], ["anchor", "score", "vec_id", "uid"]

    near = _met(rows, anchors.withColumn("found", none), groups, width, cells, positives, "anchor bigint, score bigint, vec_id bigint, uid bigint")
    near = _best(near, ["anchor"], POSITIVES).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("found"))
    near = near.select(F.col("anchor").alias("uid"), F.transform("found", lambda f: F.struct(f["score"].alias("score"), f["vec_id"].alias("vec_id"))).alias("found"))
    known = materialise(anchors.join(near, "uid"), "anchors")

    def negatives(g: Group, a: Anchors) -> tuple[list, list[str]]:
        best = g.negatives(a)
        b, p = best.of // POSITIVES, best.of % POSITIVES
        positive = pa.array(a.positive[b, p], mask=a.unknown[b, p].astype(bool))
        ids = pa.array(g.vec_id[best.row], mask=g.unknown[best.row])
        return [a.uid[b], a.vec_id[b], p, positive, a.score[b, p], best.score, ids, g.uid[best.row]], ["anchor", "anchor_id", "place", "positive_id", "positive_score", "score", "vec_id", "uid"]

    found = _met(rows, known, groups, width, cells, negatives, "anchor bigint, anchor_id bigint, place bigint, positive_id bigint, positive_score bigint, score bigint, vec_id bigint, uid bigint")
    found = materialise(_best(found, ["anchor", "place"], NEGATIVES).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    drop(rows, known)
    return found
