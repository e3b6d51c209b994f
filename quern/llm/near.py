"""Links between similar texts from colliding keys, without all pairs of a bucket.

In every bucket each member is compared with the least one, its leader. Members that end up
connected need no other comparison. The rest are compared exhaustively, in blocks, except
where the triangle inequality rules a link out; so no link between members of a bucket is
lost from the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, handed_back
from .common import materialise_hashes as materialise
from .shingles import Prepared, common_counts, distance, jaccard_distance, jaccard_distances, prepared

#: Ids that are broadcast at most (16 bytes each in the executors); more are shuffled.
BROADCAST_IDS = 1 << 20
#: Members that one task compares exhaustively at once; larger sets are dealt to pairs of blocks.
BLOCK = 256
#: Characters of texts that are prepared together.
PIECE = 1 << 20


def with_leader(rows: DataFrame, keys: list[str], value: str = "node") -> DataFrame:
    """rows whose key several have, with the key's least value as `leader` and its number of rows as `members`.

    Counts and minima combine by task before their shuffle, and are written; so both sides
    of the join are plain exchanges, and AQE splits the rows of a hot key.
    """
    least = rows.groupBy(*keys).agg(F.min(value).alias("leader"), F.count("*").alias("members")).where("members > 1")
    return rows.join(materialise(least, "leaders"), keys)


def _buckets(members: DataFrame) -> DataFrame:
    """(key, node, leader) of nodes that share a key, none twice; of keys with the same nodes only the least.

    Near copies share most of their bands, and the same nodes need to be compared once. Sets are
    told apart by their least node, size and hashes.
    """
    sets = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("_nodes")).where("members > 1")
    once = sets.groupBy("leader", "members", "_nodes").agg(F.min("key").alias("key")).select("key", "leader")
    return members.join(materialise(once, "leaders"), "key").select("key", "node", "leader")


def rows_of(rows: DataFrame, ids: DataFrame, node: str = "node") -> DataFrame:
    """The rows with one of the distinct ids: by broadcast while their number is within BROADCAST_IDS."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), node, "left_semi")


def _compared(pairs: DataFrame, k: int, ordered: bool, upto: float) -> DataFrame:
    """(u, v, d, j) of rows (u, v, tu, tv).

    d is the distance, `upto` for all that are further: what `distance` returns beyond it is no
    distance, and the triangle inequality holds of distances clamped at a bound. j is the
    Jaccard distance, exact everywhere; it never exceeds the ordered one.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d, j = 0, [], []
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            while at < len(b):
                # A leader stands in many rows, its text is prepared once in a piece of the batch.
                texts: dict[int, str] = {}
                to, size = at, 0
                while to < len(b) and (to == at or size < PIECE):
                    for node, column in ((u[to], 2), (v[to], 3)):
                        if node not in texts:
                            texts[node] = b.column(column)[to].as_py() or ""
                            size += len(texts[node])
                    to += 1
                if not ordered:
                    index = {node: i for i, node in enumerate(texts)}
                    got = jaccard_distances(list(texts.values()), [index[x] for x in u[at:to]], [index[y] for y in v[at:to]], k)
                    j += got.tolist()
                    d += np.minimum(upto, got).tolist()
                    at = to
                    continue
                ready = dict(zip(texts, prepared(list(texts.values()), k)))
                for x, y in zip(u[at:to], v[at:to]):
                    px, py = ready[x], ready[y]
                    j.append(jaccard_distance(px, py))
                    d.append(min(upto, distance(px, py, True, upto) if j[-1] <= upto else j[-1]))
                at = to
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64()), pa.array(j, pa.float64())], names=["u", "v", "d", "j"])

    return pairs.select("u", "v", "tu", "tv").mapInArrow(handed_back(over), "u bigint, v bigint, d double, j double")


def _exhaustive(k: int, ordered: bool, least: float) -> Callable:
    """Links (u, v) of components with near members in a block, or in two blocks, that aren't connected otherwise.

    The Jaccard indices of all pairs come from one product of matrices; only pairs near enough by
    it are aligned, unless they are connected already, none of them is open, or their
    distances to their common leader, clamped or of Jaccard, differ by more than a link may have.
    """
    far = 1 - least

    def links(rows: list[tuple], ready: dict[int, Prepared]) -> list[tuple[int, int]]:
        nodes, comps, dist, jac, is_open, block = (list(c) for c in zip(*(r[3:9] for r in rows)))
        one, other = rows[0][1:3]
        sides = [range(len(rows))] * 2 if one == other else [[i for i, x in enumerate(block) if x == s] for s in (one, other)]
        dist, jac, is_open = np.array(dist), np.array(jac), np.array(is_open)
        texts = [[ready[nodes[i]] for i in side] for side in sides]
        same = common_counts(texts[0], texts[0] if one == other else texts[1])
        n = np.array([ready[x].n for x in nodes], np.float64)
        a, b = np.array(sides[0], np.int64)[:, None], np.array(sides[1], np.int64)[None, :]
        near = (1 - same / np.maximum(1, n[a] + n[b] - same) <= far + 1e-9) & (is_open[a] | is_open[b]) & (np.abs(dist[a] - dist[b]) <= far + 1e-9) & (np.abs(jac[a] - jac[b]) <= far + 1e-9)
        if one == other:
            near &= a < b
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(near)):
            i, j = sides[0][x], sides[1][y]
            x, y = find(comps[i]), find(comps[j])
            if x != y and distance(ready[nodes[i]], ready[nodes[j]], ordered, far) <= far + 1e-12:
                root[max(x, y)] = min(x, y)
                out.append((comps[i], comps[j]))
        return out

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, b1, b2); groups of few texts are prepared together."""
        groups: list[list[tuple]] = []
        texts: dict[int, str] = {}
        last, size = None, 0

        def flush() -> pa.RecordBatch:
            ready = dict(zip(texts, prepared(list(texts.values()), k)))
            found = [x for g in groups if len(g) > 1 for x in links(g, ready)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(9)]
            for row, text in zip(zip(*columns), b.column(9)):
                if row[:3] != last:
                    if size >= PIECE:
                        yield flush()
                        groups, texts, size = [], {}, 0
                    groups.append([])
                    last = row[:3]
                groups[-1].append(row)
                if row[3] not in texts:
                    texts[row[3]] = text.as_py() or ""
                    size += len(texts[row[3]])
        if groups:
            yield flush()

    return over


def similar(members: DataFrame, texts: DataFrame, k: int, ordered: bool, least: float, known: DataFrame | None = None, once: bool = False) -> DataFrame:
    """(node, root) of all nodes that have a link of similarity `least` or more to another node.

    members: (node, key, n), n the number of shingles; texts: (node, text). known: links that
    are already certain, (u, v). A link is looked for between any two nodes that share a key.
    once: no node has a key twice, so keys with the same nodes can be told, and count once.
    """
    far = 1 - least
    led = _buckets(members) if once else with_leader(members, ["key"]).select("key", "node", "leader")
    led = materialise(led, "buckets")
    pairs = led.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    pairs = materialise(pairs, "candidates")
    ids = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    ids = materialise(ids, "ids")
    part = materialise(rows_of(texts.select("node", "text"), ids), "texts")
    with_u = pairs.join(part.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    both = with_u.join(part.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    # Distances are exact up to twice a link's and clamped there, Jaccard distances exact throughout.
    met = materialise(_compared(both, k, ordered, min(1.0, 2 * far)), "distances")
    links = met.where(F.col("d") <= far + 1e-12).select("u", "v")
    if known is not None:
        links = links.union(known.select("u", "v"))
    roots = components(links)
    # What remains: members that are not connected to their bucket's leader.
    label = roots.select("node", F.col("root").alias("comp"))
    seen = led.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    seen = seen.join(label.select(F.col("node").alias("leader"), F.col("comp").alias("_lc")), "leader", "left").withColumn("_lc", F.coalesce("_lc", "leader"))
    seen = seen.join(met.select(F.col("u").alias("node"), F.col("v").alias("leader"), "d", "j"), ["node", "leader"], "left").withColumn("d", F.coalesce("d", F.lit(0.0))).withColumn("j", F.coalesce("j", F.lit(0.0)))
    seen = materialise(seen.withColumn("open", F.col("comp") != F.col("_lc")).select("key", "node", "leader", "comp", "d", "j", "open"), "seen")
    rest = seen.groupBy("key").agg(F.count_if("open").alias("_open"), F.min(F.when(F.col("open"), F.col("d"))).alias("_least"), F.min(F.when(F.col("open"), F.col("j"))).alias("_least_j")).where("_open > 0")
    left = seen.where("node <> leader").join(rest, "key").where(F.col("open") | ((F.col("d") >= F.col("_least") - far - 1e-9) & (F.col("j") >= F.col("_least_j") - far - 1e-9)))
    left = materialise(left.select("key", "node", "comp", "d", "j", "open"), "left")
    # An open member far from all others' leader and alone in its bucket has nothing to meet.
    drop(led, pairs, ids, seen)
    # And members of one component are connected already.
    size = left.groupBy("key").agg(F.count("*").alias("_m"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("key", "_m").withColumn("_nb", F.ceil(F.col("_m") / BLOCK).cast("int"))
    if size.isEmpty():
        drop(part, left, met)
        return roots
    dealt = left.join(size, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_o")
    dealt = dealt.select("key", "node", "comp", "d", "j", "open", "block", other).select("*", F.least("block", "_o").alias("b1"), F.greatest("block", "_o").alias("b2"))
    with_text = dealt.join(part, "node")
    with_text = with_text.select("key", "b1", "b2", "node", "comp", "d", "j", "open", "block", "text").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    more = with_text.mapInArrow(handed_back(_exhaustive(k, ordered, least)), "u bigint, v bigint")
    more = materialise(more, "more-links")
    drop(part, left)
    if more.isEmpty():
        return roots
    # The new links are of components by their least nodes, or of nodes that had no link: these are joined to larger ones.
    joined = materialise(components(more), "joined")
    whole = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_joined")), "root", "left").select("node", F.coalesce("_joined", "root").alias("root"))
    return whole.union(joined.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def key_of(parts: np.ndarray) -> np.ndarray:
    """uint64 hashes as signed 64-bit numbers for Spark."""
    return parts.view(np.int64)
