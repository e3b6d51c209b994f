"""What several of the text operators share: scratch tables, tasks that hand their memory back, and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges of a graph that are contracted together in a task.
CONTRACTED = 1 << 18


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only a local session, where driver and executors are one process, may do without the
    setting; it gets a folder under /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/quern-scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"


#: Setting under which Spark removes the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A join whose shuffled side is that small in every partition may hash it, which saves sorting both sides.
HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def materialise(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back.

    The committed files cut the lineage: what reads them needs no shuffle file of a lost
    executor and is not computed twice. So the write's own shuffle files can go when it has ended.
    hashes: most columns are hashes and numbers of rows, for which a dictionary is built in
    vain and close packing too; small sides of shuffled joins are hashed.
    """
    spark, settings = df.sparkSession, {CLEANUP: "true"} | ({HASHED: "16m"} if hashes else {})
    path, before = scratch_path(spark, label), {k: spark.conf.get(k) for k in settings}
    out = df.write.option("compression", "zstd")
    if hashes:
        out = out.option("parquet.enable.dictionary", "false").option("parquet.compression.codec.zstd.level", "1")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    read = spark.read.schema(df.schema).parquet(path)
    read.scratch = path
    return read


def materialise_hashes(df: DataFrame, label: str) -> DataFrame:
    """`materialise` for tables of hashes and numbers of rows."""
    return materialise(df, label, hashes=True)


def drop(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def hand_back() -> None:
    """Returns what this process has freed to the system, as far as its allocators keep it for later."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def handed_back(over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """over, a function of a task's Arrow batches, that hands its memory back when the task ends.

    A Python worker lives on after its task, within the same memory as its executor: what it
    keeps is missing where the next stages need it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from over(batches)
        finally:
            hand_back()

    return run


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), b < a: stars that connect what the edges connect, each of a part of CONTRACTED edges at most."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while (y := above.get(x)) is not None:
            path.append(x)
            x = y
        for y in path:
            above[y] = x
        return x

    def stars() -> pa.RecordBatch:
        nodes = list(above)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])

    met = 0
    for batch in batches:
        for k in range(0, batch.num_rows, CONTRACTED):
            part = batch.slice(k, CONTRACTED)
            if met + part.num_rows > CONTRACTED:
                yield stars()
                above.clear()
                met = 0
            met += part.num_rows
            for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
    yield stars()


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph: edges contracted by task, then alternating stars.

    Returns (node, root) for every node of an edge, root being the least node of its
    component. Edges with a null end are ignored, loops and repeats are harmless. First each
    task replaces parts of its edges by their stars, and these once more, dealt to tasks of
    about CONTRACTED edges. What several parts have in common is left to rounds: each
    is two shuffled joins of the edges with the least neighbour of a node; minima combine
    before their shuffle, and both join inputs are plain exchanges, so AQE can split a hot
    node. It ends when every node that has a lesser neighbour has no other one. Nothing but
    one row a round reaches the driver.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
    first = materialise_hashes(now.mapInArrow(handed_back(_contracted), "a long, b long"), "edges")
    parts = max(1, -(-first.count() // CONTRACTED))
    now = materialise_hashes(first.coalesce(parts).mapInArrow(handed_back(_contracted), "a long, b long"), "edges")
    drop(first)
    for k in range(rounds):
        # Large star: every neighbour above a node is linked to the least of its neighbourhood.
        both = now.union(now.select("b", "a"))
        ends = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("_most"))
        least = materialise_hashes(ends.select(F.col("a").alias("n"), F.least("a", "m").alias("m"), ((F.col("m") < F.col("a")) & (F.col("m") < F.col("_most"))).alias("moves")), "large")
        if least.where("moves").isEmpty():
            drop(now)
            return least.select(F.col("n").alias("node"), F.col("m").alias("root"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = (now, least), materialise_hashes(large, "edges")
        drop(*old)
        # Small star: a node and its lesser neighbours are linked to the least of them.
        least = materialise_hashes(now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "small")
        small = now.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        # Neither star makes more edges than it reads. Most repeats come of the first round.
        old, now = (now, least), materialise_hashes(small if k else small.distinct(), "edges")
        drop(*old)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
