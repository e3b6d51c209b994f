"""The trie of conversation prefixes against nested counting in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import prefix_trie as P

KINDS = "conv_id long, turn long, role string, text string, depth string, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            n = nodes.setdefault(path[:d], {"m": [], "ends": []})
            n["m"].append(c)
            if d == len(path):
                n["ends"].append(c)
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, n in nodes.items():
        w = (len(n["m"]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += w
    return sorted(
        (min(n["m"]), len(p), min(nodes[p[:-1]]["m"]) if p else None, len(n["m"]), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()) for p, n in nodes.items()
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], KINDS)
    out = P.prefix_trie(df.repartition(7)).collect()
    # Preorder: a permutation; each subtree is as long as it has nodes, and holds its own.
    assert sorted(r.preorder for r in out) == list(range(len(out)))
    by_place = sorted(out, key=lambda r: r.preorder)
    stack = []
    for r in by_place:
        while stack and stack[-1].subtree_end <= r.preorder:
            stack.pop()
        assert r.subtree_end > r.preorder and (not stack or r.subtree_end <= stack[-1].subtree_end)
        assert r.depth == len(stack) and (not stack or stack[-1].conv_id == r.parent_conv_id)
        stack.append(r)
    return sorted(tuple(r[c] for c in COLUMNS) for r in out)


def test_random_conversations(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "é漢"])) for c in range(-30, 90) for t in range(r.randrange(12))]
    rows = [x for x in rows if x[0] % 7]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    r = random.Random(4)
    lo, hi = -(1 << 63), (1 << 63) - 1
    rows = [(None, 1, "user", "x"), (lo, 0, "u", "a"), (hi, 0, None, "a"), (hi, None, "u", None), (hi, 2, "", ""), (hi, 2, "", ""), (3, None, "u", "t"), (3, None, "u", "s"), (3, 5, "u" * 3000, "long " * 20000)]
    rows += [(10, t, "u", "same") for t in range(40)] + [(c, t, "u", "same") for c in range(11, 30) for t in range(40)]
    rows += [(0, 1, "u", "1:u"), (0, 1, "u", "1:u"), (1, 1, "u1", ":u"), (2, 1, "u", "x")]
    rows += [r.choice(rows) for _ in range(20)]
    assert found(spark, rows) == brute(rows)


def test_conversation_over_many_partitions(spark):
    """One conversation has most of the rows, and its copy shares all but the last; no task gets a whole one."""
    r = random.Random(5)
    texts = [r.choice("abc") for _ in range(300)]
    rows = [(c, t, "u", x) for c in (5, 10, 25) for t, x in enumerate(texts[: 300 - c])] + [(c, t, "u", r.choice("ab")) for c in range(100, 140) for t in range(4)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, (parts,) = P.prefixes(spark.createDataFrame([(*x, "", "") for x in rows], KINDS))
        assert parts.where("conv_id = 5").select("pid").distinct().count() > 1
        assert turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.countDistinct("pos").alias("k")).where("n <> k").count() == 0
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")], [(7, 1, "u", "x")]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == brute(rows)
