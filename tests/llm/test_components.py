"""Components by contraction and stars, against a plain union of sets."""

import random

from quern.llm import common
from quern.llm.common import components


def _plain(edges):
    above = {}

    def find(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            u, v = find(u), find(v)
            above[max(u, v)] = min(u, v)
    nodes = {x for u, v in edges if u is not None and v is not None and u != v for x in (u, v)}
    return sorted((x, find(x)) for x in nodes)


def _edges():
    # A chain in no order, a hub, random links with repeats both ways, a loop and ends without a node.
    mixed = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1080)]
    mixed.shuffle(chain)
    links = [(mixed.randrange(-60, 60), mixed.randrange(-60, 60)) for _ in range(70)]
    return chain + [(5000 + i, 7000) for i in range(50)] + links + [(v, u) for u, v in links[:20]] + [(3, 3), (None, 4), (5, None), (2**63 - 1, -(2**63))]


def _found(spark, edges):
    return sorted(map(tuple, components(spark.createDataFrame(edges, "u long, v long").repartition(4)).select("node", "root").collect()))


def test_components_that_fit_a_part_need_no_round(spark, monkeypatch):
    written = []
    plain = common.materialise_hashes
    monkeypatch.setattr(common, "materialise_hashes", lambda df, label: written.append(label) or plain(df, label))
    assert _found(spark, _edges()) == _plain(_edges())
    # Before, the chain took rounds of four tables each.
    assert written == ["edges", "edges", "large"]


def test_components_of_many_parts(spark):
    # Nothing is contracted further than what a part of few edges connects, and rounds join the parts.
    edges = _edges()

    def few(batches):
        from quern.llm import common

        common.CONTRACTED, before = 7, common.CONTRACTED
        try:
            yield from plain(batches)
        finally:
            common.CONTRACTED = before

    plain, bound = common._contracted, common.CONTRACTED
    common._contracted, common.CONTRACTED = few, 7
    try:
        assert _found(spark, edges) == _plain(edges)
    finally:
        common._contracted, common.CONTRACTED = plain, bound


def test_components_of_no_edges(spark):
    assert _found(spark, [(1, 1), (None, 2)]) == []


def test_writing_leaves_the_settings_as_they_were(spark):
    keys = (common.CLEANUP, common.HASHED)
    before = [spark.conf.get(k) for k in keys]
    common.drop(common.materialise_hashes(spark.range(3), "settings"))
    assert [spark.conf.get(k) for k in keys] == before
