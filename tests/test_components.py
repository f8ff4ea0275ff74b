import random

import pytest

from topicloom.operators import components as cc


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def run(spark, edges):
    df = spark.createDataFrame(edges, "src int, dst int")
    return {r["node"]: r["component"] for r in cc.connected_components(df).collect()}


@pytest.mark.parametrize("hub_share", [cc.HUB_SHARE, 0.2])
def test_components(spark, monkeypatch, hub_share):
    monkeypatch.setattr(cc, "HUB_SHARE", hub_share)
    path = [(9, 3), (3, 7), (7, 1), (1, 8), (8, 2), (2, 6), (6, 5), (5, 4)]
    star = [(100, i) for i in range(101, 130)]
    rng = random.Random(3)
    noise = [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(30)]
    edges = path + star + noise + [(300, 300)]
    assert run(spark, edges) == union_find(edges)
