"""H1 against the sequential union, with every component contracted, and with those at hand replayed."""

import random

import pytest

from slidespark.operators import identity as H


def sequential(edges):
    parent, tiles = {}, {}
    for t in {(e[i], e[i + 1]) for e in edges for i in (1, 3)}:
        parent[t], tiles[t] = t, {t[0]}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for _, ta, la, tb, lb in sorted(edges):
        a, b = sorted((find((ta, la)), find((tb, lb))))
        if a != b and not tiles[a] & tiles[b]:
            parent[b] = a
            tiles[a] |= tiles[b]
    return {k: find(k) for k in parent}


SCHEMA = "ordinal long, tile_a long, label_a long, tile_b long, label_b long"


def reconciled(spark, edges, replay):
    e = spark.createDataFrame(edges, SCHEMA).repartition(4)
    n = e.selectExpr("tile_a AS tile", "label_a AS label").union(e.selectExpr("tile_b", "label_b"))
    return {(r.tile, r.label): (r.root_tile, r.root_label) for r in H.reconcile_labels(e, n, replay).collect()}


@pytest.mark.parametrize("replay, lists", [(0, 60), (10_000, 1000)])
def test_random_edge_lists(spark, replay, lists):
    """Many lists at once: each has tiles of its own, so that they are components of their own."""
    rnd = random.Random(replay)
    edges = []
    for case in range(lists):
        size = rnd.randrange(2, 9)
        for _ in range(rnd.randrange(1, 14)):
            a, b = rnd.sample(range(size), 2)
            edges.append((case * 10 + a % 10, 1 + rnd.randrange(2), case * 10 + b, 1 + rnd.randrange(2)))
    order = list(range(len(edges)))
    rnd.shuffle(order)
    edges = [(o, *e) for o, e in zip(order, edges, strict=True)]
    assert reconciled(spark, edges, replay) == sequential(edges)


def test_long_chain_with_one_clash(spark):
    """3,000 labels in a row, in order; the last one lies in the first one's tile."""
    n = 3000
    e = spark.range(n - 1).selectExpr("id AS ordinal", "id AS tile_a", "1L AS label_a", f"CASE WHEN id = {n - 2} THEN 0L ELSE id + 1 END AS tile_b", f"CASE WHEN id = {n - 2} THEN 2L ELSE 1L END AS label_b")
    nodes = e.selectExpr("tile_a AS tile", "label_a AS label").union(e.selectExpr("tile_b", "label_b")).distinct()
    got = H.reconcile_labels(e, nodes, replay=100)
    assert {(r.root_tile, r.root_label, r["n"]) for r in got.groupBy("root_tile", "root_label").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {(0, 1, n - 1), (0, 2, 1)}
