"""Neighbourhood statistics taken within tiles equal those of the gathered neighbourhoods."""

import inspect

import numpy as np

from slidespark.operators import expression as E
from slidespark.operators import spatial as D


def test_ring_stats_across_tiles(spark):
    r = np.random.default_rng(5)
    at = {(int(x), int(y)) for x, y in zip(r.integers(110, 150, 900), r.integers(-20, 20, 900), strict=True)}  # four tiles meet here
    rows = [(x, y, int(g), int(r.integers(1, 9))) for x, y in at for g in r.choice(10**12, 3, replace=False) % 40 for g in [g]]
    expr = spark.createDataFrame(rows, "bx long, by_ long, gene_id long, cnt long").groupBy("bx", "by_", "gene_id").sum("cnt").withColumnRenamed("sum(cnt)", "cnt")
    want = E.neighborhood_stats(D.gather_tokens(D.ring_neighbors(expr.select("bx", "by_").distinct()), expr))
    got = D.ring_stats(expr)
    assert got.columns == want.columns
    got, want = (sorted(map(tuple, d.collect())) for d in (got, want))
    assert len(want) > 300 and got == want


def test_ring_stats_shuffles_no_neighbourhoods(spark):
    from slidespark.plans.registry import QUERIES

    plan = QUERIES["c28_neighborhood_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " rank#" not in plan and plan.count("Join ") == 1  # the one that makes the records


def test_tasks_need_no_function_of_this_library():
    """A function of a module travels by name, and executors do not have the library."""
    used = inspect.getclosurevars(D._rings(50, 10)[2]).globals.values()
    assert not [v for v in used if inspect.isfunction(v)]
