"""Tokens and centres looked up within tiles equal those of the neighbourhoods as a table."""

import numpy as np
from pyspark.sql import functions as F

from slidespark.operators import spatial as D


def counts(spark):
    r = np.random.default_rng(5)
    at = {(int(x), int(y)) for x, y in zip(r.integers(110, 150, 900), r.integers(-20, 20, 900), strict=True)}  # four tiles meet here
    rows = [(x, y, f"g{g}" if g else None, int(r.integers(-1, 9))) for x, y in sorted(at) for g in r.integers(0, 9, 4)]  # genes repeat in a bin
    return spark.createDataFrame(rows, "bx long, by_ long, gene_id string, cnt long")


def rows(df):
    return sorted(map(tuple, df.select("bx", "by_", "rank", "gene_id", "cnt").collect()))


def test_tokens_across_tiles(spark):
    x = counts(spark)
    merged = x.filter("gene_id is not null").groupBy("bx", "by_", "gene_id").agg(F.sum("cnt").cast("long").alias("cnt"))
    near = D.ring_neighbors(x.select("bx", "by_").distinct())
    want = D.gather_tokens(near, merged)
    got = D.ring_tokens(x)
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert len(rows(want)) > 50_000 and rows(got) == rows(want)
    own = F.col("bx") % 3 == 0
    assert rows(D.ring_tokens(x, own=own)) == rows(want.filter(own))
    pick = lambda d: sorted(map(tuple, d.collect()))
    bins = x.select("bx", "by_").distinct()
    for keep in (None, own):
        full = near if keep is None else near.filter(keep)
        assert pick(D.ring_neighbors(bins, own=keep)) == pick(full)
        assert pick(D.ring_centres(bins, own=keep)) == pick(full.filter("rank = 0").select("bx", "by_"))


def test_tokens_of_no_gene_and_of_no_row(spark):
    x = counts(spark)
    assert D.ring_tokens(x.withColumn("gene_id", F.lit(None).cast("string"))).count() == 0
    assert D.ring_tokens(x.limit(0)).count() == 0 and D.ring_centres(x.limit(0)).count() == 0


def test_preparation_shuffles_no_neighbourhoods(spark):
    from slidespark.plans.registry import QUERIES
    import slidespark.plans.more_queries  # noqa: F401

    plan = QUERIES["p1_prepare_slide"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " nx#" not in plan
