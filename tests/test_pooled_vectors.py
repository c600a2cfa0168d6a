"""Pooled vectors of whole spots are gathered from rows of many dimensions, not from a row a dimension."""

from pyspark.sql import functions as F

from slidespark.operators import expression as E
from slidespark.plans.fixtures import Fixtures
from slidespark.plans.more_queries import features, mapped

SF = "/root/testdata/sf0.001"


def test_features_make_no_row_a_dimension(spark):
    plan = features(Fixtures(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower(), plan


def test_pooled_vectors_are_the_pooled_dimensions_in_order(spark):
    m, v = mapped(Fixtures(spark, SF))
    by_dim = E.pool_embeddings(m, v).groupBy("bx", "by_").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda d: d["value"]).alias("f"))
    want = {tuple(r[:2]): r[2] for r in by_dim.collect()}
    got = {(r.bx, r.by_): r.features for r in E.pool_vectors(m, v).collect()}
    assert want and got == want


def test_vectors_of_unequal_and_missing_length(spark):
    vectors = spark.createDataFrame([(1, [float(i) for i in range(70)]), (2, [1.0, 2.0]), (3, []), (4, None)], "gene_id long, embedding array<float>")
    expr = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 2, 3), (0, 2, 3, 1), (0, 3, 4, 1), (0, 4, 9, 1)], "bx long, by_ long, gene_id long, cnt long")
    got = {r.by_: r.features for r in E.pool_vectors(expr, vectors).collect()}
    assert got == {0: [2.0 * i for i in range(70)], 1: [3.0, 6.0]}
