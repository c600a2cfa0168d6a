"""Small cases with known results, one or more an operator id."""

import pytest
from pyspark.sql import functions as F

from slidespark.functions import scalars as S
from slidespark.operators import expression as E
from slidespark.operators import gates as J
from slidespark.operators import grid as B
from slidespark.operators import identity as H
from slidespark.operators import ranking as R
from slidespark.operators import spatial as D
from slidespark.sources import records as A


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_c1_bins_relative_to_origin(spark):
    r = spark.createDataFrame([(60, 60, 2, 200), (61, 61, 2, 200), (63, 60, 0, 5)], "x long, y long, gene_id long, cnt long")
    got = E.bin_expression(B.to_bin(r, 3, 60, 60))
    assert rows(got, "bx", "by_", "gene_id", "cnt") == [(0, 0, 2, 400), (1, 0, 0, 5)]


def test_b11_direction_classes(spark):
    v = spark.createDataFrame([(0, 1), (1, 0), (0, -1), (-1, 0), (0, 0)], "dx long, dy long")
    got = [r[0] for r in v.select(S.direction_class(F.col("dx"), F.col("dy"))).collect()]
    assert got == [0, 4, 8, 12, 0]
    one = spark.range(1).select(S.one_hot(F.lit(3), F.lit(False)).alias("b"), S.one_hot(F.lit(3), F.lit(True)).alias("f")).first()
    assert sum(one.b) == 0 and one.f.index(1) == 3


def test_b5_interior_is_half_open(spark):
    p = spark.createDataFrame([(149, 200), (150, 150), (1169, 1169), (1170, 200), (59, 100)], "x long, y long")
    got = [r[0] for r in p.select(B.interior(F.col("x"), F.col("y"), F.lit(1200), F.lit(1200), 60, 90)).collect()]
    assert got == [False, True, True, False, False]


def test_b10_holdout_limit_is_strict(spark):
    s = spark.createDataFrame([(990, 1000, 1), (991, 1000, 1), (991, 1000, 0)], "x long, y long, foreground long")
    assert [r.split for r in B.spatial_holdout(s, 1320, 1320).collect()] == ["train", "validation", "dropped"]


def test_c12_pooling(spark):
    e = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 2, 3), (1, 0, 1, 5)], "bx long, by_ long, gene_id long, cnt long")
    v = spark.createDataFrame([(0, [1.0, 2.0]), (2, [3.0, 4.0])], "gene_id long, embedding array<float>")
    assert rows(E.pool_embeddings(e, v), "bx", "dim", "value", "nnz") == [(0, 0, 5.5, 2), (0, 1, 8.0, 2)]


def test_d5_lookup_and_strict(spark):
    g = spark.createDataFrame([(0, "A"), (1, "X"), (2, "A"), (3, "B")], "gene_id long, symbol string")
    k = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert [r[2] for r in rows(D.gene_lookup(g, k))] == [0, -1, 0, 1]
    with pytest.raises(ValueError, match="X"):
        D.gene_lookup(g, k, strict=True)


def test_e1_split_sizes(spark):
    s = spark.range(101).select(F.lit(1).alias("tile"), F.col("id").alias("k"))
    a, b = (R.split_points(s.orderBy(F.rand(i)), ["tile"], ["k"], 0.1, 3) for i in (1, 2))
    assert a.filter("split = 'validation'").count() == 10 and a.count() == 101
    assert rows(a, "k", "split") == rows(b, "k", "split")


def test_e5_cap_and_e7_batches(spark):
    s = spark.range(200).select((F.col("id") % 2).alias("tile"), F.col("id").alias("k"), (F.floor(F.col("id") / 2) % 2).alias("foreground"))
    got = R.epoch_sample(s, ["tile"], ["k"], 19, 1, 0)
    assert got.count() == 76
    batches = R.plan_batches(got, ["tile"], ["k"], 7, 1).groupBy("batch").count()
    assert batches.count() == 12
    t = spark.createDataFrame([(0, i) for i in range(3)] + [(1, i) for i in range(5)], "tile long, k long")
    assert sorted(r["count"] for r in R.plan_batches(t, ["tile"], ["k"], 4, 1, merge=True).groupBy("batch").count().collect()) == [4, 4]


def test_e4_against_the_loop(spark):
    import random

    rnd = random.Random(5)
    fg = [rnd.randrange(2) for _ in range(400)]
    keep, seen, kept = [], 0, 0
    for i, f in enumerate(fg):
        if f:
            seen += 1
            keep.append(i)
        elif kept < seen:
            kept += 1
            keep.append(i)
    s = spark.createDataFrame([(0, i, f) for i, f in enumerate(fg)], "tile long, k long, foreground long")
    assert [r[0] for r in rows(R.cap_background(s, ["tile"], ["k"]), "k")] == keep


def test_d2_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    occ = {(x, y) for x in range(13) for y in range(16) if rnd.random() < 0.75}
    order = D.ring_offsets(10)
    assert order[:4] == [(0, 0), (-1, -1), (-1, 0), (-1, 1)] and len(set(order)) == 441
    want = []
    for x, y in occ:
        n = [(x + a, y + b) for a, b in order if (x + a, y + b) in occ][:50]
        want += [(x, y, i, *p) for i, p in enumerate(n)] if len(n) == 50 else []
    got = D.ring_neighbors(spark.createDataFrame(list(occ), "bx long, by_ long"))
    assert rows(got, "bx", "by_", "rank", "nx", "ny") == sorted(want)
    with pytest.raises(ValueError):
        D.ring_neighbors(got, 442)


def test_d9_block_match(spark):
    p = spark.range(18 * 15).select(F.lit(2).alias("s"), F.lit(8).alias("t"))
    assert rows(D.overlap_matches(p)) == [(2, 8, 270, 1.0)]


def test_h1_refuses_two_labels_of_a_tile(spark):
    e = spark.createDataFrame([(0, "a", 1, "b", 2), (1, "b", 2, "c", 3), (2, "c", 3, "a", 4)], "ordinal long, tile_a string, label_a long, tile_b string, label_b long")
    n = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "tile string, label long")
    assert rows(H.reconcile_labels(e, n)) == [("a", 1, "a", 1), ("a", 4, "a", 4), ("b", 2, "a", 1), ("c", 3, "a", 1)]


def test_a6_common_input_and_errors(spark):
    r = spark.createDataFrame([(2, 1, 2, 999), (0, 2, 0, 200), (0, 2, 0, 100), (1, 0, 1, 1)], "x long, y long, gene_id long, cnt long")
    g = spark.createDataFrame([(0,), (1,), (2,)], "gene_id long")
    spots, counts = A.build_common_input(r, g, 3, 3)
    assert rows(spots, "spot", "x", "y") == [(0, 0, 2), (1, 1, 0), (2, 2, 1)]
    assert rows(counts) == [(0, 0, 300), (1, 1, 1), (2, 2, 999)]
    with pytest.raises(ValueError, match="gene"):
        A.build_common_input(r, g.filter("gene_id < 2"), 3, 3)
    with pytest.raises(ValueError, match="outside"):
        A.build_common_input(r, g, 2, 3)


def test_c11_constant_row_is_undefined(spark):
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "cell long, gene_id long, cnt long")
    assert E.row_pearson(a, a, 2).first().r is None


def test_a1_reader(spark, tmp_path):
    p = tmp_path / "r.tsv"
    p.write_text("# note\ngeneID\trow\tcol\tMIDCounts\nA\t1\t2\t3\n")
    assert rows(A.read_records(spark, str(p))) == [("A", 1, 2, 3)]
    p.write_text("geneID\trow\tcol\nA\t1\t2\n")
    with pytest.raises(ValueError, match="cnt"):
        A.read_records(spark, str(p))


def test_j1_and_j3_raise(spark):
    a = spark.createDataFrame([(1, 2)], "k long, cnt long")
    J.assert_conserved(a, a)
    with pytest.raises(ValueError):
        J.assert_conserved(a, a.union(a))
    with pytest.raises(ValueError):
        J.require_unique(a.union(a), ["k"])


def test_a4_and_a14_sinks(spark, tmp_path):
    r = spark.createDataFrame([(0, 0, 1, 5), (1300, 0, 1, 7)], "x long, y long, gene_id long, cnt long")
    assert rows(A.write_spatial_index(r, str(tmp_path / "i"))) == [(0, 0, 1, 5), (1, 0, 1, 7)]
    A.publish(r, str(tmp_path / "p"), str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exists"):
        A.publish(r, str(tmp_path / "p"), str(tmp_path / "m2"))
