"""Operators without SQL against plain Python, and literal cases of the others."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidespark.operators import evaluate, gates, grid, hooks, slide, spatial
from slidespark.plans import pipelines
from slidespark.sources import records


@pytest.mark.parametrize("seed", range(3))
def test_instance_iou_equals_all_assignments(spark, seed):
    rnd = random.Random(seed)
    pixels = [(rnd.randrange(4), rnd.randrange(5)) for _ in range(60)] + [(10, 0), (0, 11)]
    got = {r.gt: r.iou for r in evaluate.instance_iou(spark.createDataFrame(pixels, "gt long, predicted long")).collect()}
    gt, pred = sorted({g for g, _ in pixels} - {0}), sorted({p for _, p in pixels} - {0})

    def iou(g, p):
        n = pixels.count((g, p))
        return n / (sum(a == g for a, _ in pixels) + sum(b == p for _, b in pixels) - n)

    best = max(sum(iou(g, p) for g, p in zip(gt, perm, strict=True) if p) for perm in itertools.permutations([*pred, *[0] * len(gt)], len(gt)))
    assert set(got) == set(gt) and abs(sum(got.values()) - best) < 1e-9


def test_instance_iou_literal(spark):
    """Perfect 1.0; all missed 0.0; two cells merged into one: mean 0.25, recall 0.5."""
    run = lambda rows: evaluate.instance_summary(evaluate.instance_iou(spark.createDataFrame(rows, "gt long, predicted long"))).first()
    assert run([(1, 5), (1, 5), (2, 6)]).mean_iou == 1.0
    assert run([(1, 0), (2, 0)]).mean_iou == 0.0
    merged = run([(1, 9), (1, 9), (2, 9), (2, 9)])
    assert merged.mean_iou == 0.25 and merged.recall50 == 0.5
    assert evaluate.instance_iou(spark.createDataFrame([(1, 5), (0, 5)], "gt long, predicted long"), ignore=F.col("gt") == 0).first().iou == 1.0


def test_paired_consistency_literal(spark):
    """One nucleus; the own regions of the two cells correlate 1 and -1 with the shared one."""
    rec = [(0, 0, 0, 300), (0, 1, 0, 300), (0, 2, 1, 300), (0, 0, 1, 0)]
    lab = [(0, 0, 1, 7, 8), (0, 1, 0, 7, 0), (0, 2, 0, 0, 8)]
    x = evaluate.paired_consistency(spark.createDataFrame(rec, "x long, y long, gene_id long, cnt long"), spark.createDataFrame(lab, "x long, y long, nucleus_id long, a long, b long"), "a", "b", 2, spark.createDataFrame([(1,)], "gene_id long"))
    r = x.first()
    assert (r.cell_a, r.cell_b, r.umis_a + r.umis_b) == (7, 8, 600) and abs(r.correlation_a - 1) < 1e-12 and abs(r.correlation_b + 1) < 1e-12
    assert r.rest_correlation_a == r.rest_correlation_b == 0.0
    assert evaluate.consistency_summary(x).first().difference == pytest.approx(2)


def test_point_counts_literal(spark):
    """Two tiles with 20 foreground and 3 background centres in all, cap 5: 8 planned samples, 8 centres with halo but 4 in cores."""
    tiles = spark.createDataFrame([("a", "train", 1), ("b", "train", 1)], "id string, split string, records long")
    status = spark.createDataFrame([("a", "prepared"), ("b", "prepared")], "id string, state string")
    s = [("a", 1, True, True)] * 20 + [("a", 0, True, False)] * 3
    r = slide.point_counts(tiles, status, spark.createDataFrame(s, "id string, foreground int, eligible boolean, in_core boolean"), 5, whole=False).first()
    assert r.train_planned == 8 and r.train_foreground == 20 and r.scope == "specified tiles only (partial slide)"
    r = slide.point_counts(tiles, status.limit(1), spark.createDataFrame(s[:8], "id string, foreground int, eligible boolean, in_core boolean"), 5).first()
    assert r.pending_tiles == 1 and r.scope == "prepared tiles only; incomplete"


def test_slide_matrix_counts_core_records_once(spark):
    rec = [(5, 5, 0, 3), (9, 5, 1, 4), (11, 5, 1, 5), (30, 5, 0, 7)]
    r = spark.createDataFrame(rec, "x long, y long, gene_id long, cnt long")
    lab = spark.createDataFrame([(5, 5, 1), (9, 5, 1), (11, 5, 2)], "x long, y long, cell long")
    m = slide.slide_cell_matrix(spatial.halo_records(r, 10, 3, F.lit(4), F.lit(1)), lab, 10, r)
    assert {(c.cell, c.gene_id): c.cnt for c in m.counts.collect()} == {(1, 0): 3, (1, 1): 4, (2, 1): 5}
    assert tuple(m.totals.first()) == (4, 19, 12, 4, 3)
    with pytest.raises(ValueError):
        slide.slide_cell_matrix(spatial.halo_records(r, 10, 3, F.lit(4), F.lit(1)).filter("gene_id = 0"), lab, 10, r)


def test_restricted_genes_keep_empty_spots(spark):
    s = spark.createDataFrame([(1, [(3, 2), (5, 1)]), (2, [(4, 9)])], "spot long, genes array<struct<gene_id: long, cnt: long>>")
    got = {r.spot: [tuple(g) for g in r.genes] for r in grid.restrict_genes(s, [5, 3], 10).collect()}
    assert got == {1: [(1, 2), (0, 1)], 2: []} and grid.coverage(grid.restrict_genes(s, [5, 3], 10)).first().empty == 1
    for bad in ([], [1, 1], [10], [-1]):
        with pytest.raises(ValueError):
            grid.restrict_genes(s, bad, 10)


def test_fingerprint_gate(spark):
    parts = spark.createDataFrame([("a", "f"), ("b", "g")], "id string, fingerprint string")
    gates.require_fingerprint(parts.filter("id = 'a'"), "f")
    with pytest.raises(ValueError):
        gates.require_fingerprint(parts, "f")


def test_publish_is_atomic(spark, tmp_path):
    path = f"{tmp_path}/table"
    broken = spark.range(3).withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.lit("x")))
    with pytest.raises(Exception):  # noqa: B017
        records.publish(broken, path, f"{tmp_path}/done")
    records.publish(spark.range(3), path, f"{tmp_path}/done")  # the failed write does not stand in the way
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(FileExistsError):
        records.publish(spark.range(3), path, f"{tmp_path}/done2")


def test_baseline_equals_numpy_and_learns(spark):
    rnd = np.random.default_rng(1)
    f = rnd.normal(size=(400, 3))
    fg = (f[:, 0] > 0).astype(int)
    d = np.where(f[:, 1] > 0, 3, 9)
    df = spark.createDataFrame([(int(i), 0, [float(v) for v in f[i]], int(fg[i]), int(d[i])) for i in range(400)], "x long, y long, features array<double>, foreground int, direction int").repartition(3)
    model = hooks.fit_baseline(df, steps=20)
    w = np.zeros((2, 4))
    m = np.c_[np.ones(400), f]
    for _ in range(20):
        z = m @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(400), fg] -= 1
        w -= p.T @ m / 400 + 1e-3 * w
    assert np.allclose(w, model["foreground"], atol=1e-8)
    got = hooks.score(df, hooks.baseline_predictor(model)).toPandas().sort_values("x")
    assert ((got.p > 0.5).to_numpy() == fg.astype(bool)).mean() > 0.95
    assert (np.array([np.argmax(v) for v in got.logits])[fg == 1] == d[fg == 1]).mean() > 0.9


def test_score_refuses_what_is_not_finite(spark):
    bad = lambda: lambda f: (np.full(len(f), np.nan), np.zeros((len(f), 16)))
    with pytest.raises(Exception, match="finite"):
        hooks.score(spark.createDataFrame([(1, 2)], "x long, y long"), bad).collect()


def test_gene_table_and_schema(spark):
    ann = spark.createDataFrame([(1, "abc", "name a", None, ["ALT"]), (2, "Eo", None, None, [])], "gene_id long, symbol string, name string, designations string, synonyms array<string>")
    s = spark.createDataFrame([(1, 1, "aeio")], "line long, gene_id long, summary string")
    count = lambda: lambda texts: np.array([[t.count("a"), t.count("o")] for t in texts], float)
    got = {r.symbol: r.embedding for r in pipelines.gene_table(ann, s, count, normalize=False).collect()}
    assert set(got) == {"ABC", "EO", "ALT"} and got["ALT"] == got["ABC"]
    slide = spark.createDataFrame([(5, "alt"), (6, "none"), (7, "eo")], "gene_id long, symbol string")
    both = pipelines.gene_vectors(ann, s, count, slide, normalize=False)
    assert {r.symbol: r.embedding for r in both.vectors.collect()} == got
    assert {r.gene_id: r.embedding_id for r in both.lookup.collect()} == {5: 0, 6: -1, 7: 1}
    with pytest.raises(ValueError, match="NONE"):
        pipelines.gene_vectors(ann, s, count, slide, strict=True)
    rec = [(x, y, x // 3, y // 3, (x * y) % 7, 1 + (x + y) % 3) for x in range(0, 200, 2) for y in range(0, 200, 3)]
    r = spark.createDataFrame(rec, "x long, y long, bx long, by_ long, gene_id long, cnt long")
    a, b = (pipelines.init_schema(r, 200, 200, 100, 0, per_tile=50, top=5, fraction=0.25, seed=k, least=1) for k in (1, 1))
    assert a.fingerprint.first() == b.fingerprint.first() and 0 < a.genes.count() <= 5
    assert {t.split for t in a.tiles.collect()} == {"train", "validation"}
