"""Assignment of large components, nearest centres, ingest with kept totals, conservation while writing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidespark.operators import evaluate, gates, spatial
from slidespark.streaming import ingest


def best_total(edges):
    """Greatest total of a one-to-one choice, by trying all."""
    if not edges:
        return 0.0
    (s, t, w), rest = edges[0], edges[1:]
    return max(best_total(rest), w + best_total([e for e in rest if e[0] != s and e[1] != t]))


def test_best_pairs_equal_all_choices(spark):
    rnd = random.Random(2)
    cases = [[(100 * c + s, 100 * c + t, rnd.choice([rnd.random(), 0.25, 0.5])) for s in range(4) for t in range(4) if rnd.random() < 0.55] for c in range(60)]
    got = evaluate.best_pairs(spark.createDataFrame([e for c in cases for e in c], "s long, t long, iou double")).collect()
    assert len({r.s for r in got}) == len({r.t for r in got}) == len(got)
    for c, edges in enumerate(cases):
        assert sum(r.iou for r in got if r.s // 100 == c) == pytest.approx(best_total(edges))


def test_chain_of_fifty_thousand_cells(spark):
    """One component of 50,000 labels: its total equals that of the best choice along the chain."""
    e = spark.range(49_999).select(F.floor((F.col("id") + 1) / 2).alias("s"), F.floor(F.col("id") / 2).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 + 0.001).alias("iou"))
    weights = [r.iou for r in e.orderBy(F.col("s") + F.col("t")).collect()]
    take = skip = 0.0
    for w in weights:
        take, skip = skip + w, max(skip, take)
    got = evaluate.best_pairs(e).agg(F.sum("iou"), F.countDistinct("s"), F.countDistinct("t"), F.count("*")).first()
    assert got[0] == pytest.approx(max(take, skip)) and got[1] == got[2] == got[3]


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(3)
    centres = [(i, rnd.uniform(0, 80) if i % 2 else 900 + rnd.uniform(0, 50), rnd.uniform(0, 80)) for i in range(30)] + [(40, 5.0, 5.0), (39, 5.0, 5.0)]
    points = [(rnd.randrange(-300, 1500), rnd.randrange(-200, 300)) for _ in range(300)] + [(5, 5), (5, 5)]
    c, p = spark.createDataFrame(centres, "cell long, cx double, cy double"), spark.createDataFrame(points, "x long, y long")
    got = {(r.x, r.y): (r.cell, r.distance) for r in spatial.nearest(p, c, 10).collect()}
    assert set(got) == set(points)
    for (x, y), (cell, distance) in got.items():
        d2, want = min(((x - cx) ** 2 + (y - cy) ** 2, i) for i, cx, cy in centres)
        assert cell == want and distance == pytest.approx(d2**0.5)
    assert {r.cell for r in spatial.nearest(p, c.limit(0)).collect()} == {None} and spatial.nearest(p.limit(0), c).isEmpty()


def test_ingest_keeps_totals(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    part = lambda a, b: spark.range(a, b).selectExpr("id % 3 AS gene_id", "id AS x", "2 * id AS y", "id % 5 AS cnt")
    part(0, 60).repartition(3).write.parquet(src)
    first = ingest.stream_ingest(spark, src, out, log, 20, files=1).collect()
    again = ingest.stream_ingest(spark, src, out, log, 20, files=1).collect()  # nothing new
    assert sorted(first) == sorted(again) and sum(r.records for r in first) == 60
    assert not ingest.ingest_status(spark, out).first().complete and not ingest.ingest_status(spark, out, 100).first().complete
    ingest.write_batch(spark.createDataFrame(spark.read.parquet(f"{out}/batch=1").select("gene_id", "x", "y", "cnt").collect()), 1, out, 20)
    assert sorted(ingest.totals(spark, out).collect()) == sorted(first)  # a batch that is run again
    part(60, 100).write.mode("append").parquet(src)
    ingest.stream_ingest(spark, src, out, log, 20, files=1)
    status = ingest.ingest_status(spark, out, 100).first()
    assert status.complete and (status.records, status.umis) == (100, 200)
    want = part(0, 100).groupBy(F.floor(F.col("x") / 20), F.floor(F.col("y") / 20)).agg(F.count("*"), F.sum("cnt")).collect()
    assert sorted(map(tuple, ingest.totals(spark, out).collect())) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="more records"):
        ingest.ingest_status(spark, out, 99).collect()


def test_conserve(spark):
    d = spark.range(50).selectExpr("id % 4 AS gene_id", "id AS cnt")
    merged = gates.conserve(d, lambda x: x.groupBy("gene_id").agg(F.sum("cnt").alias("cnt")), records=False)
    assert merged.count() == 4 and merged.agg(F.sum("cnt")).first()[0] == 1225
    with pytest.raises(ValueError, match="not conserved"):
        gates.conserve(d, lambda x: x.groupBy("gene_id").agg(F.sum("cnt").alias("cnt")))
    with pytest.raises(ValueError, match="not conserved"):
        gates.conserve(d, lambda x: x.filter("cnt <> 7"))


def test_lowest_ranks_of_small_large_and_repeated_keys(spark):
    from slidespark.operators import ranking as R

    df = spark.range(5000).selectExpr("id % 3 AS t", "CASE WHEN id % 3 = 2 THEN 7 ELSE id END AS k", "id").union(spark.createDataFrame([(None, 1, 1), (9, 1, 1)], "t long, k long, id long"))
    every = R._ranked(df, ["t"], ["k"], 5).filter("_rank <= 40").select("t", "k").collect()
    few = R.lowest(df, ["t"], ["k"], 5, F.lit(40), 40)
    assert sorted(map(str, few.select("t", "k").collect())) == sorted(map(str, every)) and len(every) == 122
    assert {r["max(_rank)"] for r in few.filter("t < 3").groupBy("t").agg(F.max("_rank")).collect()} == {40}


def test_grouped_quantiles_equal_numpy(spark):
    from slidespark.functions.quantile import grouped_quantiles

    rnd = np.random.default_rng(3)
    data = {"a": rnd.normal(size=3000), "b": np.repeat([1.0, 2.0], [5, 900]), "c": np.array([4.0]), None: np.array([])}
    rows = [(k, float(v), float(-v)) for k, x in data.items() for v in x] + [(None, None, 1.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    got = {r.g: r for r in grouped_quantiles(df, ["g"], {"p": F.col("v"), "m": F.col("w")}, [0.0, 0.3, 0.5, 1.0]).collect()}
    assert set(got) == set(data) and got[None].p is None and got[None].m == [1.0] * 4
    for k in "abc":
        assert np.allclose(got[k].p, np.quantile(data[k], [0, 0.3, 0.5, 1])) and np.allclose(got[k].m, np.quantile(-data[k], [0, 0.3, 0.5, 1]))


@pytest.mark.parametrize("most", [0, 1 << 26])
def test_pooling_of_wide_vectors_equals_numpy(spark, monkeypatch, most):
    from slidespark.operators import expression as E

    monkeypatch.setattr(E, "BROADCAST", most)
    rnd = np.random.default_rng(4)
    vec = rnd.normal(size=(30, 70)).round(3)
    cnt = [(i % 7, 0, int(g), int(rnd.integers(1, 9))) for i in range(60) for g in [rnd.integers(0, 34)]]
    v = spark.createDataFrame([(i, [float(e) for e in x]) for i, x in enumerate(vec)] + [(30, []), (31, None)], "gene_id long, embedding array<double>")
    got = E.pool_embeddings(spark.createDataFrame(cnt, "bx long, by_ long, gene_id long, cnt long"), v).toPandas()
    for b in range(7):
        use = [(g, c) for x, _, g, c in cnt if x == b and g < 30]
        part = got[got.bx == b].sort_values("dim")
        assert part.dim.tolist() == list(range(70)) and set(part.nnz) == {len(use)}
        assert np.allclose(part.value, sum(c * vec[g] for g, c in use) / len(use), atol=1e-9)
