"""A micro-batch writes a file a tile, whatever its tasks (F17); the reach of neighbourhoods does not find them again."""

from pathlib import Path

from pyspark.sql import functions as F

from slidespark.operators import expression
from slidespark.streaming import ingest


def test_a_batch_writes_a_file_a_tile(spark, tmp_path):
    batch = spark.range(900).select((F.col("id") % 30).alias("x"), F.floor(F.col("id") / 30).alias("y"), F.lit(1).alias("gene_id"), F.lit(2).alias("cnt")).repartition(6)
    ingest.write_batch(batch, 0, f"{tmp_path}/out", 10)
    assert len(list(Path(f"{tmp_path}/out").rglob("*.parquet"))) == 9
    got = ingest.totals(spark, f"{tmp_path}/out").collect()
    assert sorted((r.ix, r.iy, r.records, r.umis) for r in got) == [(i, j, 100, 200) for i in range(3) for j in range(3)]


def test_neighbourhoods_are_read_once(spark, tmp_path):
    rows = [(x, y, r, x + r, y) for x in range(6) for y in range(6) for r in range(3)]
    spark.createDataFrame(rows, "bx long, by_ long, rank long, nx long, ny long").write.parquet(f"{tmp_path}/near")
    nuclei = spark.createDataFrame([(3, y, 1) for y in range(6)], "bx long, by_ long, nucleus_id long")
    out = expression.context_reach(spark.read.parquet(f"{tmp_path}/near"), nuclei)
    assert not [f for f in out.inputFiles() if "/near/" in f]
    r = out.first()
    assert (r.p50, r.p99, round(r.outside_with_nucleus, 6)) == (6.0, 6.0, 0.4)
