"""The tile index writes a file a small tile, and splits a large one."""

import pytest
from pyspark.sql import functions as F

from slidespark.sources import records as A


def files(spark, path, tile):
    each = spark.read.parquet(path).select(*tile, F.input_file_name().alias("file")).distinct()
    return {r["count"] for r in each.groupBy(*tile).count().collect()}


@pytest.fixture
def many_tasks(spark):
    """As on a large slide, where small shuffle partitions are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_files_by_tile(spark, tmp_path, many_tasks):
    records = spark.range(60_000).select((F.col("id") * 7 % 600).alias("x"), (F.col("id") * 13 % 450).alias("y"), (F.col("id") % 9).alias("gene_id"), F.lit(1).cast("long").alias("cnt"))
    totals = A.write_spatial_index(records, str(tmp_path / "small"), 150)
    assert totals.count() == 12 and totals.agg(F.sum("records")).first()[0] == 60_000
    assert files(spark, str(tmp_path / "small"), ("ix", "iy")) == {1}
    A.write_shards(records, str(tmp_path / "shards"), 150)
    assert files(spark, str(tmp_path / "shards"), ("px", "py")) == {1} and spark.read.parquet(str(tmp_path / "shards")).count() == 60_000
    A.write_spatial_index(records, str(tmp_path / "large"), 1200)
    assert max(files(spark, str(tmp_path / "large"), ("ix", "iy"))) > 1
