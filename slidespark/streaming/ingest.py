"""Incremental ingest of record files into the spatial index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_ingest(spark: SparkSession, source: str, out: str, checkpoint: str, core: int = 1200, files: int = 8) -> DataFrame:
    """K1: append new Parquet files of source (gene_id, x, y, cnt) to the tile index; returns the totals by tile so far.

    Each micro-batch replaces its own folder in the index and in the table of totals beside it (``out``_totals), so a
    batch that is run again after a failure is not counted twice. The totals are summed from that table, a row a tile
    and batch; the index itself is not read again."""
    kind = spark.read.parquet(source).schema

    def append(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, out, core)

    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return totals(spark, out)


def write_batch(batch: DataFrame, number: int, out: str, core: int) -> None:
    """One micro-batch into the index, then its totals, computed from what was written.

    Records are dealt by tile and by blocks of 512 pixel rows, so that a batch writes a few files a tile, not one a tile and task."""
    x = batch.withColumns({c: F.floor(F.col(v) / core).cast("int") for c, v in (("ix", "x"), ("iy", "y"))})
    x.repartition("ix", "iy", F.floor(F.col("x") / 512)).write.mode("overwrite").partitionBy("ix", "iy").parquet(f"{out}/batch={number}")
    x = batch.sparkSession.read.schema(x.schema).parquet(f"{out}/batch={number}")
    x.groupBy("ix", "iy").agg(F.count("*").alias("records"), F.sum("cnt").cast("long").alias("umis")).write.mode("overwrite").parquet(f"{out}_totals/batch={number}")


def totals(spark: SparkSession, out: str) -> DataFrame:
    """(ix, iy, records, umis) of all batches of the index."""
    got = spark.read.parquet(f"{out}_totals")
    return got.groupBy(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).agg(*(F.sum(c).cast("long").alias(c) for c in ("records", "umis")))


def ingest_status(spark: SparkSession, out: str, expected: int | None = None) -> DataFrame:
    """K1: one row (batches, tiles, records, umis, complete): complete once the source's own count of records is reached.

    A source that does not say how many records it has is never complete; one that has given more than it said is an error."""
    got = spark.read.parquet(f"{out}_totals").agg(
        F.countDistinct("batch").alias("batches"), F.countDistinct("ix", "iy").alias("tiles"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("records", "umis"))
    )
    n = F.lit(expected).cast("long")
    more = F.when(F.col("records") > n, F.raise_error(F.lit("more records than the source said")))
    return got.withColumn("complete", F.coalesce(more.cast("boolean"), F.col("records") == n, F.lit(False)))
