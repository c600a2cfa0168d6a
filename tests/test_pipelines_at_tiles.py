"""P1 on tiles of a written index against the whole slide, and P2's common input, cross part and second count."""

import random

import pytest
from pyspark.sql import functions as F

from slidespark.operators import grid
from slidespark.plans import pipelines
from slidespark.sources import records as A

SIDE = 120
RECORD = "x long, y long, gene_id long, cnt long"


def points(seed, n=9000):
    rnd = random.Random(seed)
    return [(rnd.randrange(SIDE), rnd.randrange(SIDE), rnd.randrange(12), rnd.randrange(1, 5)) for _ in range(n)]


def test_region_reads_own_and_adjacent_folders_only(spark, tmp_path):
    rows = points(1)
    path = str(tmp_path / "index")
    A.write_spatial_index(spark.createDataFrame(rows, RECORD), path, 20)
    got = A.read_region(spark, path, [(0, 1), (4, 4)], 20, 6)
    box = lambda v, i: i * 20 - 6 <= v < (i + 1) * 20 + 6
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if any(box(r[0], i) and box(r[1], j) for i, j in ((0, 1), (4, 4))))
    scan = next(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert "PartitionFilters: []" not in scan
    read = spark.read.parquet(path).filter(A.tile_code(F.col("ix"), F.col("iy")).isin([1])).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("/ix=0/iy=1/" in r.f for r in read)
    assert A.read_region(spark, path, [], 20, 6).count() == 0
    with pytest.raises(ValueError, match="adjacent"):
        A.read_region(spark, path, [(0, 0)], 20, 11)


def test_tiles_give_the_samples_of_the_whole_slide(spark, tmp_path):
    core, halo, rows = 72, 36, points(2)
    raw = spark.createDataFrame([(k, f"g{g}", x, y, n) for k, (x, y, g, n) in enumerate(rows)], "seq long, gene string, x long, y long, cnt long")
    found = pipelines.index_slide(raw, str(tmp_path / "index"), core)
    table = found.genes.select("gene_id", F.upper("gene").alias("symbol"))
    symbols = spark.createDataFrame([(f"G{g}",) for g in range(10)], "symbol string")
    pixels = spark.createDataFrame([(x, y, 1 + y // 60 if (x - 36) ** 2 + (y % 60 - 30) ** 2 <= 400 else 0, 5) for x in range(0, SIDE, 3) for y in range(0, SIDE, 3)], "x long, y long, nucleus_id long, stain long")
    every = grid.make_tiles(spark, SIDE, SIDE, core, halo).withColumn("split", F.lit("train"))
    args = (pixels, table, symbols)
    p = pipelines.prepare_tiles(str(tmp_path / "index"), str(tmp_path / "out"), every.filter("iy = 0"), *args, SIDE, SIDE, core, halo, n=20, seed=3)
    records = grid.to_bin(raw.join(found.genes.select("gene", "gene_id"), "gene"))
    whole = pipelines.prepare_slide(records, *args, core, n=20, seed=3, height=SIDE, width=SIDE)
    own = F.col("by_") < core // 3
    pick = lambda d, *c: sorted(map(str, d.filter(own).select(*c).collect()))
    cols = ("bx", "by_", "foreground", "direction", "eligible", "split")
    assert pick(p.samples, *cols) == pick(whole.samples, *cols) and p.samples.count() == len(pick(whole.samples, "bx"))
    assert pick(p.tokens, "bx", "by_", "rank", "gene_id", "cnt") == pick(whole.tokens, "bx", "by_", "rank", "gene_id", "cnt")
    s = p.samples.collect()
    c = p.counts.first()
    assert (c.tiles, c.prepared_tiles, c.centres_core_unique) == (2, 2, len(s)) and c.centres_with_halo > len(s)
    assert c.train_foreground == sum(r.eligible and r.foreground == 1 for r in s) > 0
    with pytest.raises(ValueError, match="smaller"):
        pipelines.prepare_tiles(str(tmp_path / "index"), str(tmp_path / "no"), every, *args, SIDE, SIDE, core, 30)
    with pytest.raises(ValueError, match="without an embedding"):
        pipelines.prepare_tiles(str(tmp_path / "index"), str(tmp_path / "no"), every, *args, SIDE, SIDE, core, halo, n=20, strict=True)


def test_comparison_counts_twice_and_checks_its_input(spark):
    rows = [(x, y, (x * 3 + y) % 6, 1 + (x + y) % 3) for x in range(24) for y in range(24)] * 2
    records = spark.createDataFrame(rows, RECORD)
    labels = spark.createDataFrame([(x, y, 1 + x // 12, 1 + x // 12 if y % 8 else 0, 1 + (x + 2) // 13) for x in range(24) for y in range(24)], "x long, y long, nucleus_id long, a long, b long")
    genes = spark.range(6).select(F.col("id").alias("gene_id"))
    got = pipelines.compare_labelings(records, labels, "a", "b", seed=1, genes=genes, shape=(24, 24))
    table = {r.method: r for r in got.table.collect()}
    total = sum(r[3] for r in rows)
    assert table["a"].assigned_share == sum(r[3] for r in rows if r[1] % 8) / total and table["b"].assigned_share == 1
    assert got.cross_totals.first().source_cells_matched == 2 and got.faults.count() == 0
    wrong = got.table.withColumn("assigned_share", F.when(F.col("method") == "a", 0.5).otherwise(F.col("assigned_share")))
    cells = spark.createDataFrame([], "method string, n_spots long, random double, directional double")
    bad = pipelines._recheck(wrong.withColumns({"random_mean": F.lit(None), "directional_mean": F.lit(None)}), cells, records, labels, ("a", "b")).collect()
    assert [(r.method, r.figure, r.reported) for r in bad] == [("a", "assigned_share", 0.5)]
    with pytest.raises(ValueError, match="unknown gene"):
        pipelines.compare_labelings(records, labels, "a", "b", genes=genes.limit(3), shape=(24, 24))
    with pytest.raises(ValueError, match="outside"):
        pipelines.compare_labelings(records, labels, "a", "b", genes=genes, shape=(24, 20))
