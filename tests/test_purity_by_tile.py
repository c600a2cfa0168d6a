"""Purity sums by tile against the enhanced counts as a table; a comparison reads its records once."""

import random

from pyspark.sql import functions as F

from slidespark.operators import spatial
from slidespark.plans import pipelines


def test_sums_of_enhanced_counts_across_tiles(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-8, 8) + 128 * rng.randint(-1, 1), rng.randint(-8, 8) + 128, rng.randint(1, 4), rng.randint(1, 5)) for _ in range(1500)]
    counts = spark.createDataFrame(rows, "x long, y long, gene_id long, cnt long")
    spots = sorted({r[:2] for r in rows})
    members = spark.createDataFrame([(g, x, y) for x, y in spots for g in (1, 2 + (x + y) % 3) if g < 4], "grp long, x long, y long")
    value = spatial.kernel_enhance(counts.select("x", "y").distinct(), counts, 2)
    want = members.join(value, ["x", "y"]).groupBy("grp", "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    got = spatial.enhanced_sums(counts, members, 2)
    as_rows = lambda d: sorted((r.grp, r.gene_id, round(r.s, 6), round(r.q, 6)) for r in d.collect())
    assert as_rows(got) == as_rows(want)


def test_a_comparison_reads_its_records_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(v: int) -> int:
        read.add(1)
        return v

    own = F.udf(counted, "long").asNondeterministic()
    rows = [(x, y, (x * 7 + y) % 5, 1 + (x + y) % 3) for x in range(24) for y in range(24)]
    records = spark.createDataFrame(rows, "x long, y long, gene_id long, cnt long").withColumn("cnt", own("cnt"))
    near = [(x, y, int(abs(x - 12) < 4 and abs(y - 12) < 4), int(x < 20), int(y < 20)) for x in range(24) for y in range(24)]
    labels = spark.createDataFrame(near, "x long, y long, nucleus_id long, a long, b long")
    table = pipelines.compare_labelings(records, labels, "a", "b").table.orderBy("method").collect()
    assert [(r.method, r.cells) for r in table] == [("a", 1), ("b", 1)]
    assert read.value == len(rows)
