"""I4 joins records with labels once; its three regions are taken from counts by pair of labels and gene."""

from slidespark.operators import evaluate as V


def test_records_are_joined_once(spark):
    rows = [(x, y, (x * 3 + y) % 6, 1 + (x + y) % 3) for x in range(24) for y in range(24)]
    records = spark.createDataFrame(rows, "x long, y long, gene_id long, cnt long")
    labels = spark.createDataFrame([(x, y, 1 + x // 12, 1 + x // 12 if y % 8 else 0, 1 + (x + 2) // 13) for x in range(24) for y in range(24)], "x long, y long, nucleus_id long, a long, b long")
    got = V.paired_consistency(records, labels, "a", "b", 6, least=0)
    want = {1: (1, 1), 2: (2, 2)}
    assert {r.nucleus: (r.cell_a, r.cell_b) for r in got.collect()} == want
    # the tables of the records and labels are not part of what is left to do
    assert "LogicalRDD" not in got._jdf.queryExecution().optimizedPlan().toString()
