"""What is taken from a table of label pairs counts the pixels once (F7, F11, F14, F15): results rest on written counts, not on the pixels."""

import pytest

from slidespark.operators import compare, evaluate


@pytest.fixture
def pixels(spark, tmp_path):
    rows = [(x, y, 1 + x // 9, 1 + x // 10, 11 + x // 8, 5 if y < 9 else 0) for x in range(40) for y in range(12)]
    spark.createDataFrame(rows, "x long, y long, a long, b long, m long, nucleus_id long").write.parquet(f"{tmp_path}/pixels")
    return spark.read.parquet(f"{tmp_path}/pixels")


@pytest.mark.parametrize(
    "of",
    [
        lambda p: evaluate.instance_iou(p.selectExpr("a AS gt", "b AS predicted")),
        lambda p: compare.transcript_iou(p.selectExpr("m AS manual", "b AS predicted")),
        lambda p: compare.cutoff_iou(p.selectExpr("m AS manual", "b AS predicted"), p, "b", [0, 100]),
        lambda p: compare.pair_by_nucleus(p, "a", "b"),
    ],
    ids=["i6", "i5", "i10", "d16"],
)
def test_pixels_are_not_read_again(pixels, of):
    out = of(pixels)
    assert out.count() > 0
    assert not [f for f in out.inputFiles() if "/pixels/" in f]
