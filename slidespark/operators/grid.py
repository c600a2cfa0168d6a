"""Pixels, bins, tiles and their predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidespark.functions import scalars as S
from slidespark.functions.quantile import exact_quantiles

CORE, HALO, BIN = 1200, 60, 3


def rebase(records: DataFrame) -> DataFrame:
    """B1: coordinates from the smallest x and y, with the slide's shape (height, width) on every row."""
    low = records.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    x = records.crossJoin(F.broadcast(low))  # one row
    return x.select(
        (F.col("x") - F.col("x0")).alias("x"),
        (F.col("y") - F.col("y0")).alias("y"),
        *(c for c in records.columns if c not in ("x", "y")),
        (F.col("x1") - F.col("x0") + 1).alias("height"),
        (F.col("y1") - F.col("y0") + 1).alias("width"),
    )


def to_bin(df: DataFrame, size: int = BIN, ox: Column | int = 0, oy: Column | int = 0) -> DataFrame:
    """B2: df with bx, by_ and the anchor pixel ax, ay of each row's bin."""
    x = df.withColumns({"bx": S.bin_of(F.col("x"), size, ox), "by_": S.bin_of(F.col("y"), size, oy)})
    return x.withColumns({"ax": F.col("bx") * size, "ay": F.col("by_") * size})


def make_tiles(spark, height: int, width: int, core: int = CORE, halo: int = HALO) -> DataFrame:
    """Id, ix, iy, x, y, width, height (edge-clipped), halo, origin_x, origin_y of every tile of a slide."""
    nx, ny = -(-height // core), -(-width // core)
    t = spark.range(nx * ny).select(F.floor(F.col("id") / ny).cast("long").alias("ix"), F.pmod("id", F.lit(ny)).alias("iy"))
    return t.select(
        F.format_string("x%02d_y%02d", "ix", "iy").alias("id"),
        "ix",
        "iy",
        (F.col("ix") * core).alias("x"),
        (F.col("iy") * core).alias("y"),
        F.least(F.lit(core), F.lit(height) - F.col("ix") * core).cast("long").alias("width"),
        F.least(F.lit(core), F.lit(width) - F.col("iy") * core).cast("long").alias("height"),
        F.lit(halo).cast("long").alias("halo"),
        (F.col("ix") * core - halo).alias("origin_x"),
        (F.col("iy") * core - halo).alias("origin_y"),
    )


def core_tile(df: DataFrame, core: int = CORE) -> DataFrame:
    """The one tile whose core owns each pixel."""
    return df.withColumns({"ix": F.floor(F.col("x") / core).cast("long"), "iy": F.floor(F.col("y") / core).cast("long")})


def core_only(df: DataFrame, core: int = CORE) -> DataFrame:
    """Rows of haloed tiles (tile ix, iy; slide x, y) that lie in their tile's core."""
    return df.filter((F.floor(F.col("x") / core) == F.col("ix")) & (F.floor(F.col("y") / core) == F.col("iy")))


def interior(lx: Column, ly: Column, width: Column, height: Column, halo: int, margin: int) -> Column:
    """Tile-local pixel lies inside the core eroded by margin - halo, half-open."""
    m = margin
    return (lx >= halo + m) & (lx < halo + width - m) & (ly >= halo + m) & (ly < halo + height - m)


def crop(records: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """Records of a box in local coordinates; the range filter reaches the scan."""
    x = records.filter((F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h))
    return x.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def validate_records(df: DataFrame, height: Column | int, width: Column | int) -> DataFrame:
    """Number of rows that break each rule, in one pass."""
    rule = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    return df.agg(
        F.count("*").alias("n_rows"),
        rule(F.col("cnt") <= 0).alias("bad_count"),
        rule((F.col("x") < 0) | (F.col("y") < 0)).alias("negative_xy"),
        rule((F.col("x") >= height) | (F.col("y") >= width)).alias("outside"),
    )


def spatial_holdout(samples: DataFrame, height: Column | int, width: Column | int, ratio: float = 0.0625) -> DataFrame:
    """Split of samples (x, y, foreground): centres strictly beyond both limits are held out; only their foreground validates."""
    keep = 1 - ratio**0.5
    far = (F.col("x") > F.floor(F.lit(height) * keep)) & (F.col("y") > F.floor(F.lit(width) * keep)) if not isinstance(height, Column) else (F.col("x") > F.floor(height * keep)) & (F.col("y") > F.floor(width * keep))
    return samples.withColumn("split", F.when(~far, "train").when(F.col("foreground") == 1, "validation").otherwise("dropped"))


def stretch(pixels: DataFrame, col: str, low: float = 1.0, high: float = 99.5) -> DataFrame:
    """Contrast stretch of an intensity to 0..255 between percentiles of its positive pixels."""
    cut = exact_quantiles(pixels.filter(F.col(col) > 0), F.col(col), [low / 100, high / 100], "_p")
    a, b = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    x = pixels.crossJoin(F.broadcast(cut))  # one row
    return x.withColumn("stretched", S.clip((F.col(col) - a) / F.greatest(b - a, F.lit(1e-12)), 0.0, 1.0) * 255).drop("_p")


def apply_affine(df: DataFrame, m: list[list[float]]) -> DataFrame:
    """X, y moved by a 2 x 3 matrix."""
    f = lambda r: F.col("x") * r[0] + F.col("y") * r[1] + r[2]
    return df.withColumns({"x": f(m[0]), "y": f(m[1])})


def corner_shift(tiles: DataFrame, m: list[list[float]], most: float = 120.0) -> DataFrame:
    """The largest displacement of each tile's corners, and whether it is below the limit."""
    d = []
    for dx in (F.lit(0), F.col("width")):
        for dy in (F.lit(0), F.col("height")):
            x, y = F.col("x") + dx, F.col("y") + dy
            d.append(F.sqrt((x * m[0][0] + y * m[0][1] + m[0][2] - x) ** 2 + (x * m[1][0] + y * m[1][1] + m[1][2] - y) ** 2))
    shift = F.greatest(*d)
    return tiles.select("id", shift.alias("shift"), (shift < most).alias("ok"))


def drop_small_labels(pixels: DataFrame, label: str, least: int = 200) -> DataFrame:
    """Pixels of labels with enough area."""
    big = pixels.filter(F.col(label) > 0).groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return pixels.join(big.select(label), label, "left_semi")


def expand_bins(labels: DataFrame, size: int, height: Column, width: Column) -> DataFrame:
    """Every bin's label on its size x size pixels, clipped to the image."""
    step = F.sequence(F.lit(0), F.lit(size - 1))
    x = labels.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    x = x.withColumns({"x": F.col("bx") * size + F.col("_dx"), "y": F.col("by_") * size + F.col("_dy")})
    return x.filter((F.col("x") < height) & (F.col("y") < width)).drop("_dx", "_dy")


def restrict_genes(spots: DataFrame, selected: list[int], n_genes: int) -> DataFrame:
    """Spots (.., genes array<struct<gene_id, cnt>>) with the selected genes only, under their new ids 0, 1, ..

    A spot without any is kept as an empty token. Selected ids are unique and below n_genes."""
    if not selected or len(set(selected)) < len(selected) or min(selected) < 0 or max(selected) >= n_genes:
        raise ValueError("selected gene ids must be unique and valid")
    new = F.create_map(*(F.lit(v).cast("long") for i, g in enumerate(selected) for v in (g, i)))
    ids = F.array(*(F.lit(g).cast("long") for g in selected))
    kept = F.filter("genes", lambda g: F.array_contains(ids, g["gene_id"].cast("long")))
    return spots.withColumn("genes", F.transform(kept, lambda g: F.struct(F.element_at(new, g["gene_id"].cast("long")).alias("gene_id"), g["cnt"].alias("cnt"))))


def coverage(spots: DataFrame) -> DataFrame:
    """Spots, those left empty, and tokens of restricted spots."""
    return spots.agg(F.count("*").alias("spots"), F.count_if(F.size("genes") == 0).alias("empty"), F.sum(F.size("genes")).cast("long").alias("tokens"))
