"""Deterministic splits, samples, orders and offsets. Shuffles are by hash, ranks within strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidespark.functions import scalars as S


#: Rows of a stratum that one task ranks.
PART = 1_000_000


def _ranked(df: DataFrame, strata: list[str], key: list[str], seed) -> DataFrame:
    """df with _rank in hash order within the stratum and _n, the stratum's rows.

    A stratum of more than PART rows is cut into ranges of the hash; a row's rank is that within its range after
    the rows of the ranges before it, so no task holds a large stratum."""
    order = S.hash_order(seed, *map(F.col, strata), *map(F.col, key))
    x = df.select("*", order.alias("_o"), F.struct(*strata).alias("_s"))  # structs of nulls are equal
    sizes = x.groupBy("_s").agg(F.count("*").alias("_n"))
    at = F.conv(F.substring("_o", 1, 8), 16, 10).cast("double") / 2**32
    x = x.join(sizes, "_s").withColumn("_r", F.floor(at * F.ceil(F.col("_n") / PART)))
    w = W.partitionBy("_s").orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    ranges = x.groupBy("_s", "_r").agg(F.count("*").alias("_t")).select("_s", "_r", (F.sum("_t").over(w) - F.col("_t")).alias("_start"))
    x = x.withColumn("_k", F.row_number().over(W.partitionBy("_s", "_r").orderBy("_o", *key)))
    return x.join(ranges, ["_s", "_r"]).withColumn("_rank", F.col("_start") + F.col("_k")).drop("_s", "_r", "_o", "_k", "_start")


def lowest(df: DataFrame, strata: list[str], key: list[str], seed, most: Column, top: int) -> DataFrame:
    """df's first rows in hash order within each stratum, with _rank: most of them (from the strata's columns, top at most), all where there are fewer.

    Rows are counted by stratum and by the hash's place on a log scale, the count table alone is shuffled. It gives
    each stratum the place below which its wanted rows lie, a sixth more at most, and only rows below are shuffled and
    ranked. Repeated keys share a hash and are all ranked. Strata are tiles or classes: their table is of the
    manifest's size and is broadcast."""
    order = S.hash_order(seed, *map(F.col, strata), *map(F.col, key))
    at = (F.conv(F.substring("_o", 1, 8), 16, 10).cast("double") + 0.5) / 2**32
    x = df.withColumns({"_o": order, "_s": F.struct(*strata), "_most": most}).withColumn("_place", F.floor(F.log2(at) * 4))
    w = W.partitionBy("_s").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    counts = x.groupBy("_s", "_most", "_place").agg(F.count("*").alias("_t")).withColumn("_below", F.sum("_t").over(w) - F.col("_t"))
    cut = counts.filter(F.col("_below") < F.col("_most")).groupBy("_s").agg(F.max("_place").alias("_cut"))
    x = x.join(F.broadcast(cut), "_s").filter(F.col("_place") <= F.col("_cut"))
    x = x.withColumn("_rank", F.row_number().over(W.partitionBy("_s").orderBy("_o", *key))).filter(F.col("_rank") <= top)
    return x.filter(F.col("_rank") <= F.col("_most")).drop("_s", "_o", "_most", "_place", "_cut")


def split_points(samples: DataFrame, strata: list[str], key: list[str], fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Validation share of every stratum, at least one row and never all; one-row strata are train."""
    size = F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction))), F.col("_n") - 1)
    x = _ranked(samples, strata, key, seed)
    return x.withColumn("split", F.when((F.col("_n") >= 2) & (F.col("_rank") <= size), "validation").otherwise("train")).drop("_rank", "_n")


def split_80_10_10(samples: DataFrame, strata: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """A tenth of each stratum validates, a tenth tests."""
    t = F.floor(F.col("_n") / 10)
    x = _ranked(samples, strata, key, seed)
    return x.withColumn("split", F.when(F.col("_rank") <= t, "validation").when(F.col("_rank") <= 2 * t, "test").otherwise("train")).drop("_rank", "_n")


def split_tiles(tiles: DataFrame, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Whole tiles held out: a proper, non-empty subset of the manifest."""
    x = _ranked(tiles.withColumn("_all", F.lit(1)), ["_all"], ["id"], seed)
    size = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * F.lit(fraction))))
    return x.withColumn("split", F.when((F.col("_n") > 1) & (F.col("_rank") <= size), "validation").otherwise("train")).drop("_all", "_rank", "_n")


def cap_background(samples: DataFrame, tile: list[str], order: list[str]) -> DataFrame:
    """In scan order, keep a background row only while fewer were kept than foreground rows seen.

    Kept so far is the running background count plus the least of 0 and all earlier surpluses."""
    w = W.partitionBy(*tile).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = samples.withColumns({"_c": F.sum((F.col("foreground") == 0).cast("long")).over(w), "_f": F.sum((F.col("foreground") == 1).cast("long")).over(w)})
    x = x.withColumn("_b", F.col("_c") + F.least(F.lit(0), F.min(F.col("_f") - F.col("_c")).over(w)))
    x = x.withColumn("_was", F.lag("_b", 1, 0).over(W.partitionBy(*tile).orderBy(*order)))
    return x.filter((F.col("foreground") == 1) | (F.col("foreground") == 0) & (F.col("_b") > F.col("_was"))).drop("_c", "_f", "_b", "_was")


def epoch_sample(samples: DataFrame, tile: list[str], key: list[str], cap: int, seed: int, epoch: int) -> DataFrame:
    """E5: at most cap foreground rows a tile, and at most as many background rows; cap 0 takes all."""
    if not cap:
        return samples
    fg = F.col("foreground") == 1
    x = lowest(samples, [*tile, "foreground"], key, f"{seed}:{epoch}", F.lit(cap), cap)
    have = F.coalesce(F.sum(fg.cast("long")).over(W.partitionBy(*tile)), F.lit(0))
    return x.withColumn("_have", have).filter(fg | (F.col("_have") == 0) | (F.col("_rank") <= F.col("_have"))).drop("_rank", "_have")


def tile_sample(bins: DataFrame, tile: list[str], key: list[str], n: int = 512, seed: int = 0) -> DataFrame:
    """At most n rows a tile in hash order."""
    return lowest(bins, tile, key, seed, F.lit(n), n).drop("_rank")


def prefix_offsets(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """Start and stop of every row's share. For manifests: one row a tile, ordered as a whole."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("stop", F.sum(size).over(w).cast("long")).withColumn("start", F.col("stop") - F.col(size))


def plan_batches(samples: DataFrame, tile: list[str], key: list[str], size: int, seed: int = 0, merge: bool = False) -> DataFrame:
    """Batch number of every row, rows shuffled in tiles and tiles in the epoch; merged batches cross tiles.

    Rank within a tile plus the tile's offset, so no task holds more than a tile."""
    x = _ranked(samples, tile, key, seed)
    per = x.groupBy(*tile).agg(F.count("*").alias("_size")).withColumn("_o", S.hash_order(seed, "tiles", *map(F.col, tile)))
    per = per.withColumn("_share", F.col("_size") if merge else F.ceil(F.col("_size") / size))
    per = prefix_offsets(per, ["_o", *tile], "_share").select(*tile, "start")
    x = x.join(F.broadcast(per), tile)
    at = F.col("_rank") - 1
    batch = F.floor((F.col("start") + at) / size) if merge else F.col("start") + F.floor(at / size)
    return x.withColumn("batch", batch.cast("long")).drop("_rank", "_n", "start")


def balanced_batch(samples: DataFrame, key: list[str], per_class: int, seed: int = 0) -> DataFrame:
    """per_class foreground rows of each direction and 16 times as many background rows."""
    cls = F.when(F.col("foreground") == 1, F.col("direction")).otherwise(-1)
    most = F.when(F.col("_cls") < 0, 16 * per_class).otherwise(per_class)
    return lowest(samples.withColumn("_cls", cls), ["_cls"], key, seed, most, 16 * per_class).drop("_cls", "_rank")


def compact_labels(df: DataFrame, label: str, tile: list[str]) -> DataFrame:
    """Dense ids 1..n of the labels of each tile, and over all tiles by the tiles' offsets."""
    ids = df.filter(F.col(label) > 0).select(*tile, label).distinct()
    ids = ids.withColumn("local_id", F.row_number().over(W.partitionBy(*tile).orderBy(label)).cast("long"))
    per = prefix_offsets(ids.groupBy(*tile).agg(F.count("*").alias("_n")), tile, "_n").select(*tile, "start")
    return ids.join(F.broadcast(per), tile).select(*tile, label, "local_id", (F.col("start") + F.col("local_id")).alias("global_id"))


def top_k(df: DataFrame, by: str, ident: str, k: int) -> DataFrame:
    """The k rows with the largest by."""
    return df.orderBy(F.desc(by), ident).limit(k)


def half_sides(spots: DataFrame, repeats: int = 10, seed: int = 0) -> DataFrame:
    """Spots with sides: bit r is the spot's side in repeat r."""
    bit = lambda r: F.shiftleft((F.substring(S.hash_order(seed, F.lit(r), F.col("x"), F.col("y")), 1, 1) >= "8").cast("long"), r)
    return spots.withColumn("sides", sum((bit(r) for r in range(1, repeats)), bit(0)))


def half_split(spots: DataFrame, repeats: int = 10, seed: int = 0) -> DataFrame:
    """Side 0 or 1 of each spot in each repeat, one row each."""
    return _each(half_sides(spots, repeats, seed), repeats)


def line_sides(spots: DataFrame, repeats: int = 10) -> DataFrame:
    """Bit r is the side of line r through the cell's centroid; spots (x, y, cell, cx, cy). The lines are evenly turned and integer."""
    lines = [(i, 10 - i) if i % 2 else (10 - i, -i) for i in range(repeats)]
    bit = lambda r, a, b: F.shiftleft(((F.col("x") - F.col("cx")) * a + (F.col("y") - F.col("cy")) * b >= 0).cast("long"), r)
    return spots.withColumn("sides", sum((bit(r, a, b) for r, (a, b) in enumerate(lines[1:], 1)), bit(0, *lines[0])))


def line_split(spots: DataFrame, repeats: int = 10) -> DataFrame:
    """As line_sides, one row a repeat."""
    return _each(line_sides(spots, repeats), repeats)


def _each(x: DataFrame, repeats: int) -> DataFrame:
    x = x.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)).cast("array<long>")))
    return x.withColumn("side", F.getbit("sides", F.col("repeat").cast("int")).cast("long")).drop("sides")
