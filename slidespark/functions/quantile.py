"""Exact quantiles of a whole column without all of its values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalars import quantile_bin

#: Ranges that the values are cut into, and the accuracy of the cuts, which only decides how even they are.
RANGES, ACCURACY = 256, 2000


def exact_quantiles(df: DataFrame, value: Column, shares: list[float], name: str = "q") -> DataFrame:
    """One row with name, an array of linearly interpolated quantiles of the non-null values; null if there are none.

    Values are counted, cut into RANGES by approximate quantiles, and ranked only within the ranges that hold a wanted
    place, after the counts of the ranges before them."""
    counts = df.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("v", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), ACCURACY).alias("cuts"))
    x = counts.crossJoin(F.broadcast(cuts)).select("v", "n", quantile_bin(F.col("v"), F.col("cuts")).alias("b"))  # one row
    every = W.orderBy("b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranges = x.groupBy("b").agg(F.sum("n").alias("t"))  # RANGES rows at most
    ranges = ranges.select("b", "t", (F.sum("t").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("t")).alias("start"), F.sum("t").over(every).alias("total"))
    at = [F.lit(s) * (F.col("total") - 1) for s in shares]
    low, high = [F.floor(p) for p in at], [F.ceil(p) for p in at]
    wanted = ranges.withColumn("places", F.array(*low, *high)).filter(F.exists("places", lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("t"))))
    x = x.join(F.broadcast(wanted.select("b", "start", "total")), "b")
    end = F.col("start") + F.sum("n").over(W.partitionBy("b").orderBy("v"))
    x = x.select("v", "total", (end - F.col("n")).alias("begin"), end.alias("end"))
    here = lambda p: F.max(F.when((p >= F.col("begin")) & (p < F.col("end")), F.col("v")))
    found = x.agg(F.max("total").alias("total"), *(here(p).alias(f"l{i}") for i, p in enumerate(low)), *(here(p).alias(f"h{i}") for i, p in enumerate(high)))
    return found.select(F.when(F.col("total") > 0, F.array(*(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (p - F.floor(p)) for i, p in enumerate(at)))).alias(name))


def exact_quantile(df: DataFrame, value: Column, share: float, name: str) -> DataFrame:
    """One row with name, a single quantile."""
    return exact_quantiles(df, value, [share], name).select(F.get(name, F.lit(0)).alias(name))


def grouped_quantiles(df: DataFrame, key: list[str], values: dict[str, Column], shares: list[float]) -> DataFrame:
    """(key, name of each value): arrays of linearly interpolated quantiles of the group's non-null values, null if it has none.

    As exact_quantiles, by group: all values are counted in one shuffle, cut into ranges of their group and ranked only in
    ranges that hold a wanted place, so no task holds a large group. The joins by group are with tables of one row of
    cuts a group; where those are too large to broadcast, groups are small or split by the adaptive skew join."""
    fields = F.explode(F.array(*(F.struct(F.lit(n).alias("m"), v.cast("double").alias("v")) for n, v in values.items()))).alias("_e")
    keys, g = df.select(*key).distinct(), ["_s", "m"]
    rows = df.select(F.struct(*key).alias("_s"), fields).select("_s", "_e.m", "_e.v").filter("v is not null")  # structs of nulls are equal
    counts = rows.groupBy(*g, "v").agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*g).agg(F.percentile_approx("v", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), ACCURACY).alias("cuts"))
    x = counts.join(cuts, g).select(*g, "v", "n", quantile_bin(F.col("v"), F.col("cuts")).alias("b"))
    by = W.partitionBy(*g)
    ranges = x.groupBy(*g, "b").agg(F.sum("n").alias("t"))  # RANGES rows a group at most
    ranges = ranges.withColumns({"start": F.sum("t").over(by.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("t"), "total": F.sum("t").over(by)})
    at = [F.lit(s) * (F.col("total") - 1) for s in shares]
    low, high = [F.floor(p) for p in at], [F.ceil(p) for p in at]
    wanted = ranges.filter(F.exists(F.array(*low, *high), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("t"))))
    x = x.join(wanted.select(*g, "b", "start", "total"), [*g, "b"])
    end = F.col("start") + F.sum("n").over(W.partitionBy(*g, "b").orderBy("v"))
    x = x.withColumns({"begin": end - F.col("n"), "end": end})
    here = lambda p: F.max(F.when((p >= F.col("begin")) & (p < F.col("end")), F.col("v")))
    x = x.groupBy(*g).agg(F.max("total").alias("total"), *(here(p).alias(f"l{i}") for i, p in enumerate(low)), *(here(p).alias(f"h{i}") for i, p in enumerate(high)))
    x = x.select(*g, F.array(*(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (p - F.floor(p)) for i, p in enumerate(at))).alias("q"))
    wide = x.groupBy("_s").agg(*(F.max(F.when(F.col("m") == n, F.col("q"))).alias(n) for n in values))
    return keys.withColumn("_s", F.struct(*key)).join(wide, "_s", "left").drop("_s")
