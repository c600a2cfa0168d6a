"""Naive Bayes over binned features in SQL: counts by grouped sums, scores by array look-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binned(value: Column, bins: int) -> Column:
    """value as a bin number 0 .. bins - 1; null is bin 0."""
    return F.coalesce(F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")


def fit(rows: DataFrame, bins: dict[str, int], classes: list[str]) -> tuple[dict[str, dict[str, list[float]]], dict[str, float]]:
    """Log likelihoods by feature, class and bin, and class shares, from rows (cls, one column per feature).

    What is collected: one count per feature, bin and class, whatever the number of rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in bins))).alias("x")
    got = rows.select("cls", pairs).groupBy("cls", "x.f", "x.b").agg(F.count("*").alias("n")).collect()
    counts = {f: {c: [0.5] * n for c in classes} for f, n in bins.items()}
    for r in got:
        if r.cls in classes:
            counts[r.f][r.cls][r.b] += r.n
    first = next(iter(bins))
    totals = {c: sum(counts[first][c]) - 0.5 * bins[first] + 1 for c in classes}
    logs = {f: {c: [math.log(v / sum(per[c])) for v in per[c]] for c in classes} for f, per in counts.items()}
    return logs, {c: totals[c] / sum(totals.values()) for c in classes}


def log_likelihood(logs: dict[str, dict[str, list[float]]], cls: str) -> Column:
    out = F.lit(0.0)
    for f, per in logs.items():
        out = out + F.get(F.array(*map(F.lit, per[cls])), F.col(f))
    return out
