"""Set checks and data-quality gates. The ``require_`` forms raise; the others return the offending rows or counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from slidespark.plans.shared import new_folder


def union_patches(parts: dict[str, DataFrame]) -> DataFrame:
    """rows of all patches, tagged; empty patches add none and stay in the manifest's totals."""
    return reduce(DataFrame.unionByName, (d.withColumn("patch", F.lit(k)) for k, d in parts.items()))


def check_splits(samples: DataFrame, key: list[str]) -> DataFrame:
    """rows, keys in more than one split, rows without a split."""
    per = samples.groupBy(*key).agg(F.countDistinct("split").alias("k"), F.count("*").alias("n"), F.count_if(F.col("split").isNull()).alias("z"))
    return per.agg(F.sum("n").cast("long").alias("n_rows"), F.count_if(F.col("k") > 1).alias("overlapping"), F.sum("z").cast("long").alias("unassigned"))


def check_subset(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """keys of a that b lacks."""
    return a.select(*key).distinct().join(b.select(*key), key, "left_anti")


def distinct_on(df: DataFrame, cols: list[str]) -> DataFrame:
    """F4."""
    return df.select(*cols).distinct()


def totals(df: DataFrame) -> DataFrame:
    """Rows and counts of a table of records."""
    return df.agg(F.count("*").alias("records"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("umis"))


def assert_conserved(before: DataFrame, after: DataFrame, records: bool = True) -> None:
    """Counts, and rows unless they were merged, are the same before and after a step."""
    a, b = totals(before).first(), totals(after).first()
    if a.umis != b.umis or records and a.records != b.records:
        raise ValueError(f"not conserved: {a} became {b}")


def conserve(before: DataFrame, step: Callable[[DataFrame], DataFrame], records: bool = True) -> DataFrame:
    """step(before), written to the shared folder and read back, counted on both sides while it is written: one job, no extra scan.

    step must read its input once; rows may change in number only with records off, where a step merges them."""
    spark, path = before.sparkSession, new_folder(before.sparkSession, "conserved")
    seen = Observation(), Observation()
    figures = F.count("*").alias("records"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("umis")
    after = step(before.observe(seen[0], *figures)).observe(seen[1], *figures)
    after.write.parquet(path)
    a, b = (o.get for o in seen)
    if a["umis"] != b["umis"] or records and a["records"] != b["records"]:
        raise ValueError(f"not conserved: {a} became {b}")
    return spark.read.schema(after.schema).parquet(path)


def incomplete(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """Tiles without a terminal state, failed, or prepared under more than one schema. status (id, state, fingerprint)."""
    mixed = status.select("fingerprint").distinct().agg((F.count("*") > 1).alias("mixed"))
    x = manifest.select("id").join(status, "id", "left").crossJoin(F.broadcast(mixed))  # one row
    return x.filter(F.col("state").isNull() | ~F.col("state").isin("done", "empty") | F.col("mixed")).select("id", F.coalesce("state", F.lit("missing")).alias("state"))


def require_complete(manifest: DataFrame, status: DataFrame) -> None:
    if bad := incomplete(manifest, status).limit(5).collect():
        raise ValueError(f"incomplete slide: {bad}")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: list[str]) -> None:
    if bad := duplicates(df, key).limit(5).collect():
        raise ValueError(f"keys occur more than once: {bad}")


def validate_preparation(samples: DataFrame, tiles: DataFrame, markers: DataFrame, n: int = 50) -> DataFrame:
    """(id, rule, n): prepared tiles that break a rule, and how often; none are expected.

    samples (id, x, y, neighbors array<long>, foreground, dx, dy, eligible, interior), one row a supported centre; tiles (id,
    records, bins), bins the size of the tile's grid; markers (id, state, foreground, background) as written with the data."""
    fg = F.col("foreground")
    bad = {
        "neighbors": (F.size("neighbors") != n) | F.exists("neighbors", lambda i: (i < 0) | (i >= F.col("bins"))),
        "class": ~fg.isin(-1, 0, 1),
        "direction": ~(F.coalesce(F.abs("dx") < float("inf"), F.lit(False)) & F.coalesce(F.abs("dy") < float("inf"), F.lit(False))),
        "eligible": F.col("eligible") != (F.col("interior") & (fg >= 0)),
    }
    x = samples.join(tiles.select("id", "bins"), "id")
    got = x.groupBy("id").agg(
        *(F.count_if(F.coalesce(c, F.lit(True))).alias(f"rule_{k}") for k, c in bad.items()), *(F.count_if(F.col("eligible") & (fg == v)).alias(f"have_{name}") for name, v in (("foreground", 1), ("background", 0)))
    )
    t = tiles.join(markers, "id", "left").join(got, "id", "left").fillna(0, [f"rule_{k}" for k in bad] + ["have_foreground", "have_background"])
    counts = [(F.col(f"have_{k}") != F.coalesce(F.col(k), F.lit(0))).cast("long") for k in ("foreground", "background")]
    state = F.coalesce("state", F.lit("missing"))
    rules = {**{k: F.col(f"rule_{k}") for k in bad}, "counts": counts[0] + counts[1], "state": (~state.isin("prepared", "empty") | ((state == "empty") != (F.col("records") == 0))).cast("long")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), c.cast("long").alias("n")) for k, c in rules.items()))).alias("r")
    return t.select("id", each).select("id", "r.rule", "r.n").filter("n > 0")


def mismatched(df: DataFrame, fingerprint: str) -> DataFrame:
    """Parts (id, fingerprint) that were prepared under another schema, gene order or dictionary."""
    return df.filter(~F.col("fingerprint").eqNullSafe(F.lit(fingerprint)))


def require_fingerprint(df: DataFrame, fingerprint: str) -> None:
    if bad := mismatched(df, fingerprint).limit(5).collect():
        raise ValueError(f"prepared under another schema: {bad}")


def validate_predictions(pred: DataFrame, centres: DataFrame) -> DataFrame:
    """Rules broken by predictions (x, y, p, logits) of the given centres; with a column model, its fingerprint, also by how many models beyond one."""
    p = pred.withColumn("_p", F.lit(1)).join(centres.select("x", "y", F.lit(1).alias("_c")), ["x", "y"], "full_outer")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    have = F.col("_p").isNotNull()
    return p.agg(
        F.count_if(~have).alias("missing"),
        F.count_if(F.col("_c").isNull()).alias("extra"),
        F.count_if(have & ~F.coalesce(fine(F.col("p")) & (F.size("logits") == 16) & F.forall("logits", fine), F.lit(False))).alias("not_finite"),
        F.count_if(have & ((F.col("p") < 0) | (F.col("p") > 1))).alias("outside"),
        *([F.greatest(F.count_distinct(F.when(have, F.coalesce(F.col("model").cast("string"), F.lit("")))) - 1, F.lit(0)).alias("more_models")] if "model" in pred.columns else []),
    )


def reconcile(report: DataFrame, recomputed: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows on which two tables of the same figure differ; none are expected."""
    a, b = report.select(*key, F.col(value).alias("reported")), recomputed.select(*key, F.col(value).alias("recomputed"))
    return a.join(b, key, "full_outer").filter(~F.col("reported").eqNullSafe(F.col("recomputed")))


def _states(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """(id, records, state) of all tiles; a tile's most advanced state counts."""
    rank = F.array(*map(F.lit, ("pending", "active", "failed", "empty", "done")))
    s = status.groupBy("id").agg(F.max(F.array_position(rank, F.col("state"))).alias("r"))
    return manifest.select("id", "records").join(s, "id", "left").withColumn("state", F.get(rank, (F.coalesce("r", F.lit(1)) - 1).cast("int")))


def progress(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """Tiles and records by state; a tile's most advanced state counts. status (id, state)."""
    return _states(manifest, status).groupBy("state").agg(F.count("*").alias("tiles"), F.sum("records").cast("long").alias("records"))


def progress_report(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """One row: tiles, tiles with records, completed records and their share, ids of failed and of active tiles, and whether all are done.

    The lists are of tiles, so no longer than the manifest."""
    x, done = _states(manifest, status), F.col("state").isin("done", "empty")
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("id"))))
    total, complete = F.coalesce(F.sum("records"), F.lit(0)).cast("long"), F.coalesce(F.sum(F.when(done, F.col("records"))), F.lit(0)).cast("long")
    return x.agg(
        F.count("*").alias("tiles"),
        F.count_if(F.col("records") > 0).alias("expression_tiles"),
        complete.alias("completed_records"),
        (complete / F.nullif(total, F.lit(0))).alias("record_fraction"),
        ids("failed").alias("failed_tiles"),
        ids("active").alias("active_tiles"),
        (F.count_if(~done) == 0).alias("complete"),
    )
