"""Statistics that compare two labelings of one slide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.functions.quantile import exact_quantile, grouped_quantiles

from .expression import cell_qc_metrics, pearson
from .identity import keep
from .spatial import best_of, best_overlap, kept_counts


def split_correlation(records: DataFrame, sides: DataFrame, n_genes: int, repeats: int = 10) -> DataFrame:
    """Per cell the mean correlation of the two sides over the repeats where it is defined.

    sides (x, y, cell, sides) comes from half_sides or line_sides: bit r is the side in repeat r. All repeats are
    conditional sums of one grouping, so records are joined and shuffled once and not copied."""
    found = records.join(sides, ["x", "y"]).select("cell", "gene_id", "cnt", "sides")
    return side_correlation(found.repartition("cell"), n_genes, repeats)  # narrow rows; both groupings are made there


def side_correlation(found: DataFrame, n_genes: int, repeats: int = 10) -> DataFrame:
    """split_correlation of records that have their cell and sides: found (cell, gene_id, cnt, sides), best dealt by cell."""
    on = lambda r: F.shiftright("sides", r).bitwiseAND(F.lit(1).cast("long"))
    g = found.groupBy("cell", "gene_id").agg(F.sum("cnt").alias("t"), *(F.sum(F.col("cnt") * on(r)).alias(f"a{r}") for r in range(repeats)))
    sums = []
    for r in range(repeats):
        a = F.col(f"a{r}")
        b = F.col("t") - a
        sums += [F.sum(e).cast("long").alias(f"{k}{r}") for k, e in (("sa", a), ("sb", b), ("saa", a * a), ("sbb", b * b), ("sab", a * b))]
    per = g.groupBy("cell").agg(*sums)
    each = F.array(*(pearson(n_genes, *(F.col(f"{k}{r}") for k in ("sa", "sb", "saa", "sbb", "sab"))) for r in range(repeats)))
    r = per.select("cell", F.explode(each).alias("r"))
    return r.groupBy("cell").agg(F.avg("r").alias("correlation"), F.count("r").alias("valid_repeats"))


def cell_consistency(records: DataFrame, labels: DataFrame, label: str, sides: DataFrame, n_genes: int, repeats: int = 10) -> DataFrame:
    """I1 and I2 as reported: every cell's spots, counts and genes with its correlation, null where no repeat defines one."""
    per = split_correlation(records, sides, n_genes, repeats)
    return cell_qc_metrics(records, labels, label).join(per, "cell", "left").fillna(0, ["valid_repeats"])


def cross_totals(labels: DataFrame, source: str, target: str) -> DataFrame:
    """One row: source cells, those with a target, their distinct targets, and how many more sources than targets."""
    lab = labels.select(F.col(source).alias("s"), F.col(target).alias("t"))
    n = kept_counts(lab)
    x = n.filter("s > 0").select("s").distinct().join(best_of(n, "s", "t"), "s", "left")
    x = x.agg(F.count("*").alias("source_cells_total"), F.count("t").alias("source_cells_matched"), F.count_distinct("t").alias("target_cells_matched"))
    return x.withColumn("many_to_one_excess", F.col("source_cells_matched") - F.col("target_cells_matched"))


def cross_correlation(records: DataFrame, labels: DataFrame, source: str, target: str, n_genes: int) -> DataFrame:
    """Source cells relabelled to their best target; correlations of the shared part with each unique part.

    Only targets with all three parts and both correlations defined are kept. A negative unique part, which only negative
    counts can give, is an error."""
    lab = labels.select("x", "y", F.col(source).alias("s"), F.col(target).alias("t"))
    best = best_overlap(lab.select("s", "t")).select("s", F.col("t").alias("m"))
    lab = lab.join(best, "s", "left").select("x", "y", "t", F.coalesce("m", F.lit(0)).alias("m"))
    return relabelled_correlation(records.join(lab, ["x", "y"]), n_genes)


def relabelled_correlation(found: DataFrame, n_genes: int) -> DataFrame:
    """cross_correlation of records that have their labels: found (gene_id, cnt, m, t), m the source's best target or 0."""
    same = (F.col("m") == F.col("t")) & (F.col("t") > 0)
    parts = F.array(
        F.struct(F.when(F.col("m") > 0, F.col("m")).alias("cell"), F.lit(0).cast("long").alias("side")), F.struct(F.when(F.col("t") > 0, F.col("t")).alias("cell"), F.lit(1).cast("long").alias("side"))
    )
    long = found.select("gene_id", "cnt", same.alias("same"), F.explode(parts).alias("p")).filter("p.cell is not null")
    long = long.withColumn("cell", F.col("p.cell")).repartition("cell")  # narrow rows; both groupings are made there
    n = lambda c: F.sum(F.when(c, F.col("cnt")).otherwise(0)).cast("long")
    g = long.groupBy("cell", "gene_id").agg(
        n(F.col("same") & (F.col("p.side") == 1)).alias("o"), n(~F.col("same") & (F.col("p.side") == 0)).alias("a"), n(~F.col("same") & (F.col("p.side") == 1)).alias("b")
    )
    g = g.withColumn("a", F.expr("CASE WHEN least(a, b) < 0 THEN raise_error('negative part of an expression') ELSE a END"))
    sums = {"so": "o", "sa": "a", "sb": "b", "soo": "o*o", "saa": "a*a", "sbb": "b*b", "soa": "o*a", "sob": "o*b"}
    c = g.groupBy("cell").agg(*(F.sum(F.expr(e)).cast("long").alias(k) for k, e in sums.items()))
    c = c.withColumn("ra", pearson(n_genes, *map(F.col, ("so", "sa", "soo", "saa", "soa")))).withColumn("rb", pearson(n_genes, *map(F.col, ("so", "sb", "soo", "sbb", "sob"))))
    c = c.filter("ra is not null and rb is not null and least(so, sa, sb) > 0")
    return c.select(
        "cell",
        F.col("ra").alias("source_correlation"),
        F.col("rb").alias("target_correlation"),
        F.col("so").alias("overlap_umis"),
        F.col("sa").alias("source_unique_umis"),
        F.col("sb").alias("target_unique_umis"),
        (F.least("so", "sa", "sb") >= 100).alias("enough"),
    )


def pair_by_nucleus(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Cells of both labelings that share a nucleus (nucleus, a, b), and how many nuclei give the same pair."""
    # pixels are counted once, by all three labels, for both sides and for the count of pairs
    n = keep(labels.filter("nucleus_id > 0").groupBy(F.col("nucleus_id").alias("s"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")))
    to = lambda c: best_of(n.groupBy("s", F.col(c).alias("t")).agg(F.sum("n").alias("n")), "s", "t").select(F.col("s").alias("nucleus"), F.col("t").alias(c))
    x = keep(to("a").join(to("b"), "nucleus"))  # one row a nucleus
    dup = x.groupBy("a", "b").agg(F.count("*").alias("same_pair"))
    return x.join(dup, ["a", "b"])


def transcript_iou(molecules: DataFrame) -> DataFrame:
    """Per manual cell its mutual best prediction's intersection over union on molecules, 0 where there is none.

    molecules (manual > 0, predicted >= 0)."""
    pairs = molecules.select(F.col("manual").alias("s"), F.col("predicted").alias("t"))
    n = kept_counts(pairs)
    back = best_of(n, "t", "s").select("s", "t", F.lit(True).alias("mutual"))
    na = n.groupBy("s").agg(F.sum("n").alias("na"))
    nb = n.groupBy("t").agg(F.sum("n").alias("nb"))
    x = na.join(best_of(n, "s", "t").join(back, ["s", "t"]).join(nb, "t"), "s", "left")
    iou = F.coalesce(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), F.lit(0.0))
    return x.select(F.col("s").alias("manual"), F.col("t").alias("predicted"), iou.alias("iou"), F.coalesce("mutual", F.lit(False)).alias("mutual"))


def iou_summary(per_cell: DataFrame) -> DataFrame:
    """The summary row of transcript_iou."""
    m = F.when(F.col("mutual"), F.col("iou"))
    x = per_cell.agg(
        F.count("*").alias("manual_cells"), F.count(m).alias("mutual_matches"), F.avg(m).alias("matched_only_mean"), F.avg("iou").alias("all_gt_mean"), (F.sum((F.col("iou") >= 0.5).cast("long")) / F.count("*")).alias("recall50")
    )
    return x.crossJoin(exact_quantile(per_cell, m, 0.5, "matched_only_median")).crossJoin(exact_quantile(per_cell, F.col("iou"), 0.5, "all_gt_median"))  # one row each


def segmentation_quality(records: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """I8: cells, median area, share of counts in cells, share of nuclei with a cell."""
    areas = labels.filter(F.col(label) > 0).groupBy(label).agg(F.count("*").alias("area"))
    a = areas.agg(F.count("*").alias("cells")).crossJoin(exact_quantile(areas, F.col("area"), 0.5, "median_area"))  # one row each
    x = records.join(labels.select("x", "y", F.col(label).alias("c")), ["x", "y"], "left")
    u = x.agg((F.sum(F.when(F.col("c") > 0, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("assigned"))
    n = labels.filter("nucleus_id > 0").groupBy("nucleus_id").agg(F.max((F.col(label) > 0).cast("long")).alias("m")).agg(F.avg("m").alias("nuclei_matched"))
    return a.crossJoin(u).crossJoin(n)  # one row each


def pseudolabel_audit(molecules: DataFrame, candidates: DataFrame, size: int = 3, splits: tuple[str, ...] = ()) -> DataFrame:
    """Shares of manually assigned molecules on positive, background and unknown bins, and on background bins of each split.

    candidates (bx, by_, foreground), with their split where splits are named."""
    x = molecules.select(F.floor(F.col("x") / size).cast("long").alias("bx"), F.floor(F.col("y") / size).cast("long").alias("by_"))
    x = x.join(candidates.select("bx", "by_", "foreground", *(["split"] if splits else [])), ["bx", "by_"], "left").withColumn("f", F.coalesce("foreground", F.lit(-1)))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    each = (share((F.col("f") == 0) & (F.col("split") == s)).alias(f"{s}_background") for s in splits)
    return x.agg(F.count("*").alias("molecules"), *(share(F.col("f") == v).alias(n) for n, v in (("positive", 1), ("background", 0), ("unknown", -1))), *each)


def cutoff_iou(molecules: DataFrame, labels: DataFrame, label: str, cutoffs: list[int]) -> DataFrame:
    """One row a cutoff: share of molecules in cells of that area or more, and I5 under those cells alone.

    molecules (manual, predicted), 0 for none, predicted being the label. Molecules are counted by pair of labels once and
    the small table of pairs is taken for each cutoff; cells under it count as no cell."""
    areas = labels.filter(F.col(label) > 0).groupBy(F.col(label).alias("t")).agg(F.count("*").alias("area"))
    n = molecules.groupBy(F.col("manual").alias("s"), F.col("predicted").alias("t")).agg(F.count("*").alias("n")).join(areas, "t", "left")
    n = n.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)).cast("array<long>")))
    n = keep(n.groupBy("cutoff", "s", F.when(F.col("area") >= F.col("cutoff"), F.col("t")).otherwise(0).alias("t")).agg(F.sum("n").alias("n")))
    assigned = n.groupBy("cutoff").agg((F.sum(F.when(F.col("t") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("assigned_share"))
    manual = n.filter("s > 0")
    size = lambda c, name: manual.groupBy("cutoff", c).agg(F.sum("n").alias(name))
    best = lambda c, o: manual.filter("t > 0").groupBy("cutoff", c).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(o).alias("o"))).alias("b")).select("cutoff", c, F.col("b.o").alias(o), (-F.col("b.m")).alias("n"))
    mutual = best("s", "t").join(best("t", "s").select("cutoff", "s", "t"), ["cutoff", "s", "t"]).join(size("t", "nb"), ["cutoff", "t"])
    x = size("s", "na").join(mutual, ["cutoff", "s"], "left").withColumn("iou", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    x = x.groupBy("cutoff").agg(
        F.count("*").alias("manual_cells"), F.count("iou").alias("mutual_matches"), F.avg("iou").alias("matched_only_mean"), F.avg(F.coalesce("iou", F.lit(0.0))).alias("all_gt_mean"), F.avg((F.coalesce("iou", F.lit(0.0)) >= 0.5).cast("double")).alias("recall50")
    )
    return assigned.join(x, "cutoff", "left")


def size_sensitivity(labels: DataFrame, label: str, cutoffs: list[int]) -> DataFrame:
    """Cells and labelled pixels left at each area cutoff; areas are counted once."""
    areas = labels.filter(F.col(label) > 0).groupBy(label).agg(F.count("*").alias("area"))
    x = areas.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)).cast("array<long>")))
    ok = F.col("area") >= F.col("cutoff")
    return x.groupBy("cutoff").agg(F.sum(ok.cast("long")).alias("cells"), F.sum(F.when(ok, F.col("area")).otherwise(0)).alias("pixels"))


def cell_qc(cells: DataFrame, low: int = 50, high: int = 5000) -> DataFrame:
    """Cells (cell, n_umis, n_genes) with the reason they are removed for, or kept."""
    return cells.withColumn("reason", F.when(F.col("n_genes") < low, "few_genes").when(F.col("n_genes") > high, "many_genes").otherwise("kept"))


def qc_summary(cells: DataFrame) -> DataFrame:
    """Cells and counts by reason."""
    return cells.groupBy("reason").agg(F.count("*").alias("cells"), F.sum("n_umis").cast("long").alias("umis"))


def mitochondrial(records: DataFrame, labels: DataFrame, label: str, genes: DataFrame, prefix: str = "MT-") -> DataFrame:
    """(cell, mt_umis, mt_percent) of cells with counts; mt_percent is null where no gene's symbol has the prefix. genes (gene_id, symbol)."""
    mt = genes.filter(F.upper("symbol").startswith(prefix)).select("gene_id").distinct().withColumn("mt", F.lit(1))
    x = records.join(labels.filter(F.col(label) > 0).select("x", "y", F.col(label).alias("cell")), ["x", "y"]).join(mt, "gene_id", "left")
    x = x.groupBy("cell").agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("mt") == 1, F.col("cnt")).otherwise(0)).cast("long").alias("mt_umis"))
    x = x.crossJoin(F.broadcast(mt.agg((F.count("*") > 0).alias("any"))))  # one row
    return x.select("cell", "mt_umis", F.when(F.col("any"), 100 * F.col("mt_umis") / F.nullif("n", F.lit(0))).alias("mt_percent"))


def qc_report(cells: DataFrame, slide_umis: DataFrame, low: int = 50, high: int = 5000, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """One row: cells before and after, removed by reason, cells at either bound, counts kept, and quantiles of genes and counts.

    cells (n_umis, n_genes), slide_umis one row (umis) with the unassigned ones; an array a metric, before and after."""
    ok = (F.col("n_genes") >= low) & (F.col("n_genes") <= high)
    n = lambda c, name: F.count_if(c).alias(name)
    x = cells.agg(
        F.count("*").alias("input_cells"),
        n(ok, "retained_cells"),
        n(F.col("n_genes") < low, "removed_few"),
        n(F.col("n_genes") > high, "removed_many"),
        n(F.col("n_genes") == low, "at_low"),
        n(F.col("n_genes") == high, "at_high"),
        F.coalesce(F.sum("n_umis"), F.lit(0)).cast("long").alias("input_umis"),
        F.coalesce(F.sum(F.when(ok, F.col("n_umis"))), F.lit(0)).cast("long").alias("retained_umis"),
    ).crossJoin(F.broadcast(slide_umis.select("umis")))  # one row
    of = lambda by: 100 * F.col("retained_umis") / F.nullif(F.col(by), F.lit(0))
    x = x.withColumns({"retained_percent": of("input_umis"), "retained_percent_of_slide": of("umis")}).drop("umis").withColumn("one", F.lit(1))
    values = {f"{c}_{w}": F.when(o, F.col(f"n_{c}")) for c in ("genes", "umis") for w, o in (("before", F.lit(True)), ("after", ok))}
    return x.join(grouped_quantiles(cells.withColumn("one", F.lit(1)), ["one"], values, list(shares)), "one", "left").drop("one")  # one row each


def qc_sensitivity(cells: DataFrame, lowers: tuple[int, ...] = (20, 50, 100, 200, 500), high: int = 5000) -> DataFrame:
    """Cells and counts kept for each lower bound."""
    x = cells.withColumn("lower", F.explode(F.array(*map(F.lit, lowers)).cast("array<long>")))
    ok = (F.col("n_genes") >= F.col("lower")) & (F.col("n_genes") <= high)
    return x.groupBy("lower").agg(F.sum(ok.cast("long")).alias("cells"), F.sum(F.when(ok, F.col("n_umis")).otherwise(0)).cast("long").alias("umis"))


def mask_unmapped(expr: DataFrame, lookup: DataFrame) -> DataFrame:
    """Counts of mapped genes only; spots and graph are other tables and stay."""
    return expr.join(lookup.filter("embedding_id >= 0").select("gene_id"), "gene_id", "left_semi")


def cross_sensitivity(cross: DataFrame) -> DataFrame:
    """Number and mean difference of cross correlations with enough counts in every part."""
    x = cross.filter("enough")
    return x.agg(F.count("*").alias("n"), F.avg(F.col("target_correlation") - F.col("source_correlation")).alias("difference"))


def orientation_audit(points: DataFrame, roi: DataFrame) -> DataFrame:
    """I16: share of points inside the region for each swap of axes and shift of -1 or 0."""
    variants = F.array(*(F.struct(F.lit(s).alias("swap"), F.lit(d).cast("long").alias("shift")) for s in (False, True) for d in (-1, 0)))
    v = points.select("x", "y", F.explode(variants).alias("v"))
    at = lambda a, b: F.when(F.col("v.swap"), F.col(b)).otherwise(F.col(a)) + F.col("v.shift")
    v = v.select(F.col("v.swap").alias("swap"), F.col("v.shift").alias("shift"), at("x", "y").alias("x"), at("y", "x").alias("y"))
    hit = roi.select("x", "y").distinct().withColumn("hit", F.lit(1))
    return v.join(hit, ["x", "y"], "left").groupBy("swap", "shift").agg(F.count("*").alias("points"), (F.count("hit") / F.count("*")).alias("inside"))

