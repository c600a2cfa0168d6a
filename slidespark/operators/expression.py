"""Counts of genes by bin, label and cell, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidespark.functions import scalars as S
from slidespark.functions.quantile import exact_quantile, exact_quantiles

from .identity import keep


def bin_expression(records: DataFrame, keys: tuple[str, ...] = ("bx", "by_")) -> DataFrame:
    """Counts by bin and gene, map-side combined; zero sums are dropped."""
    return records.groupBy(*keys, "gene_id").agg(F.sum("cnt").cast("long").alias("cnt")).filter("cnt <> 0")


def pixel_umi(records: DataFrame) -> DataFrame:
    """C2."""
    return records.groupBy("x", "y").agg(F.sum("cnt").cast("long").alias("umi"))


def bin_stats(expr: DataFrame) -> DataFrame:
    """Non-zero genes and counts of every occupied bin."""
    return expr.groupBy("bx", "by_").agg(F.count("*").alias("nnz"), F.sum("cnt").cast("long").alias("umi"))


def merge_symbols(expr: DataFrame, lookup: DataFrame) -> DataFrame:
    """C4: several genes of one symbol become one column; lookup (gene_id, symbol)."""
    return expr.join(lookup, "gene_id").groupBy("bx", "by_", "symbol").agg(F.sum("cnt").cast("long").alias("cnt"))


def label_expression(records: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Counts by label and gene; label 0 is unassigned and stays in the table."""
    x = records.join(labels.select("x", "y", F.col(label).alias("label")), ["x", "y"], "left")
    return x.groupBy(F.coalesce("label", F.lit(0)).cast("long").alias("label"), "gene_id").agg(F.sum("cnt").cast("long").alias("cnt"))


def cell_stats(pixels: DataFrame, label: str) -> DataFrame:
    """Area and centroid of every label."""
    n = F.count("*")
    return pixels.filter(F.col(label) > 0).groupBy(F.col(label).alias("cell")).agg(n.alias("area"), (F.sum("x") / n).alias("cx"), (F.sum("y") / n).alias("cy"))


def cell_qc_metrics(records: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Spots, UMIs and detected genes of every cell."""
    return cell_metrics(records.join(labels.filter(F.col(label) > 0).select("x", "y", F.col(label).alias("cell")), ["x", "y"]), labels, label)


def cell_metrics(found: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """C8 of records that have their cell: found (cell, gene_id, cnt)."""
    x = found.select("cell", "gene_id", "cnt").repartition("cell")  # narrow rows; both groupings are made there
    genes = x.groupBy("cell", "gene_id").agg(F.sum("cnt").alias("cnt")).groupBy("cell").agg(F.sum("cnt").cast("long").alias("n_umis"), F.count("*").alias("n_genes"))
    spots = labels.filter(F.col(label) > 0).groupBy(F.col(label).alias("cell")).agg(F.count("*").alias("n_spots"))
    return spots.join(genes, "cell", "left").select("cell", "n_spots", F.coalesce("n_umis", F.lit(0)).alias("n_umis"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


def metric_summary(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Number, mean and median of the finite values of eligible rows."""
    c = F.col(col).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (where if where is not None else F.lit(True))
    v = F.when(ok, c)
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean")).crossJoin(exact_quantile(df, v, 0.5, "median"))  # one row each


NINE = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def quantiles(df: DataFrame, col: str, shares: tuple[float, ...] = NINE) -> DataFrame:
    """Exact, linearly interpolated quantiles, one row a share."""
    x = exact_quantiles(df, F.col(col), list(shares), "v")
    return x.select(F.posexplode("v").alias("i", "value")).select(F.get(F.array(*map(F.lit, shares)), F.col("i")).alias("share"), "value")


def quantile_summary(df: DataFrame, col: str) -> DataFrame:
    """One row: p10, p50, p90, mean, min and max."""
    q = exact_quantiles(df, F.col(col), [0.1, 0.5, 0.9], "q").select(*(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))
    return q.crossJoin(df.agg(F.avg(col).alias("mean"), F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max")))  # one row each


def pearson(n: Column | int, a: Column, b: Column, aa: Column, bb: Column, ab: Column, undefined: float | None = None) -> Column:
    """C11: correlation from five sums over n columns; undefined where a side has no variance."""
    n = F.lit(n) if not isinstance(n, Column) else n
    num = n * ab - a * b
    den = F.sqrt((n * aa - a * a).cast("double")) * F.sqrt((n * bb - b * b).cast("double"))
    return F.when(den <= 1e-12, F.lit(undefined).cast("double")).otherwise(S.clip(num / den, -1.0, 1.0))


def row_pearson(a: DataFrame, b: DataFrame, n_genes: int, key: tuple[str, ...] = ("cell",), undefined: float | None = None) -> DataFrame:
    """C11: correlation of rows key of two sparse tables (key, gene_id, cnt) over a universe of n_genes columns."""
    side = lambda d, x, y: d.select(*key, "gene_id", F.col("cnt").alias(x), F.lit(0).cast("long").alias(y))
    both = side(a, "a", "b").unionByName(side(b, "b", "a")).groupBy(*key, "gene_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    x = both.groupBy(*key).agg(*(F.sum(e).cast("long").alias(n) for n, e in (("sa", F.col("a")), ("sb", F.col("b")), ("saa", F.col("a") * F.col("a")), ("sbb", F.col("b") * F.col("b")), ("sab", F.col("a") * F.col("b")))))
    return x.select(*key, pearson(n_genes, *map(F.col, ("sa", "sb", "saa", "sbb", "sab")), undefined=undefined).alias("r"))


#: Dimensions summed side by side, and the most vector components that are broadcast (half a gigabyte).
BLOCK, BROADCAST = 32, 1 << 26


def _pooled_blocks(expr: DataFrame, vectors: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, block, nnz, v): the pooled values of BLOCK dimensions a row.

    The narrow records are shuffled by spot, once; vectors of at most BROADCAST components together, which are counted
    first, come to them and are summed in place. Larger ones are joined by gene."""
    fixed = F.transform("embedding", lambda e: F.round(e.cast("double") * 1e6).cast("long"))
    v = vectors.select("gene_id", fixed.alias("v")).filter(F.size("v") > 0)
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / BLOCK).cast("int"))))
    v = v.select("gene_id", "block", F.slice("v", F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("v"))
    x = expr.select(*key, "gene_id", "cnt")
    if (vectors.agg(F.sum(F.size("embedding"))).first()[0] or 0) <= BROADCAST:
        x, v = x.repartition(*key), F.broadcast(v)
    sums = [F.sum(F.col("cnt") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(BLOCK)]
    g = x.join(v, "gene_id").groupBy(*key, "block").agg(F.count("*").alias("nnz"), F.max(F.size("v")).alias("width"), *sums)
    values = F.transform(F.slice(F.array(*(f"s{i}" for i in range(BLOCK))), F.lit(1), F.col("width")), lambda s: s / F.col("nnz") / 1e6)
    return g.select(*key, "block", "nnz", values.alias("v"))


def pool_embeddings(expr: DataFrame, vectors: DataFrame, key: tuple[str, ...] = ("bx", "by_")) -> DataFrame:
    """Per spot and dimension the count-weighted sum of gene vectors over the number of mapped genes.

    vectors (gene_id, embedding); genes with a null or empty vector are not mapped. Sums are fixed point, so they do not
    depend on the order of rows; spots without a mapped gene have no row here and are zero vectors."""
    g = _pooled_blocks(expr, vectors, key).select(*key, "block", "nnz", F.posexplode("v").alias("i", "value"))
    return g.select(*key, (F.col("block") * BLOCK + F.col("i")).cast("long").alias("dim"), "value", "nnz")


def pool_vectors(expr: DataFrame, vectors: DataFrame, key: tuple[str, ...] = ("bx", "by_")) -> DataFrame:
    """C12 as one row a spot: (key, features), the values of pool_embeddings by dimension.

    Only rows of BLOCK dimensions are gathered, so that no row a dimension is sorted, spilled or shuffled."""
    g = _pooled_blocks(expr, vectors, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "v"))).alias("b"))
    return g.select(*key, F.flatten(F.transform("b", lambda b: b["v"])).alias("features"))


def project_and_pool(expr: DataFrame, vectors: DataFrame, weights: list[list[float]], key: tuple[str, ...] = ("bx", "by_")) -> DataFrame:
    """As pool_embeddings, with the gene vectors mapped by weights (out x in) first; equal to mapping the pooled vectors."""
    v = F.col("embedding").cast("array<double>")
    dot = lambda row: F.aggregate(F.zip_with(v, F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pool_embeddings(expr, vectors.select("gene_id", F.array(*map(dot, weights)).alias("embedding")), key)


def embedding_probe(pooled: DataFrame, spots: DataFrame, key: tuple[str, ...] = ("bx", "by_")) -> DataFrame:
    """C14: one row on pooled vectors (key, dim, value, nnz) of all spots (key): norms, spread of the dimensions, mapped genes.

    Spots without a mapped gene have no rows in pooled and count as zero vectors."""
    total = spots.agg(F.count("*").alias("n"))
    per = pooled.groupBy(*key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.max("nnz").alias("nnz"))
    x = spots.select(*key).join(per, list(key), "left").fillna(0, ["norm", "nnz"])
    norms = x.agg(
        F.count("*").alias("spots"),
        *(f("norm").alias(f"norm_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))),
        *(f("nnz").alias(f"genes_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))),
        F.percentile("nnz", F.lit(0.5)).alias("genes_median"),  # held as counts by value, at most one value a gene
        F.count_if(F.col("nnz") == 0).alias("zero_spots"),
    )
    d = pooled.groupBy("dim").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(F.broadcast(total))  # one row
    std = d.select(F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))).alias("std"))
    return norms.crossJoin(std.agg(F.avg("std").alias("dim_std_mean"), F.min("std").alias("dim_std_min"), F.max("std").alias("dim_std_max")))  # one row each


def fano_median(spots: DataFrame, expr: DataFrame) -> DataFrame:
    """Median over expressed genes of sample variance over mean; spots (group, x, y), expr (x, y, gene_id, cnt).

    A group has at most one value a gene, so its median is taken in one task."""
    n = spots.groupBy("grp").agg(F.count("*").alias("n"))
    g = spots.join(expr, ["x", "y"]).groupBy("grp", "gene_id").agg(F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.col("cnt")).alias("q"))
    return fano_of_sums(n, g).drop("n")


def fano_of_sums(n: DataFrame, sums: DataFrame) -> DataFrame:
    """C15 from sums: (grp, n, fano) of n (grp, n) spots a group and sums (grp, gene_id, s, q) of their values and the squares."""
    x = sums.join(n, "grp").filter("n >= 2 and s > 0")
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    fano = x.select("grp", (F.greatest(var, F.lit(0.0)) / (F.col("s") / F.col("n"))).alias("f"))
    return n.join(fano.groupBy("grp").agg(F.percentile("f", F.lit(0.5)).alias("fano")), "grp", "left")


def select_hvg(expr: DataFrame, n_spots: int, top: int = 2000, least: int = 20, bins: int = 20) -> DataFrame:
    """Genes ranked by dispersion within bins of mean expression; expr (spot columns, gene_id, cnt)."""
    g = expr.groupBy("gene_id").agg(F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.col("cnt")).alias("q"), F.count("*").alias("seen"))
    g = g.withColumn("mean", F.col("s") / n_spots).withColumn("var", F.col("q") / n_spots - F.col("mean") * F.col("mean")).filter((F.col("seen") >= least) & (F.col("var") > 0))
    g = g.withColumns({"lm": F.log1p("mean"), "disp": F.log(F.greatest(F.col("var") / F.greatest("mean", F.lit(1e-12)), F.lit(1e-12)))})
    cuts = g.agg(F.percentile("lm", F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("cuts"))
    g = g.crossJoin(F.broadcast(cuts)).withColumn("b", S.quantile_bin(F.col("lm"), F.col("cuts")))  # one row
    w = W.partitionBy("b")
    g = g.withColumn("score", (F.col("disp") - F.avg("disp").over(w)) / F.greatest(F.stddev_pop("disp").over(w), F.lit(1e-8)))
    return g.select("gene_id", "b", "score").orderBy(F.desc(F.round("score", 9)), "gene_id").limit(top)


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Direction accuracy, macro recall, foreground recall, background specificity, balanced accuracy.

    pred (target, predicted, foreground 0/1, p). Undefined shares are null."""
    fg, hit = F.col("foreground") == 1, F.col("target") == F.col("predicted")
    share = lambda c, of: F.sum(F.when(of, c.cast("long"))) / F.nullif(F.sum(of.cast("long")), F.lit(0))
    x = pred.agg(share(hit, fg).alias("direction_accuracy"), share(F.col("p") > 0.5, fg).alias("foreground_recall"), share(F.col("p") <= 0.5, ~fg).alias("background_specificity"))
    rows = pred.filter(fg).groupBy("target").agg((F.sum(hit.cast("long")) / F.count("*")).alias("r"))
    x = x.crossJoin(rows.agg(F.avg("r").alias("macro_recall")))  # one row each
    return x.withColumn("balanced_accuracy", (F.col("foreground_recall") + F.col("background_specificity")) / 2)


def confusion(pred: DataFrame) -> DataFrame:
    """(target, predicted, n) of foreground rows, all 256 cells, empty ones too."""
    k = F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<long>"))
    grid = pred.sparkSession.range(1).select(k.alias("target")).withColumn("predicted", k)
    n = pred.filter("foreground = 1").groupBy("target", "predicted").agg(F.count("*").alias("n"))
    return grid.join(n, ["target", "predicted"], "left").fillna(0, ["n"])


def majority_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Accuracy on test of the most frequent train class, the lowest on ties."""
    top = train.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(1).select(F.col("target").alias("majority"))
    return test.crossJoin(F.broadcast(top)).groupBy("majority").agg(F.count("*").alias("n"), (F.sum((F.col("target") == F.col("majority")).cast("long")) / F.count("*")).alias("accuracy"))


def class_weights(train: DataFrame) -> tuple[float, float]:
    """C20: N / (2 n) of background and foreground rows; 0 for a class without rows."""
    r = train.agg(F.count("*").alias("n"), F.count_if(F.col("foreground") == 1).alias("f")).first()
    return tuple(r.n / (2 * k) if k else 0.0 for k in (r.n - r.f, r.f))


def prediction_loss(pred: DataFrame, weights: tuple[float, float] | None = None) -> DataFrame:
    """C20: mean 16-way cross entropy (foreground rows, over all rows) and binary cross entropy from a logit.

    pred (logits array<double>, target, foreground 0/1, z); weights of background and foreground rows for the binary loss."""
    top = F.array_max("logits")
    lse = top + F.log(F.aggregate("logits", F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    ce = F.when(F.col("foreground") == 1, lse - F.get("logits", F.col("target").cast("int"))).otherwise(0.0)
    bce = F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("foreground") + F.log1p(F.exp(-F.abs("z")))
    if weights:
        bce = bce * F.when(F.col("foreground") == 1, weights[1]).otherwise(weights[0])
    return pred.agg(F.avg(ce).alias("direction_loss"), F.avg(bce).alias("foreground_loss"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """C21."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def depth_stratified_delta(cells: DataFrame) -> DataFrame:
    """Weighted mean difference b - a of a value over log2 depth strata that hold both methods.

    cells (method in a, b; umis; value). Weights are the smaller counts."""
    x = cells.select(S.log2_bin(F.col("umis")).alias("stratum"), "method", F.col("value").cast("double").alias("v"))
    pick = lambda m, f: f(F.when(F.col("method") == m, F.col("v")))
    s = x.groupBy("stratum").agg(pick("a", F.avg).alias("ma"), pick("b", F.avg).alias("mb"), pick("a", F.count).alias("na"), pick("b", F.count).alias("nb")).filter("na > 0 and nb > 0")
    w = F.least("na", "nb")
    return s.agg(F.count("*").alias("strata"), (F.sum(w * (F.col("mb") - F.col("ma"))) / F.sum(w)).alias("delta"))


def block_mean(pixels: DataFrame, factor: int, height: Column, width: Column) -> DataFrame:
    """Means of factor x factor blocks; the last row and column repeat into the padding. pixels (x, y, value), dense."""
    pad = lambda c, size: F.when(c == size - 1, F.pmod(-size, F.lit(factor)) + 1).otherwise(1)
    w = pad(F.col("x"), height) * pad(F.col("y"), width)
    x = pixels.select(F.floor(F.col("x") / factor).cast("long").alias("bx"), F.floor(F.col("y") / factor).cast("long").alias("by_"), (F.col("value") * w).alias("v"))
    return x.groupBy("bx", "by_").agg((F.sum("v") / (factor * factor)).alias("value"))


def densest_window(records: DataFrame, patch: int, coarse: int) -> DataFrame:
    """The first window of patch pixels with most counts, windows starting at coarse cells inside the slide."""
    k = patch // coarse
    c = records.groupBy(F.floor(F.col("x") / coarse).cast("long").alias("cx"), F.floor(F.col("y") / coarse).cast("long").alias("cy")).agg(F.sum("cnt").alias("n"))
    size = c.agg((F.max("cx") - k + 1).alias("mx"), (F.max("cy") - k + 1).alias("my"))
    step = F.sequence(F.lit(0), F.lit(k - 1))
    w = c.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select((F.col("cx") - F.col("dx")).alias("wx"), (F.col("cy") - F.col("dy")).alias("wy"), "n")
    w = w.crossJoin(F.broadcast(size)).filter("wx >= 0 and wy >= 0 and wx <= mx and wy <= my")  # one row
    w = w.groupBy("wx", "wy").agg(F.sum("n").cast("long").alias("umi"))
    return w.orderBy(F.desc("umi"), "wx", "wy").limit(1)


def mapping_coverage(records: DataFrame, genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Genes, symbols and counts that map; genes (gene_id, symbol), symbols (symbol)."""
    known = genes.join(symbols.select("symbol", F.lit(1).alias("hit")), "symbol", "left")
    umi = records.groupBy("gene_id").agg(F.sum("cnt").cast("long").alias("umi"))
    x = known.join(umi, "gene_id", "left")
    return x.agg(
        F.count("*").alias("source_genes"),
        F.countDistinct("symbol").alias("unique_symbols"),
        F.count("hit").alias("mapped_genes"),
        F.sum(F.coalesce("umi", F.lit(0))).alias("total_umi"),
        F.sum(F.when(F.col("hit") == 1, F.coalesce("umi", F.lit(0))).otherwise(0)).alias("mapped_umi"),
    )


def missing_genes(records: DataFrame, genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(gene_id, symbol, umi) of genes that do not map; the top ones by count are top_k of it."""
    umi = records.groupBy("gene_id").agg(F.sum("cnt").cast("long").alias("umi"))
    x = genes.join(symbols.select("symbol").distinct(), "symbol", "left_anti").join(umi, "gene_id", "left")
    return x.select("gene_id", "symbol", F.coalesce("umi", F.lit(0)).alias("umi"))


def emptied_bins(expr: DataFrame, genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bins, and those in which no gene maps."""
    known = genes.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("gene_id", F.lit(1).alias("hit")).distinct()
    per = expr.join(known, "gene_id", "left").groupBy("bx", "by_").agg(F.count("hit").alias("k"))
    return per.agg(F.count("*").alias("bins"), F.count_if(F.col("k") == 0).alias("emptied"))


def neighborhood_stats(tokens: DataFrame) -> DataFrame:
    """Per centre its own genes, the unique genes and the counts of its neighbourhood; tokens as of D3."""
    return tokens.groupBy("bx", "by_").agg(F.count_if(F.col("rank") == 0).alias("centre_genes"), F.countDistinct("gene_id").alias("genes"), F.sum("cnt").cast("long").alias("umis"))


def context_reach(neighbors: DataFrame, nuclei: DataFrame, size: int = 3, resolution: float = 1.0) -> DataFrame:
    """p50, p90 and p99 of the distance to the farthest neighbour, and of centres outside of any nucleus the share with one among their neighbours.

    neighbors as of D2, nuclei (bx, by_, nucleus_id) by bin."""
    lab = nuclei.filter("nucleus_id > 0").select(F.col("bx").alias("nx"), F.col("by_").alias("ny"), F.lit(1).alias("_n"))
    d2 = (F.col("nx") - F.col("bx")) ** 2 + (F.col("ny") - F.col("by_")) ** 2
    per = neighbors.join(lab, ["nx", "ny"], "left").groupBy("bx", "by_").agg(F.max(d2).alias("d2"), F.count("_n").alias("near"), F.count(F.when(F.col("rank") == 0, F.col("_n"))).alias("own"))
    per = keep(per)  # one row a centre, read several times
    far = F.sqrt("d2") * size * resolution
    outside = F.when(F.col("own") == 0, (F.col("near") > 0).cast("double"))
    q = exact_quantiles(per, far, [0.5, 0.9, 0.99]).select(*(F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate((50, 90, 99))))
    return q.crossJoin(per.agg(F.avg(outside).alias("outside_with_nucleus")))  # one row each


def eligible_patches(patches: DataFrame, eligible: DataFrame) -> DataFrame:
    """Every patch of the manifest with its eligible nuclei and its state; a patch with none stays in all denominators.

    patches (patch), eligible (patch, nucleus_id, eligible)."""
    n = eligible.filter("eligible").groupBy("patch").agg(F.count("*").alias("nuclei"))
    x = patches.select("patch").join(n, "patch", "left").fillna(0, ["nuclei"])
    return x.withColumn("state", F.when(F.col("nuclei") > 0, "ready").otherwise("no_eligible_nuclei"))


def eligible_nuclei(spots: DataFrame, pixels: DataFrame, least: int = 20) -> DataFrame:
    """Nuclei by their observed spots; eligible with enough."""
    x = spots.join(pixels.filter("nucleus_id > 0").select("x", "y", "nucleus_id"), ["x", "y"])
    return x.groupBy("nucleus_id").agg(F.count("*").alias("n_spots")).withColumn("eligible", F.col("n_spots") >= least)
