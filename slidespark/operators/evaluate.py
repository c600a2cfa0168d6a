"""Paired comparison of two labelings: gene choice, consistency, purity, mask overlap, the comparison table."""

from __future__ import annotations

from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidespark.functions.quantile import exact_quantile, grouped_quantiles

from . import spatial
from .compare import pair_by_nucleus
from .expression import fano_of_sums, metric_summary, pearson, select_hvg
from .identity import components, keep


def common_hvg(nuclear: DataFrame, genes: DataFrame, n_top: int = 1500, least: int = 1) -> DataFrame:
    """C17: (gene_id, rule): the genes both labelings are evaluated on.

    nuclear (nucleus, gene_id, cnt), genes (gene_id) all measured. Fewer than two genes in nuclei: all measured genes;
    n_top or fewer, or under three nuclei: all genes in nuclei; else the n_top most dispersed (C16) over nuclei."""
    kept = nuclear.filter("cnt > 0 and nucleus > 0")
    size = kept.agg(F.countDistinct("gene_id").alias("g"), F.countDistinct("nucleus").alias("n")).first()
    if size.g < 2:
        return genes.select("gene_id").distinct().withColumn("rule", F.lit("all measured genes"))
    if size.g <= n_top or size.n < 3:
        return kept.select("gene_id").distinct().withColumn("rule", F.lit("all nucleus-expressed genes"))
    return select_hvg(kept, size.n, n_top, least).select("gene_id", F.lit("most dispersed over nuclei").alias("rule"))


def paired_consistency(records: DataFrame, labels: DataFrame, a: str, b: str, n_genes: int, excluded: DataFrame | None = None, least: int = 100) -> DataFrame:
    """I4: per nucleus with a cell in both labelings the correlation of the shared region with each cell's own region.

    records (x, y, gene_id, cnt), labels (x, y, nucleus_id, a, b). Nuclei need ``least`` counts in all three regions.
    With excluded (gene_id) the correlations are repeated without those genes. Zero variance correlates 0."""
    pairs = pair_by_nucleus(labels, a, b).select("nucleus", F.col("a").alias("pa"), F.col("b").alias("pb"))
    x = records.join(labels.select("x", "y", F.col(a).alias("ca"), F.col(b).alias("cb")), ["x", "y"])
    x = keep(x.groupBy("ca", "cb", "gene_id").agg(F.sum("cnt").cast("long").alias("cnt")))  # one row a pair of labels and gene, read three times
    cell = lambda c: x.filter(F.col(c) > 0).groupBy(c, "gene_id").agg(F.sum("cnt").cast("long").alias("cnt"))
    kind = lambda d, k: d.select("pa", "pb", "gene_id", *(F.col("cnt" if i == k else "_0").alias(n) for i, n in enumerate(("both", "all_a", "all_b"))))
    of = pairs.select("pa", "pb").distinct()
    zero = lambda d: d.withColumn("_0", F.lit(0).cast("long"))
    shared = kind(zero(of.join(x.withColumnsRenamed({"ca": "pa", "cb": "pb"}), ["pa", "pb"])), 0)
    in_a = kind(zero(of.join(cell("ca").withColumnRenamed("ca", "pa"), "pa")), 1)
    in_b = kind(zero(of.join(cell("cb").withColumnRenamed("cb", "pb"), "pb")), 2)
    g = shared.unionByName(in_a).unionByName(in_b).groupBy("pa", "pb", "gene_id").agg(*(F.sum(c).alias(c) for c in ("both", "all_a", "all_b")))
    g = g.select("pa", "pb", "gene_id", F.col("both").alias("o"), (F.col("all_a") - F.col("both")).alias("a"), (F.col("all_b") - F.col("both")).alias("b"))
    sums = {"so": "o", "sa": "a", "sb": "b", "soo": "o*o", "saa": "a*a", "sbb": "b*b", "soa": "o*a", "sob": "o*b"}
    r = lambda p, n, s: pearson(n, *(F.col(p + k) for k in ("so", f"s{s}", "soo", f"s{s}{s}", f"so{s}")), undefined=0.0)
    every = [F.sum(F.expr(e)).cast("long").alias(k) for k, e in sums.items()]
    rest, left = [], n_genes
    if excluded is not None:
        g = g.join(excluded.select("gene_id", F.lit(1).alias("_x")).distinct(), "gene_id", "left")
        rest = [F.sum(F.when(F.col("_x").isNull(), F.expr(e)).otherwise(0)).cast("long").alias(f"r{k}") for k, e in sums.items()]
        left = n_genes - excluded.select("gene_id").distinct().count()
    s = g.groupBy("pa", "pb").agg(*every, *rest).filter(F.least("so", "sa", "sb") >= least)
    cols = [r("", n_genes, "a").alias("correlation_a"), r("", n_genes, "b").alias("correlation_b")]
    if rest:
        cols += [r("r", left, "a").alias("rest_correlation_a"), r("r", left, "b").alias("rest_correlation_b")]
    out = s.select("pa", "pb", F.col("so").alias("umis_shared"), F.col("sa").alias("umis_a"), F.col("sb").alias("umis_b"), *cols)
    return pairs.join(out, ["pa", "pb"]).withColumnsRenamed({"pa": "cell_a", "pb": "cell_b"})


def consistency_summary(rows: DataFrame) -> DataFrame:
    """I4: nuclei, unique pairs, mean correlations and the mean paired difference a - b."""
    return rows.agg(
        F.count("*").alias("nuclei"),
        F.countDistinct("cell_a", "cell_b").alias("unique_pairs"),
        F.avg("correlation_a").alias("mean_a"),
        F.avg("correlation_b").alias("mean_b"),
        F.avg(F.col("correlation_a") - F.col("correlation_b")).alias("difference"),
    )


def paired_purity(records: DataFrame, labels: DataFrame, a: str, b: str, radius: int, half: int = 20, more_than: int = 100, spots: DataFrame | None = None) -> DataFrame:
    """Per nucleus with a cell in both labelings the cells' median Fano factor over that of the window around the nucleus.

    Expression is enhanced by the inverse-square kernel first (D11). Both cells and the window need more than
    ``more_than`` observed spots; undefined or zero windows give no row. spots (x, y) are the observed ones, where
    records hold some genes only."""
    spots = records.select("x", "y").distinct() if spots is None else spots
    lab = keep(spots.join(labels.select("x", "y", "nucleus_id", a, b), ["x", "y"], "left"))  # one row a spot, read several times
    pairs = keep(pair_by_nucleus(lab, a, b).select("nucleus", "a", "b"))  # one row a nucleus, read several times
    n = F.count("*")
    centres = labels.filter("nucleus_id > 0").groupBy(F.col("nucleus_id").alias("cell")).agg((F.sum("x") / n).alias("cx"), (F.sum("y") / n).alias("cy"))
    window = spatial.window_members(centres.join(pairs.select(F.col("nucleus").alias("cell")), "cell"), lab.select("x", "y"), half)
    # all three kinds of groups together, told apart by the remainder, so that the enhanced counts are made once
    group = lambda d, c, kind: d.select((F.col(c).cast("long") * 3 + kind).alias("grp"), "x", "y")
    members = keep(group(lab.filter(F.col(a) > 0), a, 0).unionByName(group(lab.filter(F.col(b) > 0), b, 1)).unionByName(group(window, "cell", 2)))
    sums = spatial.enhanced_sums(records, members, radius)
    rows = keep(fano_of_sums(members.groupBy("grp").agg(F.count("*").alias("n")), sums))  # one row a cell or nucleus
    x = pairs
    for k, (key, kind) in enumerate((("a", "a"), ("b", "b"), ("nucleus", "window"))):
        x = x.join(rows.filter(F.col("grp") % 3 == k).select(F.expr("grp div 3").alias(key), F.col("n").alias(f"spots_{kind}"), F.col("fano").alias(f"fano_{kind}")), key)
    x = x.filter((F.least("spots_a", "spots_b", "spots_window") > more_than) & (F.col("fano_window") > 0) & F.col("fano_a").isNotNull() & F.col("fano_b").isNotNull())
    return x.select("nucleus", F.col("a").alias("cell_a"), F.col("b").alias("cell_b"), "spots_a", "spots_b", "spots_window", (F.col("fano_a") / F.col("fano_window")).alias("purity_a"), (F.col("fano_b") / F.col("fano_window")).alias("purity_b"))


def _assign(frame: pd.DataFrame) -> pd.DataFrame:
    """One overlap component: the one-to-one choice of greatest total IoU, by shortest augmenting paths over its edges alone."""
    near: dict[int, list[tuple[int, float]]] = {}
    for s, t, iou in zip(frame["s"].tolist(), frame["t"].tolist(), frame["iou"].tolist(), strict=True):
        near.setdefault(s, []).append((t, iou))
    u: dict[int, float] = {s: max(w for _, w in e) for s, e in near.items()}  # u[s] + v[t] >= iou, equal on the chosen pairs
    v: dict[int, float] = {t: 0.0 for t in frame["t"].tolist()}
    of_s: dict[int, tuple[int, float]] = {}
    of_t: dict[int, int] = {}
    for root in near:
        # the cheapest way to an unmatched t, or to a matched s that is left alone instead (cost u[s], for a value of 0)
        far, heap, via, done = {root: 0.0}, [(0.0, 0, root)], {}, {}
        end, best = root, u[root]
        ends_at_t = False
        while heap and heap[0][0] < best:
            d, kind, k = heappop(heap)
            if (kind, k) in done:
                continue
            done[kind, k] = d
            if kind:  # a t
                if k not in of_t:
                    end, best, ends_at_t = k, d, True
                    break
                heappush(heap, (d, 0, of_t[k]))
                continue
            if d + u[k] < best:
                end, best, ends_at_t = k, d + u[k], False
            for t, w in near[k]:
                step = d + max(u[k] + v[t] - w, 0.0)
                if step < best and step < via.get(t, (np.inf,))[0]:
                    via[t] = (step, k, w)
                    heappush(heap, (step, 1, t))
        for (kind, k), d in done.items():
            if d < best:
                if kind:
                    v[k] += best - d
                else:
                    u[k] -= best - d
        t = end if ends_at_t else of_s.pop(end, (None, 0.0))[0]
        if not ends_at_t and end != root:
            of_t.pop(t)
        while t is not None:
            _, s, w = via[t]
            before = of_s.get(s)
            of_s[s], of_t[t] = (t, w), s
            t = before[0] if before else None
    hit = [(s, t, w) for s, (t, w) in of_s.items() if w > 0]
    return pd.DataFrame(hit, columns=["s", "t", "iou"]).astype({"s": "int64", "t": "int64", "iou": "float64"})


def _settled(edges: DataFrame) -> DataFrame:
    """Edges (s, t, iou) that a best one-to-one choice holds for sure: none of s and t could gain more together by other partners."""
    best = lambda c, o: edges.groupBy(c).agg(F.max(F.struct("iou", (-F.col(o)).alias("o"))).alias("b"))
    x = edges
    for c, o in (("s", "t"), ("t", "s")):
        x = x.join(best(c, o).select(c, (-F.col("b.o")).alias(f"best_{c}")), c)
    rest = lambda c, o: x.filter(F.col(o) != F.col(f"best_{c}")).groupBy(c).agg(F.max("iou").alias(f"rest_{c}"))
    pair = x.filter((F.col("best_s") == F.col("t")) & (F.col("best_t") == F.col("s"))).select("s", "t", "iou")
    pair = pair.join(rest("s", "t"), "s", "left").join(rest("t", "s"), "t", "left").fillna(0.0, ["rest_s", "rest_t"])
    return pair.filter(F.col("iou") >= F.col("rest_s") + F.col("rest_t")).select("s", "t", "iou")


def best_pairs(edges: DataFrame) -> DataFrame:
    """(s, t, iou): of edges (s, t, iou) the one-to-one choice of greatest total IoU.

    In rounds, pairs that no exchange can better are taken and their partners' other edges leave, which breaks chains of
    touching cells into short ones. When a round settles none, each component left is solved in a task over its edges."""
    left, taken = keep(edges), []
    while True:
        pairs = keep(_settled(left))
        if pairs.isEmpty():
            break
        taken.append(pairs)
        left = keep(left.join(pairs.select("s"), "s", "left_anti").join(pairs.select("t"), "t", "left_anti"))
    if not left.isEmpty():
        node = lambda kind, c: F.struct(F.lit(kind).alias("k"), F.col(c).alias("i"))
        comp = components(left.select(node(0, "s").alias("a"), node(1, "t").alias("b"))).filter("key.k = 0").select(F.col("key.i").alias("s"), "root")
        taken.append(left.join(comp, "s").select("root", "s", "t", "iou").groupBy("root").applyInPandas(_assign, "s long, t long, iou double"))
    return reduce(DataFrame.unionByName, taken) if taken else left


def instance_iou(pixels: DataFrame, ignore: Column | None = None) -> DataFrame:
    """(gt, predicted, iou) of every annotated cell under the one-to-one match of greatest total IoU; 0 where missed.

    pixels (gt, predicted), 0 for none, one row a pixel; ignored pixels are void."""
    p = pixels.filter(~ignore) if ignore is not None else pixels
    n = keep(p.filter("gt > 0 or predicted > 0").groupBy("gt", "predicted").agg(F.count("*").alias("n")))  # one row a pair, read several times
    area = lambda c, name: n.filter(F.col(c) > 0).groupBy(c).agg(F.sum("n").alias(name))
    both = n.filter("gt > 0 and predicted > 0").join(area("gt", "na"), "gt").join(area("predicted", "nb"), "predicted")
    both = both.select(F.col("gt").cast("long").alias("s"), F.col("predicted").cast("long").alias("t"), (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("iou"))
    matched = best_pairs(both)
    return n.filter("gt > 0").select("gt").distinct().join(matched.withColumnRenamed("s", "gt"), "gt", "left").select("gt", F.col("t").alias("predicted"), F.coalesce("iou", F.lit(0.0)).alias("iou"))


def instance_summary(per_cell: DataFrame) -> DataFrame:
    """Mean and median IoU over all annotated cells, and the share at 0.5 or more."""
    x = per_cell.agg(F.count("*").alias("annotated_cells"), F.avg("iou").alias("mean_iou"), F.avg((F.col("iou") >= 0.5).cast("double")).alias("recall50"))
    return x.crossJoin(exact_quantile(per_cell, F.col("iou"), 0.5, "median_iou")).select("annotated_cells", "mean_iou", "median_iou", "recall50")  # one row each


def evaluation_gene_audit(chosen: DataFrame, mapped: DataFrame, patches: DataFrame) -> DataFrame:
    """Share of (patch, gene) choices that map, and share of counts in patches whose gene choice fell back.

    chosen (patch, gene_id), mapped (gene_id), patches (patch, umis, fallback)."""
    hit = chosen.join(mapped.select("gene_id").distinct().withColumn("_m", F.lit(1)), "gene_id", "left")
    a = hit.agg((F.count("_m") / F.nullif(F.count("*"), F.lit(0))).alias("mapped_share"))
    b = patches.agg((F.sum(F.when(F.col("fallback"), F.col("umis")).otherwise(0)) / F.nullif(F.sum("umis"), F.lit(0))).alias("fallback_share"))
    return a.crossJoin(b)  # one row each


def evaluation_gene_patches(chosen: DataFrame, mapped: DataFrame) -> DataFrame:
    """(patch, genes, mapped, mapped_share): the share of each patch's chosen genes that map. chosen (patch, gene_id)."""
    hit = chosen.select("patch", "gene_id").join(mapped.select("gene_id").distinct().withColumn("_m", F.lit(1)), "gene_id", "left")
    x = hit.groupBy("patch").agg(F.count("*").alias("genes"), F.count("_m").alias("mapped"))
    return x.withColumn("mapped_share", F.col("mapped") / F.col("genes"))


def comparison_table(cells: DataFrame, source_umis: DataFrame, purity: DataFrame | None = None, iou: DataFrame | None = None, more_than: int = 100) -> DataFrame:
    """One row a (dataset, method): cells, share of counts assigned, medians, mean correlations of cells with enough spots.

    cells (dataset, method, n_spots, n_umis, n_genes, random, directional), source_umis (dataset, umis) with the
    unassigned ones; purity (dataset, method, purity) and iou (dataset, method, iou) where there are any."""
    key = ["dataset", "method"]
    big = F.col("n_spots") > more_than
    x = cells.groupBy(*key).agg(
        F.count("*").alias("cells"),
        F.sum("n_umis").alias("_umis"),
        *(f(F.when(big, F.col(c))).alias(f"{c}_{n}") for c in ("random", "directional") for f, n in ((F.count, "n"), (F.avg, "mean"))),
    )
    median = lambda d, names: grouped_quantiles(d, key, names, [0.5]).select(*key, *(F.get(n, F.lit(0)).alias(n) for n in names))
    x = x.join(median(cells, {f"median_{c[2:]}": F.col(c) for c in ("n_umis", "n_genes", "n_spots")}), key)
    x = x.join(source_umis, "dataset").withColumn("assigned_share", F.col("_umis") / F.col("umis")).drop("_umis", "umis")
    for d, c in ((purity, "purity"), (iou, "iou")):
        if d is not None:
            x = x.join(d.groupBy(*key).agg(F.avg(c).alias(f"{c}_mean")).join(median(d, {f"{c}_median": F.col(c)}), key), key, "left")
    return x


__all__ = ["common_hvg", "comparison_table", "consistency_summary", "evaluation_gene_audit", "evaluation_gene_patches", "instance_iou", "instance_summary", "metric_summary", "paired_consistency", "paired_purity"]
