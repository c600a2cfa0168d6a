"""What a user runs on a slide: schema, preparation, comparison, stitching, gene table."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from slidespark.operators import compare, evaluate, expression, gates, genes, grid, hooks, identity, ranking, slide, spatial
from slidespark.sources import records as sources


class Schema(NamedTuple):
    """Tiles with their split, the chosen genes in order, and one row with the fingerprint of both."""

    tiles: DataFrame
    genes: DataFrame
    fingerprint: DataFrame


def init_schema(records: DataFrame, height: int, width: int, core: int = grid.CORE, halo: int = grid.HALO, size: int = grid.BIN, per_tile: int = 512, top: int = 2000, fraction: float = 0.1, seed: int = 0, least: int = 20) -> Schema:
    """Tiles are split whole (E3); genes are ranked (C16) on at most per_tile interior bins of each train tile."""
    tiles = grid.make_tiles(records.sparkSession, height, width, core, halo)
    tiles = tiles.join(ranking.split_tiles(tiles.select("id"), fraction, seed), "id")
    binned = grid.core_tile(records, core).join(F.broadcast(tiles.filter("split = 'train'").select("id", "ix", "iy", "width", "height")), ["ix", "iy"])  # one row a tile
    inside = grid.interior(F.pmod(F.col("bx") * size, F.lit(core)) + halo, F.pmod(F.col("by_") * size, F.lit(core)) + halo, F.col("width"), F.col("height"), halo, 10 * size)
    bins = ranking.tile_sample(binned.filter(inside).select("id", "bx", "by_").distinct(), ["id"], ["bx", "by_"], per_tile, seed)
    chosen = expression.bin_expression(records).join(bins.select("bx", "by_"), ["bx", "by_"], "left_semi")
    ranked = expression.select_hvg(chosen, bins.count(), top, least).select("gene_id").orderBy("gene_id")
    # one row a tile, and one a chosen gene: both are bounded by the manifest and by top
    text = lambda d, c: d.agg(F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), ",").alias("t"))
    held = text(tiles.filter("split = 'validation'"), "id").withColumnRenamed("t", "v")
    mark = text(ranked, "gene_id").crossJoin(held).select(F.sha2(F.concat_ws("|", F.lit(f"{core}:{halo}:{size}:{seed}"), "t", "v"), 256).alias("fingerprint"))
    return Schema(tiles, ranked, mark)


class Prepared(NamedTuple):
    """Samples (centres with class, direction, split and eligibility), their neighbours and the tokens of their
    neighbourhoods packed in one row a centre, coverage of the genes."""

    samples: DataFrame
    packed_neighbors: DataFrame
    packed_tokens: DataFrame
    coverage: DataFrame

    @property
    def neighbors(self) -> DataFrame:
        """(bx, by_, rank, nx, ny)"""
        return spatial.unpacked_neighbors(self.packed_neighbors)

    @property
    def tokens(self) -> DataFrame:
        """(bx, by_, rank, gene_id, cnt)"""
        return spatial.unpacked_tokens(self.packed_tokens)


def prepare_slide(records: DataFrame, pixels: DataFrame, gene_table: DataFrame, symbols: DataFrame, core: int = grid.CORE, size: int = grid.BIN, n: int = 50, fraction: float = 0.1, seed: int = 0, height: int | None = None, width: int | None = None, only: list[tuple[int, int]] | None = None) -> Prepared:
    """Records to a packed training set; centres are eligible in the interior of their tile, 10 bins from its core's edge.

    records (x, y, bx, by_, gene_id, cnt), pixels (x, y, nucleus_id, stain), gene_table (gene_id, symbol), symbols (symbol).
    With only, tiles (ix, iy), centres are those that these tiles own; the other records serve as neighbours."""
    expr = gates.conserve(records, expression.bin_expression, records=False)
    own = None
    if only is not None:
        own = sources.tile_code(F.floor(F.col("bx") * size / core), F.floor(F.col("by_") * size / core)).isin([ix * sources.SIDE + iy for ix, iy in only])
    # neighbours and tokens are looked up within haloed tiles, each from the bins or counts alone: no table of neighbourhoods is joined
    bins = expr.select("bx", "by_").distinct()
    centres = spatial.ring_centres(bins, n, own=own)
    labelled = spatial.label_candidates(centres, pixels, expression.cell_stats(pixels, "nucleus_id"), size)
    labelled = identity.keep(labelled.withColumn("tile", F.floor(F.col("bx") * size / core) * 100_000 + F.floor(F.col("by_") * size / core)))  # one row a centre, read several times
    split = ranking.split_points(labelled.filter("foreground >= 0"), ["tile", "foreground"], ["bx", "by_"], fraction, seed).select("bx", "by_", "split")
    labelled = spatial.mark_eligible(labelled, height, width, core, size=size, margin=10 * size)
    samples = labelled.join(split, ["bx", "by_"], "left").withColumn("split", F.coalesce("split", F.lit("ignored")))
    used = identity.keep(expr.select("gene_id").distinct())
    mapped = gene_table.join(F.broadcast(used), "gene_id", "left_semi").join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("gene_id", "symbol").distinct()
    counts = expr.join(F.broadcast(mapped), "gene_id", "left")  # a gene dictionary: one row a gene that the slide has
    tokens = spatial.packed_tokens(counts.select("bx", "by_", F.col("symbol").alias("gene_id"), "cnt"), n, own=own)
    return Prepared(samples, spatial.packed_neighbors(bins, n, own=own), tokens, expression.mapping_coverage(records, gene_table, symbols))


class Indexed(NamedTuple):
    """The genes (gene_id, gene, n_records, umis), the slide's bounds, and records and counts by tile of a written index."""

    genes: DataFrame
    bounds: DataFrame
    totals: DataFrame


def index_slide(raw: DataFrame, path: str, core: int = grid.CORE) -> Indexed:
    """P1's first half: raw records (seq, gene, x, y, cnt) with gene ids (A2) into the tile index (A4); it must hold them all."""
    records, found, bounds = sources.ingest_records(raw)
    found = identity.keep(found)  # one row a gene
    records = raw.join(found.select("gene", "gene_id"), "gene").select("gene_id", "x", "y", "cnt")
    totals = sources.write_spatial_index(records, path, core)
    bounds = identity.keep(bounds)
    a, b = bounds.select("records", "umis").first(), totals.agg(F.sum("records").alias("records"), F.sum("umis").alias("umis")).first()
    if a != b:
        raise ValueError(f"not conserved: {a} became {b}")
    return Indexed(found, bounds, totals)


class PreparedTiles(NamedTuple):
    """What prepare_tiles wrote, and the report of its tiles."""

    samples: DataFrame
    neighbors: DataFrame
    tokens: DataFrame
    counts: DataFrame


def prepare_tiles(
    index: str, out: str, tiles: DataFrame, pixels: DataFrame, gene_table: DataFrame, symbols: DataFrame, height: int, width: int, core: int = grid.CORE, halo: int = grid.HALO, size: int = grid.BIN, n: int = 50, fraction: float = 0.1, seed: int = 0, cap: int = 4096, whole: bool = False, strict: bool = False
) -> PreparedTiles:
    """P1 of the given tiles (id, ix, iy, split, ..) of a tile index, written under out, read back, validated (J4) and reported.

    Only the folders of these tiles and of their neighbours are read (A4, D1). Neighbourhoods reach 10 bins, so the halo
    must hold 11; then the samples are those of prepare_slide over the whole slide. strict refuses genes without an
    embedding (D5)."""
    spark = tiles.sparkSession
    if halo < 11 * size:
        raise ValueError("the halo is smaller than the neighbourhoods")
    only = [(r.ix, r.iy) for r in tiles.select("ix", "iy").collect()]  # a run's own list, one row a tile
    region = sources.read_region(spark, index, only, core, halo)
    if strict:
        used = gene_table.join(region.select("gene_id").distinct(), "gene_id", "left_semi")
        spatial.gene_lookup(used.select("gene_id", "symbol"), symbols, strict=True)
    records = grid.to_bin(region, size).select("x", "y", "bx", "by_", "gene_id", "cnt")
    p = prepare_slide(records, pixels, gene_table, symbols, core, size, n, fraction, seed, height, width, only)
    at = lambda c: F.floor(F.col(c) * size / core).cast("long")
    ids = F.broadcast(tiles.select("id", "ix", "iy"))  # one row a tile
    named = lambda d: d.withColumns({"ix": at("bx"), "iy": at("by_")}).join(ids, ["ix", "iy"]).drop("ix", "iy")
    of = lambda v: F.count_if(F.col("eligible") & (F.col("foreground") == v))
    seen = Observation()
    for name, d in (("samples", named(p.samples).observe(seen, of(1).alias("foreground"), of(0).alias("background"))), ("neighbors", named(p.packed_neighbors)), ("tokens", named(p.packed_tokens))):
        d.write.mode("errorifexists").parquet(f"{out}/{name}")
    samples, neighbors, tokens = (spark.read.parquet(f"{out}/{name}") for name in ("samples", "neighbors", "tokens"))

    held = grid.core_only(region.withColumns({"ix": F.floor(F.col("x") / core), "iy": F.floor(F.col("y") / core)}), core).groupBy("ix", "iy").agg(F.count("*").alias("records"))
    known = identity.keep(tiles.join(held, ["ix", "iy"], "left").fillna(0, ["records"]))
    state = F.when(F.col("records") == 0, "empty").otherwise("prepared")
    marks = samples.groupBy("id").agg(of(1).alias("foreground"), of(0).alias("background"))
    known.join(marks, "id", "left").select("id", state.alias("state"), F.coalesce("foreground", F.lit(0)).alias("foreground"), F.coalesce("background", F.lit(0)).alias("background")).write.parquet(f"{out}/markers")
    markers = spark.read.parquet(f"{out}/markers")
    got = markers.agg(F.coalesce(F.sum("foreground"), F.lit(0)).alias("foreground"), F.coalesce(F.sum("background"), F.lit(0)).alias("background")).first().asDict()
    if got != seen.get:
        raise ValueError(f"not conserved: {seen.get} samples were written, {got} are there")

    # Neighbours as places in the grid of the haloed tile
    rows, cols = (F.ceil((F.col(c) + 2 * halo) / size) for c in ("width", "height"))
    place = lambda x, y: ((x - F.floor(F.col("origin_x") / size)) * cols + y - F.floor(F.col("origin_y") / size)).cast("long")
    near = neighbors.join(F.broadcast(tiles.select("id", "width", "height", "origin_x", "origin_y")), "id")
    near = near.select("bx", "by_", F.zip_with("nx", "ny", place).alias("neighbors"))
    checked = samples.withColumns({"x": F.col("bx") * size, "y": F.col("by_") * size, "dx": F.coalesce("dx", F.lit(0.0)), "dy": F.coalesce("dy", F.lit(0.0))}).join(near, ["bx", "by_"], "left")
    if bad := gates.validate_preparation(checked, known.withColumn("bins", rows * cols), markers, n).limit(5).collect():
        raise ValueError(f"preparation breaks its rules: {bad}")

    # A centre counts in every haloed tile of the run that holds it, and once in its own
    copies = spatial.halo_records(samples.select((F.col("bx") * size).alias("x"), (F.col("by_") * size).alias("y"), "foreground", "eligible"), core, halo, F.lit(-(-height // core)), F.lit(-(-width // core)))
    own = (F.floor(F.col("x") / core) == F.col("ix")) & (F.floor(F.col("y") / core) == F.col("iy"))
    copies = copies.join(ids, ["ix", "iy"]).select("id", "foreground", (F.col("eligible") & own).alias("eligible"), own.alias("in_core"))
    return PreparedTiles(samples, spatial.unpacked_neighbors(neighbors), spatial.unpacked_tokens(tokens), slide.point_counts(known.select("id", "split", "records"), markers, copies, cap, whole))


def _large(df: DataFrame) -> DataFrame:
    """df, never to be broadcast: a written table is sized by its compressed files, a small part of its rows in memory."""
    return df.hint("merge")


class Comparison(NamedTuple):
    """The table, one row a method (C30); cross correlations of a's cells with b's (I3), their totals and their summary
    over cells with enough counts (I15); figures of the table that a second count does not confirm (J7), none of which
    are expected."""

    table: DataFrame
    cross: DataFrame
    cross_totals: DataFrame
    cross_summary: DataFrame
    faults: DataFrame


def compare_labelings(
    records: DataFrame, labels: DataFrame, a: str, b: str, n_top: int = 1500, radius: int = 2, seed: int = 0, manual: str | None = None, genes: DataFrame | None = None, shape: tuple[int, int] | None = None
) -> Comparison:
    """Two labelings of one slide compared, with purity (I7) and, given manual labels, transcript IoU.

    Correlations use the genes of C17; counts and medians use all genes and the unassigned records too. Given genes
    (gene_id) and the slide's shape, records first become the common input (A6), counts by spot and gene: unknown genes
    and records outside the slide are errors, and counts are conserved (J1)."""
    molecules = records = _large(identity.keep(records.select("x", "y", "gene_id", "cnt")))
    labels = _large(identity.keep(labels.select(*dict.fromkeys(("x", "y", "nucleus_id", a, b, *([manual] if manual else []))))))
    if genes is not None:
        spots, counts = sources.build_common_input(records, genes, *(shape or (2**31, 2**31)))
        records = _large(identity.keep(counts.join(spots, "spot").select("x", "y", "gene_id", "cnt")))
        gates.assert_conserved(molecules, records, records=False)
    # records with their labels and their spots' sides, which all figures by cell are taken from
    half = ranking.half_sides(labels.filter((F.col(a) > 0) | (F.col(b) > 0) | (F.col("nucleus_id") > 0)).select("x", "y", "nucleus_id", F.col(a).alias("s"), F.col(b).alias("t")), 10, seed)
    found = _large(identity.keep(records.join(half, ["x", "y"])))
    nuclear = identity.keep(found.groupBy(F.col("nucleus_id").alias("nucleus"), "gene_id").agg(F.sum("cnt").cast("long").alias("cnt")))
    chosen = identity.keep(evaluate.common_hvg(nuclear, records.select("gene_id"), n_top))
    some = lambda d: _large(d.join(F.broadcast(chosen.select("gene_id")), "gene_id", "left_semi"))  # noqa: E731  # one row a gene
    use, used = some(records), some(found)
    n_genes = chosen.count()
    rows = []
    for label, c in ((a, "s"), (b, "t")):
        own = lambda d, c=c: d.filter(F.col(c) > 0).withColumn("cell", F.col(c))
        # the join with the centres deals the records by cell
        centre = expression.cell_stats(labels, label).select("cell", F.floor("cx").alias("cx"), F.floor("cy").alias("cy"))
        half = compare.side_correlation(own(used).select("cell", "gene_id", "cnt", "sides").repartition("cell"), n_genes).select("cell", F.col("correlation").alias("random"))
        line = compare.side_correlation(ranking.line_sides(own(used).drop("sides").join(centre, "cell"), 10), n_genes).select("cell", F.col("correlation").alias("directional"))
        cells = expression.cell_metrics(own(found), labels, label).join(half, "cell", "left").join(line, "cell", "left")
        rows.append(cells.withColumns({"dataset": F.lit("slide"), "method": F.lit(label)}))
    purity = evaluate.paired_purity(use, labels, a, b, radius, spots=records.select("x", "y").distinct())
    purity = purity.select(F.lit("slide").alias("dataset"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"purity_{k}").alias("purity")) for k, m in (("a", a), ("b", b))))).alias("p")).select("dataset", "p.*")
    iou = None
    if manual:
        found = molecules.join(labels.filter(F.col(manual) > 0).select("x", "y", F.col(manual).alias("manual"), a, b), ["x", "y"])
        of = lambda m: compare.transcript_iou(found.withColumn("predicted", F.col(m))).select(F.lit("slide").alias("dataset"), F.lit(m).alias("method"), "iou")
        iou = of(a).unionByName(of(b))
    total = records.agg(F.sum("cnt").alias("umis")).withColumn("dataset", F.lit("slide"))
    # one row a cell or nucleus, read several times by the table
    cells = identity.keep(rows[0].unionByName(rows[1]))
    table = evaluate.comparison_table(cells, total, identity.keep(purity), iou and identity.keep(iou))
    best = identity.keep(spatial.best_overlap(labels.select(F.col(a).alias("s"), F.col(b).alias("t"))))  # one row a cell
    matched = used.join(best.select("s", F.col("t").alias("m")), "s", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    cross = identity.keep(compare.relabelled_correlation(matched, n_genes))
    return Comparison(table, cross, compare.cross_totals(labels, a, b), compare.cross_sensitivity(cross), _recheck(table, cells, records, labels, (a, b)))


def _recheck(table: DataFrame, cells: DataFrame, records: DataFrame, labels: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(method, figure, reported, recomputed) where cells and the share assigned, counted again from the records, or the
    means, taken again from the rows by cell, differ by 1e-9 or more."""
    x = records.join(labels.select("x", "y", *methods), ["x", "y"], "left")
    share = lambda m: (F.sum(F.when(F.col(m) > 0, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("assigned_share")
    own = x.groupBy().agg(*(F.struct(share(m), F.count_distinct(F.when(F.col(m) > 0, F.col(m))).alias("cells")).alias(f"of_{i}") for i, m in enumerate(methods)))
    own = own.select(F.explode(F.array(*(F.struct(F.lit(m).alias("method"), f"of_{i}.assigned_share", f"of_{i}.cells") for i, m in enumerate(methods)))).alias("r")).select("r.*")
    big = cells.filter("n_spots > 100").groupBy("method").agg(*((F.sum(c) / F.count(c)).alias(f"{c}_mean") for c in ("random", "directional")))
    figures = ("assigned_share", "cells", "random_mean", "directional_mean")
    long = lambda d: d.select("method", F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.round(F.col(c).cast("double"), 9).alias("value")) for c in figures))).alias("f")).select("method", "f.*")
    return gates.reconcile(long(table), long(own.join(big, "method", "left")), ["method", "figure"], "value")


class Stitched(NamedTuple):
    """The slide's products (H4), its cells with the reason they are removed for (I11), the cells left at other bounds (I12),
    the edges between tiles with whether the union took them (none where identities were given), and the root
    (root_tile, root_label) of each cell."""

    matrix: slide.SlideMatrix
    cells: DataFrame
    sensitivity: DataFrame
    matches: DataFrame | None
    roots: DataFrame


def stitch(
    records: DataFrame,
    labels: DataFrame,
    manifest: DataFrame,
    status: DataFrame,
    edges: DataFrame | None = None,
    identities: DataFrame | None = None,
    core: int = grid.CORE,
    low: int = 50,
    high: int = 5000,
    least: int = 30,
    share: float = 0.5,
    lowers: tuple[int, ...] = (20, 50, 100, 200, 500),
    partial: bool = False,
) -> Stitched:
    """The labels of tiles to the slide's cells by genes, and the QC of its cells.

    labels (tile, x, y, label) of haloed tiles, manifest as of make_tiles, status (id, state, fingerprint), records (x, y,
    gene_id, cnt). Labels of several tiles are one cell by shared identities (tile, label, global_id) (D15) where given;
    else by edges as of H1, which are the matches at the seams (D10, D9) unless given. A cell counts once, by the tile
    whose core owns the pixel. A slide with tiles that are not done is refused unless partial (J2); then only the tiles
    that are done take part. Tiles, core pixels and the identities of a tile are unique, or it is an error (J3)."""
    gates.require_unique(manifest, ["id"])
    if partial:
        labels = labels.join(F.broadcast(status.filter("state = 'done'").select(F.col("id").alias("tile")).distinct()), "tile", "left_semi")  # one row a tile
    else:
        gates.require_complete(manifest, status)
    nodes = labels.filter("label > 0").select("tile", "label").distinct()
    matches = None
    if identities is not None:
        gates.require_unique(identities, ["tile", "label"])
        gates.require_unique(identities.filter("global_id > 0"), ["tile", "global_id"])
        union = identity.keep(identity.shared_union(nodes, identities))
    else:
        edges = identity.keep(slide.seam_matches(labels, manifest, least, share) if edges is None else edges)
        union = identity.keep(identity.reconcile_labels(edges, nodes))
        root = lambda s: union.select(F.col("tile").alias(f"tile_{s}"), F.col("label").alias(f"label_{s}"), F.struct("root_tile", "root_label").alias(f"root_{s}"))
        # two sides whose tiles clash stay apart for good, so an edge was taken if its sides ended in one cell
        matches = edges.join(root("a"), ["tile_a", "label_a"]).join(root("b"), ["tile_b", "label_b"]).select(*edges.columns, (F.col("root_a") == F.col("root_b")).alias("accepted"))
    owned = grid.core_only(labels.join(F.broadcast(manifest.select(F.col("id").alias("tile"), "ix", "iy")), "tile"), core)
    owned = owned.select("tile", "label", "x", "y")
    roots = identity.keep(identity.cell_roots(owned, union))
    cells = _large(identity.keep(identity.global_cells(owned, union, roots)))
    gates.require_unique(cells, ["x", "y"])
    matrix = slide.slide_cell_matrix(grid.core_tile(records, core), cells, core, records)
    return Stitched(matrix, compare.cell_qc(matrix.obs, low, high), compare.qc_sensitivity(matrix.obs, lowers, high), matches, roots)


def gene_table(annotations: DataFrame, summaries: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], normalize: bool = True) -> DataFrame:
    """(symbol, embedding) from annotation records (A7) and summaries (A8) by way of gene texts (G3) and an encoder (L2).

    Aliases that name one gene get its vector (D17)."""
    full = genes.attach_summaries(annotations, summaries)
    texts = full.select("gene_id", F.upper("symbol").alias("symbol")).join(genes.gene_text(full), "gene_id").filter("symbol is not null")
    first = texts.groupBy("symbol").agg(F.min_by("text", "gene_id").alias("text"))
    alias = genes.resolve_aliases(annotations.filter("symbol is not null").select(F.col("gene_id").alias("ord"), F.upper("symbol").alias("symbol"), "synonyms"))
    return hooks.encode_genes(first, load, normalize, alias)


class GeneVectors(NamedTuple):
    """(symbol, embedding), and the slide's genes with the number of their vector, -1 for none."""

    vectors: DataFrame
    lookup: DataFrame


def gene_vectors(annotations: DataFrame, summaries: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], slide_genes: DataFrame, normalize: bool = True, strict: bool = False) -> GeneVectors:
    """P4 whole: gene_table encoded once and written, read back and validated (A9), then looked up for slide_genes (gene_id, symbol).

    Symbols are compared in upper case; strict refuses genes without a vector."""
    made = identity.keep(gene_table(annotations, summaries, load, normalize))
    vectors = sources.load_embeddings(made.withColumn("seq", F.lit(0)))
    genes = slide_genes.select("gene_id", F.upper("symbol").alias("symbol"))
    return GeneVectors(vectors, spatial.gene_lookup(genes, vectors, strict))


__all__ = ["Comparison", "GeneVectors", "Indexed", "Prepared", "PreparedTiles", "Schema", "Stitched", "compare_labelings", "gene_table", "gene_vectors", "index_slide", "init_schema", "prepare_slide", "prepare_tiles", "stitch"]
