"""Whole-slide products of tile labels: the cell by gene table, patch exports, seams, tile reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import grid, ranking, spatial
from .expression import cell_stats
from .gates import assert_conserved


class SlideMatrix(NamedTuple):
    """H4: counts (cell, gene_id, cnt); obs, one row a cell; spots (x, y, cell), unassigned ones too; totals, one row."""

    counts: DataFrame
    obs: DataFrame
    spots: DataFrame
    totals: DataFrame


def slide_cell_matrix(haloed: DataFrame, labels: DataFrame, core: int = grid.CORE, source: DataFrame | None = None) -> SlideMatrix:
    """H4: records of haloed tiles (ix, iy, x, y, gene_id, cnt) counted once, by the tile whose core owns them.

    labels (x, y, cell) of the slide. With source, the slide's records, totals must be conserved."""
    own = grid.core_only(haloed, core)
    if source is not None:
        assert_conserved(source, own)
    x = own.join(labels.select("x", "y", F.col("cell").alias("_c")), ["x", "y"], "left").withColumn("cell", F.coalesce("_c", F.lit(0)).cast("long"))
    by_gene = x.groupBy("cell", "gene_id").agg(F.sum("cnt").cast("long").alias("cnt"), F.count("*").alias("n"))
    counts = by_gene.filter("cell > 0").select("cell", "gene_id", "cnt")
    spots = x.groupBy("x", "y").agg(F.max("cell").alias("cell"))
    seen = counts.groupBy("cell").agg(F.sum("cnt").cast("long").alias("n_umis"), F.count("*").alias("n_genes"))
    held = spots.filter("cell > 0").groupBy("cell").agg(F.count("*").alias("n_spots"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    obs = cell_stats(labels, "cell").join(seen, "cell", "left").join(held, "cell", "left").select("cell", "area", "cx", "cy", zero("n_spots"), zero("n_umis"), zero("n_genes"))
    n = by_gene.agg(F.sum("n").cast("long").alias("records"), F.sum("cnt").cast("long").alias("umis"), F.sum(F.when(F.col("cell") > 0, F.col("cnt")).otherwise(0)).cast("long").alias("assigned_umis"))
    s = spots.agg(F.count("*").alias("spots"), F.count_if(F.col("cell") > 0).alias("assigned_spots"))
    return SlideMatrix(counts, obs, spots, n.crossJoin(s))  # one row each


def export_patches(labels: DataFrame, size: int = grid.CORE) -> DataFrame:
    """H5: (px, py, x, y, local_id, cell) in slide coordinates; seams stay open, so a label is a cell of its own in every patch.

    labels (x, y, label). Ids are dense within a patch, and over all patches by the patches' offsets."""
    x = labels.filter("label > 0").withColumns({"px": F.floor(F.col("x") / size).cast("long"), "py": F.floor(F.col("y") / size).cast("long")})
    ids = ranking.compact_labels(x, "label", ["px", "py"])
    return x.join(ids, ["px", "py", "label"]).select("px", "py", "x", "y", "local_id", F.col("global_id").alias("cell"))


def overlap_box(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of tile ids with the rectangle x0 <= x < x1, y0 <= y < y1 that their haloed boxes share."""
    box = lambda s: tiles.select(F.col("id").alias(s), *(e.alias(f"{n}{s}") for n, e in _corners().items()))
    x = pairs.join(box("a"), "a").join(box("b"), "b")
    return x.select("a", "b", F.greatest("x0a", "x0b").alias("x0"), F.greatest("y0a", "y0b").alias("y0"), F.least("x1a", "x1b").alias("x1"), F.least("y1a", "y1b").alias("y1"))


def _corners() -> dict[str, Column]:
    o, s = (lambda c: F.col(f"origin_{c}")), (lambda c: F.col(c) + 2 * F.col("halo"))
    return {"x0": o("x"), "y0": o("y"), "x1": o("x") + s("width"), "y1": o("y") + s("height")}


def seam_pairs(tiles: DataFrame) -> DataFrame:
    """Adjacent tiles (a, b) with the box they share and their number; pairs are numbered by the tiles' rows and columns.

    tiles is the manifest of make_tiles, at most 2^14 tiles a side."""
    at = lambda s: tiles.select(F.col("id").alias(s), F.col("ix").alias(f"ix{s}"), F.col("iy").alias(f"iy{s}"))
    box = overlap_box(tiles, spatial.adjacent_tiles(tiles)).filter("x0 < x1 and y0 < y1").join(at("a"), "a").join(at("b"), "b")
    way = 3 * (F.col("ixb") - F.col("ixa")) + F.col("iyb") - F.col("iya")  # 1 to 4 in the order of the four directions
    return box.select("a", "b", "x0", "y0", "x1", "y1", ((F.col("ixa") * 2**14 + F.col("iya")) * 4 + way - 1).cast("long").alias("pair"))


def seam_matches(labels: DataFrame, tiles: DataFrame, least: int = 30, share: float = 0.5) -> DataFrame:
    """Edges of H1 from the labels (tile, x, y, label) of haloed tiles, tiles being their manifest.

    (ordinal, tile_a, label_a, tile_b, label_b, pixels, fraction) of the mutual best labels of each pair of adjacent tiles,
    in the order of the pairs, then of label_a. Areas count all labelled pixels of the box that both tiles hold. Only
    pixels of these boxes are shuffled, once. Where labels match, a pixel with two labels in one tile and
    a label of 2^31 or more are errors."""
    pairs = seam_pairs(tiles)
    boxes = pairs.withColumn("s", F.explode(F.array(F.struct(F.col("a").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("b").alias("tile"), F.lit(1).alias("side")))))
    boxes = boxes.select("s.*", "pair", "x0", "y0", "x1", "y1")
    # at most eight rows a tile of the manifest
    x = labels.filter("label > 0").join(F.broadcast(boxes), "tile").filter("x >= x0 and x < x1 and y >= y0 and y < y1")
    on = lambda k: F.when(F.col("side") == k, F.col("label"))
    both = x.groupBy("pair", "x", "y").agg(*(F.coalesce(F.max(on(k)), F.lit(0)).alias(c) for k, c in enumerate("st")), *(F.count(on(k)).alias(f"n{c}") for k, c in enumerate("st")))
    both = both.withColumn("s", F.when(F.greatest("ns", "nt") > 1, F.raise_error(F.lit("a pixel has two labels in one tile")).cast("long")).otherwise(F.col("s")))
    n = both.groupBy("pair", "s", "t").agg(F.count("*").alias("n"))
    area = lambda c: n.filter(F.col(c) > 0).groupBy("pair", c).agg(F.sum("n").alias(f"area_{c}"))
    hit = n.filter("s > 0 and t > 0")
    best = lambda c, o: hit.groupBy("pair", c).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(o).alias("o"))).alias("b")).select("pair", c, F.col("b.o").alias(o))
    m = hit.join(best("s", "t"), ["pair", "s", "t"]).join(best("t", "s"), ["pair", "s", "t"]).join(area("s"), ["pair", "s"]).join(area("t"), ["pair", "t"])
    m = m.withColumn("fraction", F.col("n") / F.least("area_s", "area_t")).filter((F.col("n") >= least) & (F.col("fraction") >= share))
    o = F.when(F.col("s") < 2**31, F.col("pair") * 2**31 + F.col("s")).otherwise(F.raise_error(F.lit("label of 2^31 or more")).cast("long"))
    return m.join(F.broadcast(pairs.select("pair", "a", "b")), "pair").select(o.cast("long").alias("ordinal"), F.col("a").alias("tile_a"), F.col("s").alias("label_a"), F.col("b").alias("tile_b"), F.col("t").alias("label_b"), F.col("n").alias("pixels"), "fraction")


def seam_agreement(labels: DataFrame, identities: DataFrame) -> DataFrame:
    """H6: by pair of overlapping tiles the spots that both label, the share with one identity, and mutual best matches.

    labels (tile, x, y, label) of haloed tiles, identities (tile, label, global_id). A pixel lies in at most four tiles."""
    x = labels.filter("label > 0").join(identities, ["tile", "label"], "left")
    side = lambda s: x.select("x", "y", F.col("tile").alias(f"tile_{s}"), F.col("label").alias(f"label_{s}"), F.col("global_id").alias(f"id_{s}"))
    both = side("a").join(side("b"), ["x", "y"]).filter("tile_a < tile_b")
    same = F.coalesce(F.col("id_a") == F.col("id_b"), F.lit(False)).cast("long")
    n = both.groupBy("tile_a", "tile_b", "label_a", "label_b").agg(F.count("*").alias("n"), F.sum(same).alias("same"))
    tiles = ["tile_a", "tile_b"]
    best = lambda s, o: n.groupBy(*tiles, f"label_{s}").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(f"label_{o}").alias("o"))).alias("b")).select(*tiles, f"label_{s}", F.col("b.o").alias(f"label_{o}"))
    mutual = best("a", "b").join(best("b", "a"), [*tiles, "label_a", "label_b"]).groupBy(*tiles).agg(F.count("*").alias("mutual_matches"))
    return n.groupBy(*tiles).agg(F.sum("n").cast("long").alias("spots"), (F.sum("same") / F.sum("n")).alias("same_identity")).join(mutual, tiles)


def representative_tiles(tiles: DataFrame) -> DataFrame:
    """(role, id) of the tissue tile with most counts, the median one, and the one whose corners move most.

    tiles (id, umis, nuclei, shift): the manifest, one row a tile; the first id on ties of shift, the last on ties of counts."""
    t = tiles.filter("umis > 0 and nuclei > 0")
    w = W.orderBy("umis", "id")
    x = t.select("id", F.row_number().over(w).alias("r"), F.count("*").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"), F.row_number().over(W.orderBy(F.desc("shift"), "id")).alias("s"))
    pick = lambda role, c: x.filter(c).select(F.lit(role).alias("role"), "id")
    return pick("most", F.col("r") == F.col("n")).unionByName(pick("median", F.col("r") == F.floor(F.col("n") / 2) + 1)).unionByName(pick("moved", F.col("s") == 1))


def point_counts(tiles: DataFrame, status: DataFrame, samples: DataFrame, cap: int = 4096, whole: bool = True) -> DataFrame:
    """One row: tiles by state, samples by split and class, planned samples with the class cap, centres with and without halo.

    tiles (id, split, records), status (id, state in prepared, empty, failed), samples (id, foreground, eligible, in_core).
    The scope says whether the counts are those of the whole slide."""
    s = samples.groupBy("id").agg(
        F.count_if(F.col("eligible") & (F.col("foreground") == 1)).alias("fg"), F.count_if(F.col("eligible") & (F.col("foreground") == 0)).alias("bg"), F.count("*").alias("centres"), F.count_if("in_core").alias("core")
    )
    x = tiles.join(status.select("id", "state"), "id", "left").join(s, "id", "left").fillna(0, ["fg", "bg", "centres", "core"])
    x = x.withColumns({"state": F.coalesce("state", F.lit("pending")), "_p": F.least("fg", F.lit(cap))})
    x = x.withColumn("planned", F.col("_p") + F.least("bg", F.lit(cap), F.when(F.col("_p") > 0, F.col("_p")).otherwise(cap)))
    n = lambda c, name: F.count_if(c).alias(name)
    of = lambda split, c, name: F.coalesce(F.sum(F.when(F.col("split") == split, F.col(c))), F.lit(0)).cast("long").alias(name)
    state = F.col("state")
    out = x.agg(
        F.count("*").alias("tiles"),
        n(state.isin("prepared", "empty"), "prepared_tiles"),
        n(state == "empty", "empty_tiles"),
        n(state.isin("pending", "failed"), "pending_tiles"),
        n(state == "failed", "failed_tiles"),
        *(of(k, c, f"{k}_{name}") for k in ("train", "validation") for c, name in (("fg", "foreground"), ("bg", "background"), ("planned", "planned"))),
        F.sum("centres").cast("long").alias("centres_with_halo"),
        F.sum("core").cast("long").alias("centres_core_unique"),
    )
    scope = F.when(F.col("pending_tiles") > 0, "prepared tiles only; incomplete").when(F.lit(whole), "whole slide").otherwise("specified tiles only (partial slide)")
    return out.withColumn("scope", scope)
