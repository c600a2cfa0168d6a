"""Label identity across tiles: constrained union, numbering, stitching."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.plans.shared import new_folder

from . import ranking


def keep(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cut off from its lineage, and from constraints that would pile up over rounds."""
    path = new_folder(df.sparkSession, "identity")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(key, root): smallest key reachable over edges (a, b). Rounds of minimum labels with pointer jumping."""
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = keep(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = both.join(label.select(F.col("key").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("key")).agg(F.min("r").alias("r"))
        near = label.join(seen, "key").select("key", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        up = near.select(F.col("key").alias("up"), F.col("root").alias("top"))
        new = keep(near.join(up, near.root == up.up, "left").select("key", F.coalesce(F.least("root", "top"), "root").alias("root"), "was"))
        label = new.select("key", "root")
        if new.filter("root <> was").isEmpty():
            return label


#: Edges of a component that one task may replay; larger components are contracted further.
REPLAY = 10_000


def _replay(frame: pd.DataFrame) -> pd.DataFrame:
    """Accepted edges (a, b) of one component in edge order; an edge between sides that share a tile is refused."""
    parent, tiles, out = {}, {}, []
    for side in "ab":
        for tile, label, own in zip(frame[f"{side}_tile"], frame[f"{side}_label"], frame[f"{side}_tiles"], strict=True):
            parent[tile, label], tiles[tile, label] = (tile, label), set(own)

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for r in frame.sort_values(["o", "a_tile", "a_label", "b_tile", "b_label"]).itertuples():
        a, b = find((r.a_tile, r.a_label)), find((r.b_tile, r.b_label))
        if a != b and not tiles[a] & tiles[b]:
            parent[b] = a
            tiles[a] |= tiles.pop(b)
            out.append((r.a_tile, r.a_label, r.b_tile, r.b_label))
    return pd.DataFrame(out, columns=["a_tile", "a_label", "b_tile", "b_label"])


def _with_tiles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (root, o, a, b) with the tiles of both sides, those whose sides share a tile left out: they are refused whenever their turn comes."""
    side = lambda c: nodes.select(F.col("key").alias(c), F.col("tiles").alias(f"{c}_tiles"))
    return edges.join(side("a"), "a").join(side("b"), "b").filter(~F.arrays_overlap("a_tiles", "b_tiles"))


def _contract(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over edges (root, o, a, b) and nodes (root, key, tiles): accepted edges (a, b), the edges and the nodes left.

    An edge that comes first at both of its sides is decided now, as no earlier one can change them. A side whose tiles
    no other node of its component holds can never be refused, so its first edge is taken at once, whatever the order at
    the other side; that is what shortens long chains. Of parallel edges the first one decides."""
    x = _with_tiles(edges, nodes).groupBy("root", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("o").alias("o"))
    x = keep(x.select("root", F.struct("o", "a", "b").alias("e")))
    held = nodes.select("root", "key", F.explode("tiles").alias("tile"))
    bound = held.join(held.groupBy("root", "tile").agg(F.count("*").alias("n")).filter("n > 1"), ["root", "tile"], "left_semi").select("key").distinct()
    first = keep(x.select(F.explode(F.array("e.a", "e.b")).alias("key"), "e").groupBy("key").agg(F.min("e").alias("e")))
    free = first.join(bound, "key", "left_anti").select("e")
    both = first.groupBy("e").agg(F.count("*").alias("n")).filter("n = 2").select("e")
    taken = keep(free.union(both).distinct().select("e.a", "e.b"))
    to = keep(components(taken).withColumnRenamed("root", "to"))
    left = nodes.join(to, "key", "left").groupBy("root", F.coalesce("to", "key").alias("key")).agg(F.array_distinct(F.flatten(F.collect_list("tiles"))).alias("tiles"))
    e = x.select("root", "e.*")
    for c in "ab":
        e = e.join(to.withColumnRenamed("key", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return taken, keep(e.filter("a <> b").select("root", "o", "a", "b")), keep(left)


def reconcile_labels(edges: DataFrame, nodes: DataFrame, replay: int = REPLAY) -> DataFrame:
    """H1: (tile, label, root_tile, root_label) for nodes (tile, label) under edges (ordinal, tile_a, label_a, tile_b, label_b).

    Edges are taken in order; one whose sides already hold labels of a common tile is refused. A refusal cannot cross
    components of all edges, so components with one label a tile are final. The others keep, of their tiles, those that
    occur twice in the component. While such a component has more than ``replay`` edges it is contracted in rounds
    (``_contract``); what is left is replayed in edge order, one component a task. Components of edges that depend on
    one another one by one, each refused because of the one before, take as many rounds as the longest such run."""
    key = lambda t, lab: F.struct(F.col(t).alias("tile"), F.col(lab).alias("label"))
    kinds = dict(nodes.dtypes)
    kind = f"struct<tile:{kinds['tile']},label:{kinds['label']}>"
    ends = edges.select(F.col("ordinal").alias("o"), key("tile_a", "label_a").cast(kind).alias("a"), key("tile_b", "label_b").cast(kind).alias("b"))
    comp = keep(components(ends))
    twice = comp.groupBy("root", "key.tile").agg(F.count("*").alias("n")).filter("n > 1").select("root", "tile")
    clash = twice.select("root").distinct()
    own = comp.join(clash, "root", "left_semi").withColumn("tile", F.col("key.tile")).join(twice.withColumn("hit", F.lit(True)), ["root", "tile"], "left")
    own = keep(own.select("root", "key", F.when(F.col("hit"), F.array("tile")).otherwise(F.array().cast(f"array<{kinds['tile']}>")).alias("tiles")))
    left = keep(ends.join(own.select(F.col("key").alias("a"), "root"), "a").select("root", "o", "a", "b"))
    sides = lambda d: d.select(*(F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in "ab" for f in ("tile", "label")))
    flat = f"a_tile {kinds['tile']}, a_label {kinds['label']}, b_tile {kinds['tile']}, b_label {kinds['label']}"
    accepted = []
    while True:
        large = left.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > replay).select("root")
        small = _with_tiles(left.join(large, "root", "left_anti"), own)
        small = small.select("root", "o", *(F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in "ab" for f in ("tile", "label")), "a_tiles", "b_tiles")
        accepted.append(small.groupBy("root").applyInPandas(_replay, flat))
        left = left.join(large, "root", "left_semi")
        if left.isEmpty():
            break
        taken, left, own = _contract(left, own.join(large, "root", "left_semi"))
        accepted.append(sides(taken))
    every = reduce(DataFrame.unionByName, accepted)
    joined = components(every.select(key("a_tile", "a_label").alias("a"), key("b_tile", "b_label").alias("b")))
    found = comp.join(clash, "root", "left_anti").unionByName(joined)
    found = found.select("key.tile", "key.label", F.col("root.tile").alias("root_tile"), F.col("root.label").alias("root_label"))
    x = nodes.select("tile", "label").distinct().join(found, ["tile", "label"], "left")
    return x.select("tile", "label", F.coalesce("root_tile", "tile").alias("root_tile"), F.coalesce("root_label", "label").alias("root_label"))


def cell_roots(core_pixels: DataFrame, union: DataFrame) -> DataFrame:
    """H2: (root_tile, root_label, cell), cell ids 1..n in the order of the roots; only roots with core pixels (tile, label, x, y) count."""
    x = core_pixels.filter("label > 0").join(union, ["tile", "label"])
    ids = ranking.compact_labels(x.select("root_tile", "root_label"), "root_label", ["root_tile"])
    return ids.select("root_tile", "root_label", F.col("global_id").alias("cell"))


def global_cells(core_pixels: DataFrame, union: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """H2: core pixels (tile, label, x, y) with the cell ids of cell_roots."""
    roots = cell_roots(core_pixels, union) if roots is None else roots
    return core_pixels.filter("label > 0").join(union, ["tile", "label"]).join(roots, ["root_tile", "root_label"]).select("x", "y", "cell")


def stitch_slide(core_pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """H3: (cell, area, cx, cy) of the whole slide."""
    from .expression import cell_stats

    union = reconcile_labels(edges, core_pixels.filter("label > 0").select("tile", "label"))
    return cell_stats(global_cells(core_pixels, union), "cell")


def attach_shared_identity(labels: DataFrame, identities: DataFrame) -> DataFrame:
    """Labels (tile, label, ..) with the global id of each local label, 0 for none. identities (tile, label, global_id)."""
    return labels.join(identities, ["tile", "label"], "left").withColumn("global_id", F.coalesce("global_id", F.lit(0)))


def shared_union(nodes: DataFrame, identities: DataFrame) -> DataFrame:
    """D15 in place of H1: (tile, label, root_tile, root_label) by shared identity; a label without one is a root of its own.

    identities (tile, label, global_id), 0 for none. The least tile and label of an identity is its root."""
    root = identities.filter("global_id > 0").groupBy("global_id").agg(F.min(F.struct("tile", "label")).alias("r"))
    x = attach_shared_identity(nodes.select("tile", "label").distinct(), identities.select("tile", "label", "global_id")).join(root, "global_id", "left")
    return x.select("tile", "label", F.coalesce("r.tile", "tile").alias("root_tile"), F.coalesce("r.label", "label").alias("root_label"))
