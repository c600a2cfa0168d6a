"""P3 from the pixels of haloed tiles against plain Python: boxes, matches, ordered union with clashes, core ownership."""

import random
from collections import Counter, defaultdict

import pytest

from slidespark.operators import grid, slide
from slidespark.plans import pipelines

SIDE, CORE, HALO = 60, 20, 6
LABELS = "tile string, x long, y long, label long"


def slide_of_tiles(spark, seed):
    """Every tile sees discs of its own, shifted, left out or merged in pairs at random, so that matches differ in share and clash."""
    rnd = random.Random(seed)
    tiles = [r.asDict() for r in grid.make_tiles(spark, SIDE, SIDE, CORE, HALO).collect()]
    firsts = [(rnd.randrange(SIDE), rnd.randrange(SIDE)) for _ in range(30)]
    centres = [(x + d * rnd.randrange(5, 9), y + d * rnd.randrange(-4, 5), rnd.randrange(3, 6)) for x, y in firsts for d in (0, 1)]
    rows = {}
    for t in tiles:
        shift = [(rnd.randrange(-1, 2), rnd.randrange(-1, 2), rnd.random() < 0.1) for _ in centres]
        merged = [rnd.random() < 0.4 for _ in firsts]
        for x in range(max(t["origin_x"], 0), min(t["origin_x"] + t["width"] + 2 * HALO, SIDE)):
            for y in range(max(t["origin_y"], 0), min(t["origin_y"] + t["height"] + 2 * HALO, SIDE)):
                for k, ((cx, cy, r), (dx, dy, gone)) in enumerate(zip(centres, shift, strict=True)):
                    if not gone and (x - cx - dx) ** 2 + (y - cy - dy) ** 2 <= r * r:
                        rows[t["id"], x, y] = 1 + k // 2 if merged[k // 2] else 100 + k
    return tiles, rows


def plain(tiles, rows, least, share):
    """Edges in order with whether they are taken, and the root of every label."""
    at = {(t["ix"], t["iy"]): t["id"] for t in tiles}
    of = defaultdict(dict)
    for (t, x, y), label in rows.items():
        of[t][x, y] = label
    nodes = {(t, v) for t in of for v in of[t].values()}
    group = {n: {n} for n in nodes}
    edges = []
    for (ix, iy), a in sorted(at.items()):
        for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
            b = at.get((ix + dx, iy + dy))
            if b is None:
                continue
            inside = lambda x, y, i, j: i * CORE - HALO <= x < (i + 1) * CORE + HALO and j * CORE - HALO <= y < (j + 1) * CORE + HALO
            box = lambda t: {p: v for p, v in of[t].items() if inside(*p, ix, iy) and inside(*p, ix + dx, iy + dy)}  # noqa: E731, B023
            pa, pb = box(a), box(b)
            n, na, nb = Counter((pa[p], pb[p]) for p in pa.keys() & pb.keys()), Counter(pa.values()), Counter(pb.values())
            for s in sorted(na):
                t = min((k for k in n if k[0] == s), key=lambda k: (-n[k], k[1]), default=None)
                if t and t == min((k for k in n if k[1] == t[1]), key=lambda k: (-n[k], k[0])) and n[t] >= least and n[t] / min(na[s], nb[t[1]]) >= share:
                    p, q = group[a, s], group[b, t[1]]
                    taken = p is q or not {u for u, _ in p} & {u for u, _ in q}
                    if taken and p is not q:
                        p |= q
                        for k in p:
                            group[k] = p
                    edges.append((a, s, b, t[1], n[t], round(n[t] / min(na[s], nb[t[1]]), 9), taken))
    return edges, {n: min(g) for n, g in group.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_stitch_from_pixels(spark, seed):
    tiles, rows = slide_of_tiles(spark, seed)
    edges, root = plain(tiles, rows, 8, 0.5)
    assert sum(not e[-1] for e in edges) > 0 and len(edges) > 50 and any(e[5] < 1 for e in edges)
    manifest = grid.make_tiles(spark, SIDE, SIDE, CORE, HALO)
    labels = spark.createDataFrame([(*k, v) for k, v in rows.items()], LABELS)
    status = manifest.selectExpr("id", "'done' AS state", "'f' AS fingerprint")
    rnd = random.Random(seed)
    records = [(rnd.randrange(SIDE), rnd.randrange(SIDE), rnd.randrange(30), rnd.randrange(1, 4)) for _ in range(4000)]
    got = pipelines.stitch(spark.createDataFrame(records, "x long, y long, gene_id long, cnt long"), labels, manifest, status, core=CORE, low=5, high=25, least=8, lowers=(1, 10))
    m = sorted(got.matches.collect(), key=lambda r: r.ordinal)
    assert [(r.tile_a, r.label_a, r.tile_b, r.label_b, r.pixels, round(r.fraction, 9), r.accepted) for r in m] == edges

    own = {(x, y): root[t, v] for (t, x, y), v in rows.items() if t == f"x{x // CORE:02d}_y{y // CORE:02d}"}
    number = {r: i for i, r in enumerate(sorted(set(own.values())), 1)}
    area, umis, genes = Counter(number[r] for r in own.values()), Counter(), defaultdict(set)
    for x, y, g, n in records:
        if (x, y) in own:
            umis[number[own[x, y]]] += n
            genes[number[own[x, y]]].add(g)
    want = {c: (area[c], umis[c], len(genes[c]), "few_genes" if len(genes[c]) < 5 else "many_genes" if len(genes[c]) > 25 else "kept") for c in area}
    assert {r.cell: (r.area, r.n_umis, r.n_genes, r.reason) for r in got.cells.collect()} == want
    kept = lambda low: [c for c in area if low <= len(genes[c]) <= 25]
    assert {r.lower: (r.cells, r.umis) for r in got.sensitivity.collect()} == {k: (len(kept(k)), sum(umis[c] for c in kept(k))) for k in (1, 10)}


def test_identities_replace_matches_and_faults_are_refused(spark):
    manifest = grid.make_tiles(spark, 20, 40, 20, 4)
    status = manifest.selectExpr("id", "'done' AS state", "'f' AS fingerprint")
    labels = spark.createDataFrame([("x00_y00", 1, 18, 5), ("x00_y01", 1, 21, 3), ("x00_y01", 1, 30, 4), ("x00_y00", 1, 21, 5)], LABELS)
    ids = spark.createDataFrame([("x00_y00", 5, 900), ("x00_y01", 3, 900), ("x00_y01", 4, 0)], "tile string, label long, global_id long")
    records = spark.createDataFrame([(1, 18, 1, 2), (1, 21, 2, 3), (1, 30, 1, 1), (9, 9, 1, 7)], "x long, y long, gene_id long, cnt long")
    run = lambda **k: pipelines.stitch(records, labels, manifest, k.pop("status", status), core=20, low=1, **k)
    got = run(identities=ids)
    assert got.matches is None
    assert sorted((r.cell, r.area, r.n_umis, r.n_genes) for r in got.cells.collect()) == [(1, 2, 5, 2), (2, 1, 1, 1)]
    with pytest.raises(ValueError, match="more than once"):
        run(identities=ids.union(spark.createDataFrame([("x00_y01", 9, 900)], ids.schema)))
    half = status.filter("id = 'x00_y00'")
    with pytest.raises(ValueError, match="incomplete"):
        run(identities=ids, status=half)
    assert [(r.cell, r.n_umis) for r in run(identities=ids, status=half, partial=True).cells.collect()] == [(1, 2)]


def test_a_pixel_has_one_label_in_a_tile(spark):
    manifest = grid.make_tiles(spark, 20, 40, 20, 4)
    labels = spark.createDataFrame([("x00_y00", 1, 18, 5), ("x00_y00", 1, 18, 6), ("x00_y01", 1, 18, 3)], LABELS)
    with pytest.raises(Exception, match="two labels"):
        slide.seam_matches(labels, manifest).collect()
    assert slide.seam_matches(labels.limit(0), manifest).count() == 0
