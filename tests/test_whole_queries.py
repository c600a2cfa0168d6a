"""Queries over whole tables against plain Python on a small folder of their own."""

import hashlib
from collections import defaultdict

from slidespark.plans import registry


def folder(spark, tmp_path):
    items = [(o, i, (o * 37 + i) % 60 + 1, (o * 11 + i) % 97, 1.0 + (o + i) % 30) for o in range(1, 61) for i in range(1, 5)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"mt-name {k}" if k == 300 else f"name {k}") for k in range(1, 301)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    vectors = [(k, [float((k * 7 + d) % 13) for d in range(9)]) for k in range(300)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_whole_queries(spark, tmp_path):
    sf = folder(spark, tmp_path)
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    records = registry.Fixtures(spark, sf)["fx_records"].collect()

    assert {r.gene_id for r in records} - set(range(20))
    spots, want = {(r.x, r.y) for r in records}, defaultdict(float)
    for r in records:
        for dx in range(-2, 3):
            for dy in range(-2, 3):
                if dx * dx + dy * dy <= 4 and (r.x + dx, r.y + dy) in spots:
                    want[r.x + dx, r.y + dy, r.gene_id] += r.cnt / max(dx * dx + dy * dy, 1)
    got = {(r.x, r.y, r.gene_id): r.value for r in run("d11_kernel_enhance")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)

    vector = {r.symbol: r.embedding for r in registry.Fixtures(spark, sf)["fx_embeddings"].collect()}
    counts = defaultdict(int)
    for r in records:
        if 1 <= r.gene_id < 200 and f"NAME {r.gene_id}" in vector:
            counts[r.bx, r.by_, f"NAME {r.gene_id}"] += r.cnt
    total, genes = defaultdict(float), defaultdict(int)
    for (x, y, g), n in counts.items():
        genes[x, y] += 1
        for d, v in enumerate(vector[g]):
            total[x, y, d] += n * v
    got = {(r.bx, r.by_, r.dim): r.value / r.nnz / 1e6 for r in run("c12_pool_embeddings")}
    assert {d for *_, d in got} == set(range(9)) and got.keys() == total.keys()
    assert all(abs(got[x, y, d] - v / genes[x, y]) < 1e-3 for (x, y, d), v in total.items())

    name = {k: f"mt-name {k}" if k == 300 else f"name {k}" for k in range(1, 301)}
    assert {r.gene_id: (r.symbol, r.identifier) for r in run("g2_gene_symbol")} == {k: (v.upper(), f"ENS{k}") for k, v in name.items()}
    assert {r.gene_id: r.h for r in run("g4_fingerprint")} == {k: hashlib.sha256(f"ENS{k}\x1f{v}".encode()).hexdigest() for k, v in name.items()}
    assert {r.gene_id for r in run("g6_is_mt") if r.mt} == {k for k in name if k % 7 == 0 or k == 300}
