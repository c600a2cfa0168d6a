"""Near-duplicate vectors by a pivot-permutation index.

Method: reference vectors (pivots) are drawn from a bounded hash sample. Every vector is described by the ordered
list of its DEPTH nearest pivots. Inverted lists are kept for every set of ``shared`` pivots, and a vector is entered
in the lists of all such sets among its own pivots, so vectors that meet have that many pivots in common. Each
candidate pair is verified once by its cosine in double precision, in the list of the least pivots it shares. The number of pivots, and
beyond MAX_PIVOTS the size of the sets, grow with the number of vectors, so that lists keep their length. Lists are cut into chunks
and compared chunk against chunk, so a list of any length is spread over tasks; a block gives counts and a
spanning set of links, not pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing; labels of any type are compared as text; vectors of other lengths are never compared; repeated rows are vectors of their own and link
with each other, rows of one id included; equal vectors of one label, known by a 64-bit hash, are indexed once with their number; pivots at equal distance go by number; a null id is kept and linked, but names no
component unless alone. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, Scratch, connected, hot_join, least_hashes, schema

#: Pivots (documented bound of the broadcast), nearest pivots that describe a vector, and the wanted length of a list.
MAX_PIVOTS, DEPTH, LENGTH = 1024, 6, 64
#: Rows of a list's chunk.
CHUNK = 192


def n_pivots(n: int) -> int:
    """Pivots for n vectors, up to the bound."""
    return min(MAX_PIVOTS, max(32, 2 ** math.ceil(math.log2(max(n, 1) / LENGTH))))


def n_shared(n: int) -> int:
    """Pivots that name a list: 2, or more where their lists would grow beyond LENGTH (3 from 33 million vectors on)."""
    k = 2
    while math.comb(MAX_PIVOTS, k) * LENGTH < n and k < DEPTH:
        k += 1
    return k


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + 0.0).alias("v"))  # -0.0 is 0.0
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0) & fine, F.lit(False)))


def permutations(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (rep, label, n, v) with dim and perm, the nearest pivots in order (ties by pivot number)."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(frames):
        for f in frames:
            perm = [None] * len(f)
            dims = f["v"].map(len).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.array(f["v"].iloc[at].tolist(), np.float64)
                x /= np.abs(x).max(1)[:, None]
                p = held.value[:, :d] if held.value.shape[1] >= d else np.pad(held.value, ((0, 0), (0, d - held.value.shape[1])))
                s = x @ p.T
                k = min(DEPTH, p.shape[0])
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                for i, t in zip(at, top, strict=True):
                    perm[i] = t.tolist()
            f["dim"], f["perm"] = dims, perm
            yield f

    return rows.mapInPandas(run, "rep long, label string, n long, v array<double>, dim int, perm array<int>")


def _links(threshold: float, rep, n, chunk, left: int, right: int, key: list[int], perms: list, v: list) -> tuple[list, list, list]:
    """Links of one block of a list: its vectors that have any, their link counts, and a vector each is connected with."""
    x = np.array(v, np.float64)
    x /= np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    a, b = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
    hit = x[a] @ x[b].T >= threshold
    if left == right:
        hit &= a[:, None] < b[None, :]
    if not hit.any():
        return [], [], []
    # the list of the least pivots that the pair shares: none but the list's own up to the largest of them
    marks = np.zeros((len(x), int(max(key)) + 1), np.float32)
    for i, p in enumerate(perms):
        marks[i, [k for k in p if k <= key[-1]]] = 1
    hit &= marks[a] @ marks[b].T == len(key)
    i, j = np.nonzero(hit)
    i, j = a[i], b[j]
    counts = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
    # a spanning set of the links: union by smallest index
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
    have = np.flatnonzero(counts > 0).tolist()
    groups: dict[int, list[int]] = {}
    for k in have:
        groups.setdefault(find(k), []).append(k)
    # as a binary tree rather than a star, so that no vector is a hub
    other = {g[i]: g[max(i - 1, 0) // 2] for g in groups.values() for i in range(len(g))}
    return rep[have].tolist(), counts[have].astype(np.int64).tolist(), rep[[other[k] for k in have]].tolist()


def compare_blocks(parts: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, other) of the blocks of parts (gid, rep, n, chunk, lo, hi, key, perm, v); a block is whole in a task, and many go in one batch."""

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        gid, rep, n, chunk = (f[c].to_numpy() for c in ("gid", "rep", "n", "chunk"))
        lo, hi, key, perm, v = (f[c].to_list() for c in ("lo", "hi", "key", "perm", "v"))
        cut = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True]).tolist()
        out = ([], [], [])
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if e - s > 1:
                for o, got in zip(out, _links(threshold, rep[s:e], n[s:e], chunk[s:e], lo[s], hi[s], key[s].tolist(), perm[s:e], v[s:e]), strict=True):
                    o += got
        return pd.DataFrame(dict(zip(("rep", "links", "other"), out, strict=True)), dtype=np.int64)

    def run(frames):
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            last = f["gid"].to_numpy() == f["gid"].iloc[-1]  # may go on in the next batch
            held = f[last].reset_index(drop=True)
            yield settle(f[~last])
        if held is not None:
            yield settle(held)

    return parts.repartition("gid").sortWithinPartitions("gid", "rep").mapInPandas(run, schema(rep=LONG, links=LONG, other=LONG))


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    rows = usable(df, id_col, vec_col, label_col)
    usable_rows = rows.filter("ok").select("vec_id", F.xxhash64("label", "v").alias("rep"), "label", "v")
    reps = scratch.keep(usable_rows.groupBy("rep").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")))
    total = reps.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = least_hashes(reps.select("v"), n_pivots(total), "pivots", "v").collect()
    dim = max(len(r.v) for r in sample)
    pivots = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        p = np.array(r.v) / max(abs(v) for v in r.v)
        pivots[i, : len(p)] = p / math.sqrt(float(p @ p))
    found = scratch.keep(permutations(reps.select("rep", "label", "n", "v"), pivots))
    sets = F.lit([list(c) for c in itertools.combinations(range(DEPTH), n_shared(total))])
    fit = F.filter(sets, lambda c: F.array_max(c) < F.size("perm"))
    keys = F.transform(fit, lambda c: F.array_sort(F.transform(c, lambda i: F.get("perm", i))))
    lists = found.withColumn("key", F.explode(keys))
    by = ["label", "dim", "key"]
    sizes = lists.groupBy(*by).agg(F.count("*").alias("size")).filter("size > 1").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    parts = lists.join(sizes.select(*by, "chunks"), by).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    parts = parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = parts.withColumn("lo", F.least("chunk", "with")).withColumn("hi", F.greatest("chunk", "with")).drop("with", "chunks")
    parts = parts.select(F.xxhash64(*by, "lo", "hi").alias("gid"), "rep", "n", "chunk", "lo", "hi", "key", "perm", "v")
    out = scratch.keep(compare_blocks(parts, threshold))
    links = out.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = out.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct()
    comp = connected(reps.select(F.col("rep").alias("id")), edges, scratch)
    comp = scratch.keep(comp.withColumnRenamed("id", "rep").join(reps.select("rep", "vec_id", "n"), "rep"))
    least = comp.groupBy("component").agg(F.min("vec_id").alias("least"))
    whole = scratch.keep(comp.join(least, "component").join(links, "rep", "left").select("rep", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least").alias("component")))
    linked = hot_join(usable_rows.select("vec_id", "rep"), whole, ["rep"], "n")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return (
        linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
        .unionByName(alone)
        .select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
    )
