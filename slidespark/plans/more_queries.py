"""More queries by operator id: sources and sinks that write and read, slide products, paired comparison, pipelines."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from slidespark.functions import scalars as S
from slidespark.operators import compare as C
from slidespark.operators import evaluate as V
from slidespark.operators import expression as E
from slidespark.operators import gates as J
from slidespark.operators import genes as G
from slidespark.operators import grid as B
from slidespark.operators import hooks as L
from slidespark.operators import identity as H
from slidespark.operators import ranking as R
from slidespark.operators import slide as Z
from slidespark.operators import spatial as D
from slidespark.sources import records as A

from . import pipelines as P
from .fixtures import oracle
from .registry import BEST_AB, CELLS_SQL, EXPR, N_GENES, ORACLE_SQL, PEARSON_SQL, QUERIES, RING_SQL, SPLIT_SQL, TILED, query, rounded, seam_edges, side, tile_labels
from .shared import new_folder

TILE_ID = "CAST(floor(x/150) AS BIGINT)*100+CAST(floor(y/150) AS BIGINT)"


def tile_id(x="x", y="y"):
    return (F.floor(F.col(x) / 150) * 100 + F.floor(F.col(y) / 150)).cast("long")


# --- A: what is written is read again ----------------------------------------------------------------------------


@query("a1_read_records", "SELECT concat('g', gene_id) AS gene, x, y, cnt FROM fx_records")
def _(fx):
    path = new_folder(fx.spark, "a1")
    r = fx["fx_records"].select(F.concat(F.lit("g"), F.col("gene_id").cast("string")).alias("geneID"), "x", "y", F.col("cnt").alias("MIDCounts"))
    r.write.csv(path, sep="\t", header=True)
    return A.read_records(fx.spark, path)


@query("a4_write_spatial_index", f"SELECT CAST(floor(x/150) AS BIGINT) AS ix, CAST(floor(y/150) AS BIGINT) AS iy, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records GROUP BY 1,2")
def _(fx):
    return A.write_spatial_index(fx["fx_records"].select("x", "y", "gene_id", "cnt"), new_folder(fx.spark, "a4"), 150)


@query("a5_write_shards", "SELECT CAST(floor(x/150) AS BIGINT) AS px, CAST(floor(y/150) AS BIGINT) AS py, x%150 AS x, y%150 AS y, gene_id, cnt FROM fx_records")
def _(fx):
    path = new_folder(fx.spark, "a5")
    A.write_shards(fx["fx_records"], path, 150)
    return fx.spark.read.parquet(path).withColumns({c: F.col(c).cast("long") for c in ("px", "py")}).select("px", "py", "x", "y", "gene_id", "cnt")


@query("a10_read_predictions", "SELECT x, y, p, k, ((k+target) % 7)/8.0E0 - 0.25E0 AS logit FROM fx_pred, range(16) t(k)")
def _(fx):
    path = new_folder(fx.spark, "a10")
    logits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((k + F.col("target")) % 7) / 8.0 - 0.25)
    A.write_predictions(fx["fx_pred"].withColumn("logits", logits).withColumn("p", F.col("p").cast("double")), path)
    x = A.read_predictions(fx.spark, path)
    return x.select("x", "y", "p", F.posexplode("logits").alias("k", "logit")).withColumn("k", F.col("k").cast("long"))


@query("a11_load_schema", "SELECT count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records")
def _(fx):
    path = new_folder(fx.spark, "a11")
    r = J.totals(fx["fx_records"]).first()
    content = {"records": r.records, "umis": r.umis}
    import hashlib

    mark = hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    fx.spark.createDataFrame([(json.dumps(content | {"fingerprint": mark}),)], "value string").coalesce(1).write.text(path)
    got = A.load_schema(fx.spark, path)
    return fx.spark.createDataFrame([(got["records"], got["umis"])], "records long, umis long")


@query("a12_spot2cell", "SELECT cell_a AS cell, count(*) AS spots, min(x) AS x0, max(y) AS y1 FROM fx_labels GROUP BY 1")
def _(fx):
    path = new_folder(fx.spark, "a12")
    A.write_spot2cell(fx["fx_labels"].select("x", "y", F.col("cell_a").alias("cell")), f"{path}/spots")
    x = fx.spark.read.csv(f"{path}/spots", sep="\t", header=True, schema="x long, y long, cell long")
    return x.groupBy("cell").agg(F.count("*").alias("spots"), F.min("x").alias("x0"), F.max("y").alias("y1"))


@query("a13_cell_matrix", "SELECT cell_a AS cell, count(DISTINCT gene_id) AS n_genes, CAST(sum(cnt) AS BIGINT) AS n_umis FROM fx_records JOIN fx_labels USING (x, y) WHERE cell_a > 0 GROUP BY 1")
def _(fx):
    path = new_folder(fx.spark, "a13")
    counts = E.label_expression(fx["fx_records"], fx["fx_labels"], "cell_a").filter("label > 0").withColumnRenamed("label", "cell")
    A.write_cell_matrix(counts, E.cell_stats(fx["fx_labels"], "cell_a"), fx["fx_records"].select("gene_id").distinct(), path)
    return fx.spark.read.parquet(f"{path}/counts").groupBy("cell").agg(F.count("*").alias("n_genes"), F.sum("cnt").cast("long").alias("n_umis"))


@query("a14_publish", "SELECT bx, by_, count(*) AS nnz, CAST(sum(cnt) AS BIGINT) AS umi FROM (SELECT bx, by_, gene_id, sum(cnt) AS cnt FROM fx_records GROUP BY 1,2,3) e GROUP BY 1,2")
def _(fx):
    path = new_folder(fx.spark, "a14")
    A.publish(E.bin_stats(E.bin_expression(fx["fx_records"])), f"{path}/table", f"{path}/done")
    marker = fx.spark.read.schema("path string").json(f"{path}/done").select(F.lit(1).alias("_d")).limit(1)
    return fx.spark.read.parquet(f"{path}/table").crossJoin(F.broadcast(marker)).drop("_d")  # one row


# --- B, C ----------------------------------------------------------------------------------------------------------

SELECTED = [g * 3 for g in range(60)]


@query("b9_restrict_genes", f"SELECT bx, by_, CAST(sum(CASE WHEN gene_id % 3 = 0 AND gene_id < 180 THEN 1 ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN gene_id % 3 = 0 AND gene_id < 180 THEN gene_id // 3 * cnt ELSE 0 END) AS BIGINT) AS weighed FROM {EXPR} e GROUP BY 1,2")
def _(fx):
    spots = E.bin_expression(fx["fx_records"]).groupBy("bx", "by_").agg(F.collect_list(F.struct("gene_id", "cnt")).alias("genes"))
    x = B.restrict_genes(spots, SELECTED, N_GENES)
    return x.select("bx", "by_", F.size("genes").cast("long").alias("tokens"), F.aggregate("genes", F.lit(0).cast("long"), lambda s, g: s + g["gene_id"] * g["cnt"]).alias("weighed"))


def mapped(fx):
    """Merged expression by symbol, and the symbols' vectors."""
    g = fx["fx_genes"].select("gene_id", S.gene_symbol(F.col("gene_name"), F.col("gene_identifier")).alias("symbol"))
    m = E.merge_symbols(E.bin_expression(fx["fx_records"]), g).withColumnRenamed("symbol", "gene_id")
    return m, fx["fx_embeddings"].select(F.col("symbol").alias("gene_id"), "embedding")


MERGED = f"(SELECT e.bx, e.by_, upper(gene_name) AS symbol, CAST(sum(cnt) AS BIGINT) AS cnt FROM {EXPR} e JOIN fx_genes USING (gene_id) GROUP BY 1,2,3)"
#: Two output columns: the sums of even and of odd dimensions, by halves.
PROJECT = "(SELECT symbol, d AS dim, CAST(round(list_sum([CASE WHEN i % 2 = d THEN 0.5E0*CAST(embedding[i+1] AS DOUBLE) ELSE 0 END for i in range(len(embedding))])*1e6) AS BIGINT) AS v FROM fx_embeddings, range(2) t(d))"


@query("c13_project_and_pool", f"SELECT bx, by_, dim, CAST(sum(cnt*v) AS BIGINT) AS value, count(*) AS nnz FROM {MERGED} s JOIN {PROJECT} v USING (symbol) GROUP BY bx, by_, dim")
def _(fx):
    m, v = mapped(fx)
    width = v.select(F.size("embedding")).first()[0]
    x = E.project_and_pool(m, v, [[0.5 if i % 2 == d else 0.0 for i in range(width)] for d in (0, 1)])
    return x.withColumn("value", F.round(F.col("value") * F.col("nnz") * 1e6).cast("long"))


VECTORS = "(SELECT symbol, unnest(range(1, len(embedding)+1)) AS dim, CAST(round(CAST(unnest(embedding) AS DOUBLE)*1e6) AS BIGINT) AS v FROM fx_embeddings)"
POOLED = f"(SELECT bx, by_, dim, sum(cnt*v)/count(*)/1e6 AS value, count(*) AS nnz FROM {MERGED} s JOIN {VECTORS} v USING (symbol) GROUP BY bx, by_, dim)"


@query(
    "c14_embedding_probe",
    f"SELECT spots, round(norm_mean, 5) AS norm_mean, round(norm_std, 5) AS norm_std, round(norm_min, 5) AS norm_min, round(norm_max, 5) AS norm_max, round(genes_mean, 6) AS genes_mean, genes_min, genes_max, genes_median, zero_spots, round(dim_std_mean, 5) AS dim_std_mean, round(dim_std_min, 5) AS dim_std_min, round(dim_std_max, 5) AS dim_std_max FROM"
    f" (SELECT count(*) AS spots, avg(norm) AS norm_mean, stddev_pop(norm) AS norm_std, min(norm) AS norm_min, max(norm) AS norm_max, avg(nnz) AS genes_mean, min(nnz) AS genes_min, max(nnz) AS genes_max, quantile_cont(nnz, 0.5) AS genes_median, count(*) FILTER (WHERE nnz = 0) AS zero_spots FROM (SELECT bx, by_, coalesce(norm, 0) AS norm, coalesce(nnz, 0) AS nnz FROM fx_bins LEFT JOIN (SELECT bx, by_, sqrt(sum(value*value)) AS norm, max(nnz) AS nnz FROM {POOLED} p GROUP BY 1,2) q USING (bx, by_)) z) a,"
    f" (SELECT avg(std) AS dim_std_mean, min(std) AS dim_std_min, max(std) AS dim_std_max FROM (SELECT sqrt(greatest(sum(value*value)/n - (sum(value)/n)*(sum(value)/n), 0)) AS std FROM {POOLED} p, (SELECT count(*) AS n FROM fx_bins) c GROUP BY dim, n) y) b",
)
def _(fx):
    x = E.embedding_probe(E.pool_embeddings(*mapped(fx)), fx["fx_bins"])
    return rounded(rounded(x, *(f"norm_{k}" for k in ("mean", "std", "min", "max")), *(f"dim_std_{k}" for k in ("mean", "min", "max")), digits=5), "genes_mean")


def hvg_sql(expr: str, spots: str, top: int, least: int) -> str:
    """C16 over expr (.., gene_id, cnt) with spots rows."""
    cuts = [i / 20 for i in range(1, 20)]
    return (
        f"SELECT gene_id, b, round(score, 6) AS score FROM (SELECT gene_id, b, (disp - avg(disp) OVER (PARTITION BY b))/greatest(stddev_pop(disp) OVER (PARTITION BY b), 1e-8) AS score FROM"
        f" (SELECT gene_id, disp, CAST(len([c for c in cuts if c < lm]) AS BIGINT) AS b FROM (SELECT gene_id, ln(1+s/n) AS lm, ln(greatest((q/n-(s/n)*(s/n))/greatest(s/n, 1e-12), 1e-12)) AS disp FROM"
        f" (SELECT gene_id, CAST(sum(cnt) AS DOUBLE) AS s, CAST(sum(cnt*cnt) AS DOUBLE) AS q, count(*) AS seen FROM {expr} e GROUP BY 1) g, {spots} m WHERE seen >= {least} AND q/n-(s/n)*(s/n) > 0) h,"
        f" (SELECT quantile_cont(ln(1+s/n), {cuts}) AS cuts FROM (SELECT gene_id, CAST(sum(cnt) AS DOUBLE) AS s, CAST(sum(cnt*cnt) AS DOUBLE) AS q, count(*) AS seen FROM {expr} e GROUP BY 1) g, {spots} m WHERE seen >= {least} AND q/n-(s/n)*(s/n) > 0) k) z) y ORDER BY round(score, 9) DESC, gene_id LIMIT {top}"
    )


ORACLE_SQL["c16_select_hvg"] = oracle(hvg_sql(EXPR, "(SELECT CAST(count(*) AS DOUBLE) AS n FROM fx_bins)", 50, 20))
NUCLEAR = "(SELECT nucleus_id, gene_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM fx_records JOIN fx_labels USING (x, y) WHERE nucleus_id > 0 GROUP BY 1,2)"


@query("c17_common_hvg", f"SELECT gene_id, 'most dispersed over nuclei' AS rule FROM ({hvg_sql(NUCLEAR, '(SELECT CAST(count(DISTINCT nucleus_id) AS DOUBLE) AS n FROM ' + NUCLEAR + ' u)', 40, 1)}) h")
def _(fx):
    n = E.label_expression(fx["fx_records"], fx["fx_labels"], "nucleus_id").withColumnRenamed("label", "nucleus")
    return V.common_hvg(n, fx["fx_records"].select("gene_id"), 40)


@query("c10_quantile_summary", "SELECT round(quantile_cont(umi, 0.1), 6) AS p10, round(quantile_cont(umi, 0.5), 6) AS p50, round(quantile_cont(umi, 0.9), 6) AS p90, round(avg(umi), 6) AS mean, CAST(min(umi) AS DOUBLE) AS min, CAST(max(umi) AS DOUBLE) AS max FROM (SELECT CAST(sum(cnt) AS DOUBLE) AS umi FROM fx_records GROUP BY bx, by_) q")
def _(fx):
    return rounded(E.quantile_summary(E.bin_stats(E.bin_expression(fx["fx_records"])), "umi"), "p10", "p50", "p90", "mean")


@query("c18_confusion", "SELECT a.t AS target, b.k AS predicted, CAST(count(f.x) AS BIGINT) AS n FROM range(16) a(t) CROSS JOIN range(16) b(k) LEFT JOIN (SELECT x, target, predicted FROM fx_pred WHERE foreground = 1) f ON f.target = a.t AND f.predicted = b.k GROUP BY 1,2")
def _(fx):
    return E.confusion(fx["fx_pred"])


@query("c20_weighted_loss", "SELECT round(avg(CASE WHEN foreground=1 THEN ln(list_sum([exp((k*target % 5)/10.0) for k in range(16)])) - (target*target % 5)/10.0 ELSE 0 END), 6) AS direction_loss, round(avg((greatest(p-0.5, 0)-(p-0.5)*foreground+ln(1+exp(-abs(p-0.5))))*CASE WHEN foreground=1 THEN n/(2.0*f) ELSE n/(2.0*(n-f)) END), 6) AS foreground_loss FROM fx_pred, (SELECT count(*) AS n, sum(foreground) AS f FROM fx_pred) w")
def _(fx):
    logits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (k * F.col("target") % 5) / 10.0)
    x = fx["fx_pred"].withColumns({"logits": logits, "z": F.col("p") - 0.5})
    return rounded(E.prediction_loss(x, E.class_weights(x)), "direction_loss", "foreground_loss")


@query("c25_missing_genes", "SELECT g.gene_id, upper(gene_name) AS symbol, CAST(coalesce(umi, 0) AS BIGINT) AS umi FROM fx_genes g LEFT JOIN (SELECT gene_id, sum(cnt) AS umi FROM fx_records GROUP BY 1) u USING (gene_id) WHERE upper(gene_name) NOT IN (SELECT symbol FROM fx_embeddings)")
def _(fx):
    return E.missing_genes(fx["fx_records"], fx["fx_genes"].select("gene_id", F.upper("gene_name").alias("symbol")), fx["fx_embeddings"])


@query("c25_emptied_bins", f"SELECT count(*) AS bins, count(*) FILTER (WHERE k = 0) AS emptied FROM (SELECT bx, by_, count(*) FILTER (WHERE gene_id IN (SELECT gene_id FROM fx_genes WHERE upper(gene_name) IN (SELECT symbol FROM fx_embeddings))) AS k FROM {EXPR} e GROUP BY 1,2) q")
def _(fx):
    return E.emptied_bins(E.bin_expression(fx["fx_records"]), fx["fx_genes"].select("gene_id", F.upper("gene_name").alias("symbol")), fx["fx_embeddings"])


# tiles of 50 bins with states and splits by integer rules
REPORT_TILES = "(SELECT CAST(floor(bx/50) AS BIGINT)*100+CAST(floor(by_/50) AS BIGINT) AS id, count(*) AS records FROM fx_bins GROUP BY 1)"
STATE_SQL = "CASE WHEN id % 5 = 3 THEN 'failed' WHEN id % 5 = 4 THEN NULL WHEN id % 7 = 6 THEN 'empty' ELSE 'prepared' END"


def report_tiles(fx):
    t = fx["fx_bins"].groupBy((F.floor(F.col("bx") / 50) * 100 + F.floor(F.col("by_") / 50)).cast("long").alias("id")).agg(F.count("*").alias("records"))
    state = F.when(F.col("id") % 5 == 3, "failed").when(F.col("id") % 5 == 4, None).when(F.col("id") % 7 == 6, "empty").otherwise("prepared")
    return t.withColumn("split", F.when(F.col("id") % 3 == 0, "validation").otherwise("train")), t.select("id", state.alias("state")).filter("state is not null")


@query(
    "c26_point_counts",
    "SELECT count(*) AS tiles, count(*) FILTER (WHERE state IN ('prepared','empty')) AS prepared_tiles, count(*) FILTER (WHERE state='empty') AS empty_tiles, count(*) FILTER (WHERE state IN ('pending','failed')) AS pending_tiles, count(*) FILTER (WHERE state='failed') AS failed_tiles, "
    + ", ".join(f"CAST(coalesce(sum(CASE WHEN split='{k}' THEN {c} END), 0) AS BIGINT) AS {k}_{n}" for k in ("train", "validation") for c, n in (("fg", "foreground"), ("bg", "background"), ("planned", "planned")))
    + f", CAST(sum(centres) AS BIGINT) AS centres_with_halo, CAST(sum(core) AS BIGINT) AS centres_core_unique, CASE WHEN count(*) FILTER (WHERE state IN ('pending','failed')) > 0 THEN 'prepared tiles only; incomplete' ELSE 'whole slide' END AS scope FROM (SELECT *, least(fg, 200) + least(bg, 200, CASE WHEN fg > 0 THEN least(fg, 200) ELSE 200 END) AS planned FROM (SELECT id, coalesce({STATE_SQL}, 'pending') AS state, CASE WHEN id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, coalesce(fg, 0) AS fg, coalesce(bg, 0) AS bg, coalesce(centres, 0) AS centres, coalesce(core, 0) AS core FROM {REPORT_TILES} t LEFT JOIN (SELECT CAST(floor(bx/50) AS BIGINT)*100+CAST(floor(by_/50) AS BIGINT) AS id, count(*) FILTER (WHERE bx % 5 > 0 AND foreground=1) AS fg, count(*) FILTER (WHERE bx % 5 > 0 AND foreground=0) AS bg, count(*) AS centres, count(*) FILTER (WHERE by_ % 4 > 0) AS core FROM fx_samples GROUP BY 1) s USING (id)) q) z",
)
def _(fx):
    tiles, status = report_tiles(fx)
    s = fx["fx_samples"].select((F.floor(F.col("bx") / 50) * 100 + F.floor(F.col("by_") / 50)).cast("long").alias("id"), F.col("foreground"), (F.col("bx") % 5 > 0).alias("eligible"), (F.col("by_") % 4 > 0).alias("in_core"))
    return Z.point_counts(tiles, status, s, 200)


@query("c27_progress", f"SELECT CASE WHEN s IS NULL THEN 'pending' WHEN s = 'prepared' THEN 'done' ELSE s END AS state, count(*) AS tiles, CAST(sum(records) AS BIGINT) AS records FROM (SELECT records, {STATE_SQL} AS s FROM {REPORT_TILES} t) q GROUP BY 1")
def _(fx):
    tiles, status = report_tiles(fx)
    done = status.withColumn("state", F.when(F.col("state") == "prepared", "done").otherwise(F.col("state")))
    return J.progress(tiles, done.unionByName(done.withColumn("state", F.lit("active"))))


@query("c29_context_reach_nuclei", None)
def _(fx):
    n = fx["fx_anchor_labels"].select((F.col("x") / 3).cast("long").alias("bx"), (F.col("y") / 3).cast("long").alias("by_"), "nucleus_id")
    return rounded(E.context_reach(D.ring_neighbors(fx["fx_bins"]), n), "p50", "p90", "p99", "outside_with_nucleus")


ORACLE_SQL["c29_context_reach_nuclei"] = oracle("SELECT 1 FROM fx_bins", "fx_bins", "fx_anchor_labels").replace(
    " SELECT 1 FROM fx_bins",
    RING_SQL
    + "SELECT round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99, round(avg(CASE WHEN own = 0 THEN CAST(near > 0 AS INT) END), 6) AS outside_with_nucleus FROM (SELECT bx, by_, sqrt(max((nx-bx)*(nx-bx)+(ny-by_)*(ny-by_)))*3 AS d, sum(CAST(nucleus_id > 0 AS INT)) AS near, sum(CAST(rank = 0 AND nucleus_id > 0 AS INT)) AS own FROM nb50 JOIN fx_anchor_labels ON x = 3*nx AND y = 3*ny GROUP BY bx, by_) q",
)


@query("c31_eligible_patches", f"SELECT patch, coalesce(nuclei, 0) AS nuclei, CASE WHEN nuclei > 0 THEN 'ready' ELSE 'no_eligible_nuclei' END AS state FROM (SELECT DISTINCT {TILE_ID} AS patch FROM fx_spots) p LEFT JOIN (SELECT patch, count(*) AS nuclei FROM (SELECT {TILE_ID} AS patch, nucleus_id FROM fx_labels WHERE nucleus_id > 0 GROUP BY 1,2 HAVING count(*) >= 60) e GROUP BY 1) q USING (patch)")
def _(fx):
    lab = fx["fx_labels"].withColumn("patch", tile_id())
    n = lab.filter("nucleus_id > 0").groupBy("patch", "nucleus_id").agg((F.count("*") >= 60).alias("eligible"))
    return E.eligible_patches(fx["fx_spots"].select(tile_id().alias("patch")).distinct(), n)


# --- D, E, G ---------------------------------------------------------------------------------------------------------


@query("d10_overlap_box", "SELECT printf('x%02d_y%02d', a.ix, a.iy) AS a, printf('x%02d_y%02d', b.ix, b.iy) AS b, greatest(a.ix, b.ix)*150-12 AS x0, greatest(a.iy, b.iy)*150-12 AS y0, least(a.ix*150+least(150, s-a.ix*150), b.ix*150+least(150, s-b.ix*150))+12 AS x1, least(a.iy*150+least(150, s-a.iy*150), b.iy*150+least(150, s-b.iy*150))+12 AS y1 FROM (SELECT max(s) AS s FROM fx_records) m, (SELECT ix, iy FROM range(100) a(ix), range(100) b(iy)) a, (SELECT ix, iy FROM range(100) a(ix), range(100) b(iy)) b WHERE a.ix*150 < s AND a.iy*150 < s AND b.ix*150 < s AND b.iy*150 < s AND (b.ix-a.ix, b.iy-a.iy) IN ((0,1),(1,-1),(1,0),(1,1))")
def _(fx):
    n = side(fx)
    t = B.make_tiles(fx.spark, n, n, 150, 12)
    return Z.overlap_box(t, D.adjacent_tiles(t))


IDENTITIES = f"(SELECT tile, cell_a+tile*10 AS label, cell_a AS global_id FROM (SELECT DISTINCT tile, cell_a FROM {TILED} t) q WHERE cell_a % 4 > 0)"


def identities(fx):
    x = seam_edges(fx)[0].select("tile", "label").distinct()
    return x.select("tile", "label", (F.col("label") - F.col("tile") * 10).alias("global_id")).filter("global_id % 4 > 0")


@query("d15_shared_identity", f"SELECT t.tile, cell_a+t.tile*10 AS label, coalesce(global_id, 0) AS global_id, count(*) AS pixels FROM {TILED} t LEFT JOIN {IDENTITIES} i ON i.tile = t.tile AND i.label = cell_a+t.tile*10 GROUP BY 1,2,3")
def _(fx):
    return H.attach_shared_identity(seam_edges(fx)[0], identities(fx)).groupBy("tile", "label", "global_id").agg(F.count("*").alias("pixels"))


@query("d18_reconcile", f"SELECT cell, n_umis + CASE WHEN cell % 3 = 0 THEN 1 ELSE 0 END AS reported, n_umis AS recomputed FROM {CELLS_SQL} c WHERE cell % 3 = 0")
def _(fx):
    c = E.cell_qc_metrics(fx["fx_records"], fx["fx_labels"], "cell_a")
    r = c.withColumn("n_umis", F.col("n_umis") + (F.col("cell") % 3 == 0).cast("long"))
    return J.reconcile(r, c, ["cell"], "n_umis")


@query("e11_representative_tiles", f"SELECT role, id FROM (WITH t AS (SELECT id, umis, id % 11 AS shift FROM (SELECT {TILE_ID} AS id, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records GROUP BY 1) q), u AS (SELECT *, row_number() OVER (ORDER BY umis, id) AS r, count(*) OVER () AS n, row_number() OVER (ORDER BY shift DESC, id) AS m FROM t) SELECT 'most' AS role, id FROM u WHERE r = n UNION ALL SELECT 'median', id FROM u WHERE r = n//2+1 UNION ALL SELECT 'moved', id FROM u WHERE m = 1) z")
def _(fx):
    t = fx["fx_records"].groupBy(tile_id().alias("id")).agg(F.sum("cnt").cast("long").alias("umis"))
    return Z.representative_tiles(t.withColumns({"nuclei": F.lit(1), "shift": F.col("id") % 11}))


@query("g3_gene_text", "SELECT CAST(p_partkey AS BIGINT) AS gene_id, concat_ws(' ', concat('Gene symbol: ', p_name, '.'), concat('Name: ', p_type, '.'), concat('Aliases: ', array_to_string(list_sort(list_distinct([upper(p_brand), upper(p_type)])), ', '), '.'), concat('Other designations: ', substr(p_brand, 1, 512), '.')) AS text FROM part")
def _(fx):
    p = fx["part"]
    g = p.select(F.col("p_partkey").cast("long").alias("gene_id"), F.col("p_name").alias("symbol"), F.col("p_type").alias("name"), F.array(F.upper("p_brand"), F.upper("p_type")).alias("synonyms"), F.col("p_brand").alias("designations"), F.array().cast("array<string>").alias("summaries"))
    return G.gene_text(g)


# --- H -----------------------------------------------------------------------------------------------------------------


@query("h2_global_cells", f"SELECT x, y, dense_rank() OVER (ORDER BY root, cell_a+10*root) AS cell FROM (SELECT x, y, cell_a, min(tile) OVER (PARTITION BY cell_a) AS root FROM {TILED} t) q")
def _(fx):
    pixels, edges = seam_edges(fx)
    return H.global_cells(pixels, H.reconcile_labels(edges, pixels.select("tile", "label")))


OBS = "(SELECT cell_a AS cell, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM fx_labels WHERE cell_a > 0 GROUP BY 1)"


@query("h4_slide_cell_matrix", f"SELECT cell, area, round(cx, 6) AS cx, round(cy, 6) AS cy, coalesce(n_spots, 0) AS n_spots, coalesce(n_umis, 0) AS n_umis, coalesce(n_genes, 0) AS n_genes FROM {OBS} o LEFT JOIN {CELLS_SQL} c USING (cell)")
def _(fx):
    return rounded(slide_matrix(fx).obs, "cx", "cy")


@query("h4_totals", "SELECT count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis, CAST(sum(CASE WHEN cell_a > 0 THEN cnt ELSE 0 END) AS BIGINT) AS assigned_umis, count(DISTINCT (x, y)) AS spots, count(DISTINCT CASE WHEN cell_a > 0 THEN (x, y) END) AS assigned_spots FROM fx_records JOIN fx_labels USING (x, y)")
def _(fx):
    return slide_matrix(fx).totals


def slide_matrix(fx):
    n = -(-side(fx) // 150)
    r = fx["fx_records"].select("x", "y", "gene_id", "cnt")
    return Z.slide_cell_matrix(D.halo_records(r, 150, 12, F.lit(n), F.lit(n)), fx["fx_labels"].select("x", "y", F.col("cell_a").alias("cell")), 150, r)


@query("h5_export_patches", "SELECT px, py, x, y, dense_rank() OVER (PARTITION BY px, py ORDER BY cell_a) AS local_id, dense_rank() OVER (ORDER BY px, py, cell_a) AS cell FROM (SELECT CAST(floor(x/150) AS BIGINT) AS px, CAST(floor(y/150) AS BIGINT) AS py, x, y, cell_a FROM fx_labels WHERE cell_a > 0) q")
def _(fx):
    return Z.export_patches(fx["fx_labels"].select("x", "y", F.col("cell_a").alias("label")), 150)


HALOED = "(SELECT ix*100+iy AS tile, x, y, {c} AS label FROM fx_labels, range(100) a(ix), range(100) b(iy) WHERE {c} > 0 AND x >= ix*150-12 AND x < ix*150+162 AND y >= iy*150-12 AND y < iy*150+162 AND ix*150 < (SELECT max(s) FROM fx_records) AND iy*150 < (SELECT max(s) FROM fx_records))"


@query(
    "h6_seam_agreement",
    "WITH_ SELECT tile_a, tile_b, spots, round(same_identity, 6) AS same_identity, mutual_matches FROM (SELECT tile_a, tile_b, CAST(sum(n) AS BIGINT) AS spots, CAST(sum(CASE WHEN la % 4 = lb % 4 AND la = lb THEN n ELSE 0 END) AS DOUBLE)/sum(n) AS same_identity, count(*) FILTER (WHERE ra = 1 AND rb = 1) AS mutual_matches FROM (SELECT *, row_number() OVER (PARTITION BY tile_a, tile_b, la ORDER BY n DESC, lb) AS ra, row_number() OVER (PARTITION BY tile_a, tile_b, lb ORDER BY n DESC, la) AS rb FROM (SELECT a.tile AS tile_a, b.tile AS tile_b, a.label AS la, b.label AS lb, count(*) AS n FROM hx a JOIN hy b USING (x, y) WHERE a.tile < b.tile GROUP BY 1,2,3,4) p) q GROUP BY 1,2) z".replace("WITH_ ", "").replace("hx a", HALOED.replace("{c}", "cell_a") + " a").replace("hy b", HALOED.replace("{c}", "cell_a") + " b"),
)
def _(fx):
    n = -(-side(fx) // 150)
    lab = fx["fx_labels"].filter("cell_a > 0").select("x", "y", F.col("cell_a").alias("label"))
    h = D.halo_records(lab, 150, 12, F.lit(n), F.lit(n)).filter("x >= ix*150-12 and x < ix*150+162 and y >= iy*150-12 and y < iy*150+162")
    h = h.select((F.col("ix") * 100 + F.col("iy")).alias("tile"), "x", "y", "label")
    ids = h.select("tile", "label").distinct().withColumn("global_id", F.col("label"))
    return rounded(Z.seam_agreement(h, ids), "same_identity")


# --- I -----------------------------------------------------------------------------------------------------------------

BEST_OF = "(SELECT nucleus_id AS nucleus, {c} AS {n} FROM (SELECT nucleus_id, {c}, row_number() OVER (PARTITION BY nucleus_id ORDER BY count(*) DESC, {c}) AS r FROM fx_labels WHERE nucleus_id > 0 AND {c} > 0 GROUP BY 1,2) q WHERE r = 1)"
PAIRED = f"(SELECT nucleus, a, b FROM {BEST_OF.format(c='cell_a', n='a')} x JOIN {BEST_OF.format(c='cell_b', n='b')} y USING (nucleus))"


def zero_pearson(n, **k):
    return "coalesce(" + PEARSON_SQL.format(n=n, **k) + ", 0)"


I4_SQL = (
    "SELECT nucleus, a AS cell_a, b AS cell_b, so AS umis_shared, sa AS umis_a, sb AS umis_b, round(" + zero_pearson(N_GENES, a="so", b="sa", aa="soo", bb="saa", ab="soa") + ", 5) AS correlation_a, round(" + zero_pearson(N_GENES, a="so", b="sb", aa="soo", bb="sbb", ab="sob") + ", 5) AS correlation_b"
    " FROM " + PAIRED + " p JOIN (SELECT a, b, CAST(sum(o) AS BIGINT) AS so, CAST(sum(u) AS BIGINT) AS sa, CAST(sum(v) AS BIGINT) AS sb, CAST(sum(o*o) AS BIGINT) AS soo, CAST(sum(u*u) AS BIGINT) AS saa, CAST(sum(v*v) AS BIGINT) AS sbb, CAST(sum(o*u) AS BIGINT) AS soa, CAST(sum(o*v) AS BIGINT) AS sob FROM"
    " (SELECT a, b, gene_id, sum(CASE WHEN cell_a = a AND cell_b = b THEN cnt ELSE 0 END) AS o, sum(CASE WHEN cell_a = a AND cell_b <> b THEN cnt ELSE 0 END) AS u, sum(CASE WHEN cell_b = b AND cell_a <> a THEN cnt ELSE 0 END) AS v FROM (SELECT DISTINCT a, b FROM " + PAIRED + " d) d JOIN (SELECT cell_a, cell_b, gene_id, cnt FROM fx_records JOIN fx_labels USING (x, y)) r ON cell_a = a OR cell_b = b GROUP BY 1,2,3) g GROUP BY 1,2) s USING (a, b) WHERE least(so, sa, sb) >= 100"
)


@query("i4_paired_consistency", I4_SQL)
def _(fx):
    return rounded(V.paired_consistency(fx["fx_records"], fx["fx_labels"], "cell_a", "cell_b", N_GENES), "correlation_a", "correlation_b", digits=5).select("nucleus", "cell_a", "cell_b", "umis_shared", "umis_a", "umis_b", "correlation_a", "correlation_b")


@query("i4_consistency_summary", f"SELECT count(*) AS nuclei, count(DISTINCT (cell_a, cell_b)) AS unique_pairs, round(avg(correlation_a), 4) AS mean_a, round(avg(correlation_b), 4) AS mean_b, round(avg(correlation_a-correlation_b), 4) AS difference FROM ({I4_SQL}) q")
def _(fx):
    x = V.paired_consistency(fx["fx_records"], fx["fx_labels"], "cell_a", "cell_b", N_GENES)
    return rounded(V.consistency_summary(x), "mean_a", "mean_b", "difference", digits=4)


@query("i5_iou_summary")
def _(fx):
    m = fx["fx_records"].join(fx["fx_labels"].filter("manual_cell > 0").select("x", "y", F.col("manual_cell").alias("manual"), F.col("cell_b").alias("predicted")), ["x", "y"])
    return rounded(C.iou_summary(C.transcript_iou(m)), "matched_only_mean", "matched_only_median", "all_gt_mean", "all_gt_median", "recall50")


@query("i6_instance_iou")
def _(fx):
    """Assignment of greatest total IoU; not SQL, tests hold it against all assignments of small cases."""
    return rounded(V.instance_iou(fx["fx_labels"].select(F.col("manual_cell").alias("gt"), F.col("cell_b").alias("predicted"))), "iou")


ENHANCED = "(SELECT s.x, s.y, e.gene_id, sum(e.c*w) AS v FROM (SELECT x, y, gene_id, sum(cnt) AS c FROM fx_records GROUP BY 1,2,3) e, (SELECT a AS dx, b AS dy, 1.0E0/greatest(a*a+b*b, 1) AS w FROM range(-2, 3) p(a), range(-2, 3) q(b) WHERE a*a+b*b <= 4) o JOIN fx_spots s ON s.x = e.x+dx AND s.y = e.y+dy GROUP BY 1,2,3)"


def fano_sql(members: str) -> str:
    """(grp, n, fano) of members (grp, x, y) over enhanced expression."""
    return f"(SELECT grp, any_value(n) AS n, quantile_cont(greatest((q-s*s/n)/(n-1), 0)/(s/n), 0.5) AS fano FROM (SELECT grp, gene_id, sum(v) AS s, sum(v*v) AS q FROM {members} m JOIN {ENHANCED} e USING (x, y) GROUP BY 1,2) g JOIN (SELECT grp, count(*) AS n FROM {members} m GROUP BY 1) c USING (grp) WHERE n >= 2 AND s > 0 GROUP BY grp)"


def members_sql(label: str) -> str:
    return f"(SELECT {label} AS grp, x, y FROM fx_labels WHERE {label} > 0)"


WINDOW = "(SELECT cell AS grp, x, y FROM (SELECT nucleus_id AS cell, avg(x) AS cx, avg(y) AS cy FROM fx_labels WHERE nucleus_id > 0 GROUP BY 1) c JOIN fx_spots s ON abs(x-cx) <= 20 AND abs(y-cy) <= 20)"
PURITY = f"SELECT nucleus, p.a AS cell_a, p.b AS cell_b, fa.n AS spots_a, fb.n AS spots_b, fw.n AS spots_window, fa.fano/fw.fano AS purity_a, fb.fano/fw.fano AS purity_b FROM {PAIRED} p JOIN {fano_sql(members_sql('cell_a'))} fa ON fa.grp = p.a JOIN {fano_sql(members_sql('cell_b'))} fb ON fb.grp = p.b JOIN {fano_sql(WINDOW)} fw ON fw.grp = nucleus WHERE least(fa.n, fb.n, fw.n) > 100 AND fw.fano > 0"


@query("i7_paired_purity", f"SELECT nucleus, cell_a, cell_b, spots_a, spots_b, spots_window, round(purity_a, 5) AS purity_a, round(purity_b, 5) AS purity_b FROM ({PURITY}) q")
def _(fx):
    return rounded(V.paired_purity(fx["fx_records"], fx["fx_labels"], "cell_a", "cell_b", 2), "purity_a", "purity_b", digits=5)


@query("i9_pseudolabel_audit", "SELECT count(*) AS molecules, round(avg(CAST(f = 1 AS INT)), 6) AS positive, round(avg(CAST(f = 0 AS INT)), 6) AS background, round(avg(CAST(f = -1 AS INT)), 6) AS unknown FROM (SELECT coalesce(CASE WHEN (bx+by_) % 3 = 0 THEN foreground END, -1) AS f FROM fx_records JOIN fx_labels USING (x, y) JOIN fx_samples USING (bx, by_) WHERE manual_cell > 0) q")
def _(fx):
    m = fx["fx_records"].join(fx["fx_labels"].filter("manual_cell > 0").select("x", "y"), ["x", "y"]).select("x", "y")
    return rounded(C.pseudolabel_audit(m, fx["fx_samples"].filter("(bx+by_) % 3 = 0")), "positive", "background", "unknown")


@query("i14_evaluation_gene_audit", f"SELECT round(avg(CASE WHEN upper(gene_name) IN (SELECT symbol FROM fx_embeddings) THEN 1 ELSE 0 END), 6) AS mapped_share, any_value(fallback_share) AS fallback_share FROM (SELECT DISTINCT {TILE_ID} AS patch, gene_id FROM fx_records) c LEFT JOIN fx_genes USING (gene_id), (SELECT round(sum(CASE WHEN k < 400 THEN u ELSE 0 END)/sum(u), 6) AS fallback_share FROM (SELECT {TILE_ID} AS patch, sum(cnt) AS u, count(DISTINCT (x, y)) AS k FROM fx_records GROUP BY 1) p) f")
def _(fx):
    r = fx["fx_records"].withColumn("patch", tile_id())
    known = fx["fx_genes"].select("gene_id", F.upper("gene_name").alias("symbol")).join(fx["fx_embeddings"].select("symbol"), "symbol", "left_semi")
    patches = r.groupBy("patch").agg(F.sum("cnt").alias("umis"), (F.count_distinct("x", "y") < 400).alias("fallback"))
    return rounded(V.evaluation_gene_audit(r.select("patch", "gene_id").distinct(), known, patches), "mapped_share", "fallback_share")


@query("i15_cross_sensitivity")
def _(fx):
    x = C.cross_correlation(fx["fx_records"], fx["fx_labels"], "cell_a", "cell_b", N_GENES)
    return rounded(C.cross_sensitivity(x), "difference", digits=4)


def _body(name: str) -> tuple[str, str]:
    """The WITH entries and the final SELECT of a registered text."""
    text = ORACLE_SQL[name]
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and text[i : i + 2] == ") ":
            return text[: i + 1], text[i + 2 :]
    raise ValueError(name)


_with, _select = _body("i3_cross_correlation")
ORACLE_SQL["i15_cross_sensitivity"] = f"{_with} SELECT count(*) AS n, round(avg(target_correlation-source_correlation), 4) AS difference FROM ({_select}) q WHERE enough"
_with, _select = _body("i5_transcript_iou")
_select = _select.replace("round(CASE WHEN mutual THEN n/(na+nb-n) ELSE 0 END, 6)", "CASE WHEN mutual THEN n/(na+nb-n) ELSE 0 END")
ORACLE_SQL["i5_iou_summary"] = f"{_with} SELECT count(*) AS manual_cells, count(*) FILTER (WHERE mutual) AS mutual_matches, round(avg(CASE WHEN mutual THEN iou END), 6) AS matched_only_mean, round(quantile_cont(CASE WHEN mutual THEN iou END, 0.5), 6) AS matched_only_median, round(avg(iou), 6) AS all_gt_mean, round(quantile_cont(iou, 0.5), 6) AS all_gt_median, round(avg(CAST(iou >= 0.5 AS INT)), 6) AS recall50 FROM ({_select}) q"


# --- J, L --------------------------------------------------------------------------------------------------------------


@query("j2_incomplete", f"SELECT id, coalesce(s, 'missing') AS state FROM (SELECT id, {STATE_SQL} AS s FROM {REPORT_TILES} t) q WHERE s IS NULL OR s NOT IN ('prepared', 'empty')")
def _(fx):
    tiles, status = report_tiles(fx)
    done = status.select("id", F.when(F.col("state") == "prepared", "done").otherwise(F.col("state")).alias("state"), F.lit("f").alias("fingerprint"))
    return J.incomplete(tiles, done)


@query("j4_validate_preparation")
def _(fx):
    """Samples with broken rules planted by integer rules: a class of 2, and an eligibility that is not recomputed."""
    s = fx["fx_samples"].select(
        F.col("tile").alias("id"), "bx", "by_", F.col("bx").alias("x"), F.col("by_").alias("y"), F.array_repeat(F.lit(1).cast("long"), 50).alias("neighbors"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"),
        F.when(F.col("bx") % 40 == 7, 2).otherwise(F.col("foreground")).alias("foreground"), (F.col("by_") % 3 > 0).alias("interior"),
    )
    right = F.col("interior") & (F.col("foreground") >= 0) & (F.col("bx") % 40 != 7)
    s = s.withColumn("eligible", F.when(F.col("by_") % 50 == 9, ~right).otherwise(right))
    tiles = fx["fx_samples"].groupBy(F.col("tile").alias("id")).agg(F.count("*").alias("records")).withColumn("bins", F.lit(100))
    have = s.groupBy("id").agg(*(F.count_if(F.col("eligible") & (F.col("foreground") == v)).alias(n) for n, v in (("foreground", 1), ("background", 0)))).withColumn("state", F.lit("prepared"))
    return J.validate_preparation(s, tiles, have)


_S = "(SELECT CAST(floor(bx/50) AS BIGINT) AS id, by_ % 3 > 0 AS interior, CASE WHEN bx % 40 = 7 THEN 2 ELSE foreground END AS fg, CASE WHEN by_ % 50 = 9 THEN NOT (by_ % 3 > 0 AND bx % 40 <> 7) ELSE by_ % 3 > 0 AND bx % 40 <> 7 END AS eligible FROM fx_samples)"
ORACLE_SQL["j4_validate_preparation"] = oracle(f"SELECT id, 'class' AS rule, count(*) AS n FROM {_S} s WHERE fg NOT IN (-1, 0, 1) GROUP BY 1 UNION ALL SELECT id, 'eligible' AS rule, count(*) AS n FROM {_S} s WHERE eligible <> (interior AND fg >= 0) GROUP BY 1")


@query("j6_mismatched", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'old' ELSE NULL END AS fingerprint FROM {REPORT_TILES} t WHERE id % 4 IN (0, 1)")
def _(fx):
    t = report_tiles(fx)[0].select("id", F.when(F.col("id") % 4 == 0, "old").when(F.col("id") % 4 == 1, None).otherwise("new").alias("fingerprint"))
    return J.mismatched(t, "new")


@query("j7_recheck_metrics", "SELECT tile, hits + CASE WHEN tile % 2 = 1 THEN 1 ELSE 0 END AS reported, hits AS recomputed FROM (SELECT CAST(floor(x/50) AS BIGINT) AS tile, CAST(sum(CASE WHEN foreground = 1 AND target = predicted THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM fx_pred GROUP BY 1) q WHERE tile % 2 = 1")
def _(fx):
    h = fx["fx_pred"].groupBy(F.floor(F.col("x") / 50).cast("long").alias("tile")).agg(F.sum(F.when((F.col("foreground") == 1) & (F.col("target") == F.col("predicted")), 1).otherwise(0)).cast("long").alias("hits"))
    return J.reconcile(h.withColumn("hits", F.col("hits") + F.col("tile") % 2), h, ["tile"], "hits")


def features(fx):
    """Pooled features of every bin with its class, as an array by dimension."""
    return fx["fx_samples"].join(E.pool_vectors(*mapped(fx)), ["bx", "by_"]).select(F.col("bx").alias("x"), F.col("by_").alias("y"), "features", "foreground", "direction")


@query("l1_score")
def _(fx):
    """The baseline (L3) trained on the bins of even rows scores all bins; iterative, so tests hold it against plain numpy."""
    x = features(fx)
    model = L.fit_baseline(x.filter("x % 2 = 0"), steps=5)
    return rounded(L.score(x, L.baseline_predictor(model)).select("x", "y", "p"), "p")


def count_letters():
    """An encoder for tests and queries: how often each of four letters occurs."""
    return lambda texts: np.array([[t.lower().count(c) for c in "aeio"] for t in texts], float).reshape(len(texts), 4)




@query("l2_encode_genes", "SELECT symbol, i AS dim, round(v[i+1]/greatest(sqrt(list_sum([w*w for w in v])), 1e-12), 5) AS value FROM (SELECT symbol, [CAST(length(t)-length(replace(t, c, '')) AS DOUBLE) for c in ['a', 'e', 'i', 'o']] AS v FROM (SELECT p_partkey AS symbol, lower(concat(p_name, ' ', p_type)) AS t FROM part) p) q, range(4) r(i)")
def _(fx):
    texts = fx["part"].select(F.col("p_partkey").cast("string").alias("symbol"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    x = L.encode_genes(texts, count_letters)
    return x.select(F.col("symbol").cast("long").alias("symbol"), F.posexplode("embedding").alias("dim", "v")).select("symbol", F.col("dim").cast("long").alias("dim"), F.round(F.col("v").cast("double"), 5).alias("value"))


# --- P -----------------------------------------------------------------------------------------------------------------


@query("p0_init_schema")
def _(fx):
    """The chosen genes in order with the fingerprint; tests hold it against its parts."""
    n = side(fx)
    s = P.init_schema(fx["fx_records"], n, n, 150, 12, per_tile=256, top=50, seed=7)
    return s.genes.crossJoin(s.fingerprint)  # one row


@query("p1_prepare_slide", None)
def _(fx):
    g = fx["fx_genes"].select("gene_id", F.upper("gene_name").alias("symbol"))
    p = P.prepare_slide(fx["fx_records"], fx["fx_anchor_labels"], g, fx["fx_embeddings"], 150, seed=7)
    tokens = p.tokens.groupBy("bx", "by_").agg(F.count("*").alias("tokens"), F.sum("cnt").cast("long").alias("umis"))
    return p.samples.join(tokens, ["bx", "by_"], "left").select("bx", "by_", "foreground", "tokens", "umis")


ORACLE_SQL["p1_prepare_slide"] = oracle("SELECT 1 FROM fx_records", "fx_records", "fx_bins", "fx_genes", "fx_embeddings", "fx_anchor_labels").replace(
    " SELECT 1 FROM fx_records",
    RING_SQL
    + ", cx AS (SELECT nucleus_id AS cell, avg(x) AS cx, avg(y) AS cy FROM fx_anchor_labels WHERE nucleus_id > 0 GROUP BY 1) SELECT c.bx, c.by_, CAST(CASE WHEN nucleus_id > 0 THEN 1 WHEN stain <= 10 AND NOT EXISTS (SELECT 1 FROM cx WHERE (l.x-cx)*(l.x-cx)+(l.y-cy)*(l.y-cy) <= 900) THEN 0 ELSE -1 END AS BIGINT) AS foreground, tokens, umis FROM (SELECT bx, by_ FROM nb50 WHERE rank = 0) c JOIN fx_anchor_labels l ON l.x = 3*c.bx AND l.y = 3*c.by_ LEFT JOIN (SELECT nb.bx, nb.by_, count(*) AS tokens, CAST(sum(cnt) AS BIGINT) AS umis FROM nb50 nb JOIN "
    + f"(SELECT s.* FROM {MERGED} s WHERE symbol IN (SELECT symbol FROM fx_embeddings)) e ON e.bx = nx AND e.by_ = ny GROUP BY 1,2) t USING (bx, by_)",
)


ODD = "(floor(3*bx/150)+floor(3*by_/150)) % 2 = 1"
_p1 = ORACLE_SQL["p1_prepare_slide"]


@query("p1_prepare_tiles")
def _(fx):
    """Every second tile from the written index: its samples are those of the whole slide."""
    n, path = side(fx), new_folder(fx.spark, "p1")
    raw = fx["fx_records"].select("seq", F.col("gene_id").alias("gene"), "x", "y", "cnt")
    i = P.index_slide(raw, f"{path}/index", 150)
    tiles = B.make_tiles(fx.spark, n, n, 150, 36).filter("(ix + iy) % 2 = 1")
    tiles = tiles.join(R.split_tiles(tiles.select("id"), 0.1, 7), "id")
    g = i.genes.select("gene_id", F.col("gene").alias("key")).join(fx["fx_genes"].select(F.col("gene_id").alias("key"), F.upper("gene_name").alias("symbol")), "key").drop("key")
    p = P.prepare_tiles(f"{path}/index", f"{path}/out", tiles, fx["fx_anchor_labels"], g, fx["fx_embeddings"], n, n, 150, 36, seed=7)
    tokens = p.tokens.groupBy("bx", "by_").agg(F.count("*").alias("tokens"), F.sum("cnt").cast("long").alias("umis"))
    return p.samples.join(tokens, ["bx", "by_"], "left").select("bx", "by_", "foreground", "tokens", "umis")


ORACLE_SQL["p1_prepare_tiles"] = f"SELECT * FROM ({_p1}) z WHERE {ODD}"


def evaluated(sql: str) -> str:
    """sql over the genes of C17 alone, which are all genes that nuclei express."""
    some = f"(SELECT * FROM fx_records WHERE gene_id IN (SELECT gene_id FROM {NUCLEAR.replace('fx_records', 'FX')} u))"
    sql = sql.replace("FROM fx_records", f"FROM {some} fx").replace("FX", "fx_records")
    return sql.replace(f"({N_GENES}*", f"((SELECT count(DISTINCT gene_id) FROM {NUCLEAR} u)*")


def table_row(label: str) -> str:
    half = SPLIT_SQL.replace("{split}", f"SELECT x, y, {label} AS cell, repeat, CAST(substr(md5(concat_ws(':', '7', CAST(repeat AS VARCHAR), CAST(x AS VARCHAR), CAST(y AS VARCHAR))), 1, 1) >= '8' AS BIGINT) AS side FROM fx_labels, range(10) t(repeat) WHERE {label} > 0").replace("round(avg(r), 5)", "avg(r)")
    line = SPLIT_SQL.replace("{split}", f"SELECT x, y, {label} AS cell, i AS repeat, CAST((x-cx)*(CASE WHEN i%2=1 THEN i ELSE 10-i END)+(y-cy)*(CASE WHEN i%2=1 THEN 10-i ELSE -i END) >= 0 AS BIGINT) AS side FROM fx_labels JOIN (SELECT {label}, CAST(floor(avg(x)) AS BIGINT) AS cx, CAST(floor(avg(y)) AS BIGINT) AS cy FROM fx_labels GROUP BY 1) c USING ({label}), range(10) t(i) WHERE {label} > 0").replace("round(avg(r), 5)", "avg(r)")
    cells = CELLS_SQL.replace("cell_a", label)
    letter = label[-1]
    half, line, purity = (evaluated(t) for t in (half, line, PURITY))
    return (
        f"SELECT 'slide' AS dataset, '{label}' AS method, count(*) AS cells, quantile_cont(n_umis, 0.5) AS median_umis, quantile_cont(n_genes, 0.5) AS median_genes, quantile_cont(n_spots, 0.5) AS median_spots,"
        f" count(CASE WHEN n_spots > 100 THEN h.correlation END) AS random_n, round(avg(CASE WHEN n_spots > 100 THEN h.correlation END), 4) AS random_mean, count(CASE WHEN n_spots > 100 THEN l.correlation END) AS directional_n, round(avg(CASE WHEN n_spots > 100 THEN l.correlation END), 4) AS directional_mean,"
        f" round(sum(n_umis)/(SELECT sum(cnt) FROM fx_records), 6) AS assigned_share, (SELECT round(avg(purity_{letter}), 4) FROM ({purity}) p) AS purity_mean FROM {cells} c LEFT JOIN ({half}) h USING (cell) LEFT JOIN ({line}) l USING (cell)"
    )


@query("p2_compare_labelings", f"SELECT * FROM ({table_row('cell_a')}) a UNION ALL SELECT * FROM ({table_row('cell_b')}) b")
def _(fx):
    x = P.compare_labelings(fx["fx_records"], fx["fx_labels"], "cell_a", "cell_b", seed=7).table
    x = rounded(rounded(x, "random_mean", "directional_mean", "purity_mean", digits=4), "assigned_share")
    return x.drop("purity_median")


QUERIES["c30_comparison_table"], ORACLE_SQL["c30_comparison_table"] = QUERIES["p2_compare_labelings"], ORACLE_SQL["p2_compare_labelings"]


@query("p2_cross_correlation", evaluated(_body("i3_cross_correlation")[1]))
def _(fx):
    """From the common input of all genes and the slide's shape, on the genes of C17."""
    n = side(fx)
    genes = fx["fx_records"].select("gene_id").distinct()
    x = P.compare_labelings(fx["fx_records"], fx["fx_labels"], "cell_a", "cell_b", seed=7, genes=genes, shape=(n, n)).cross
    return rounded(x, "source_correlation", "target_correlation", digits=5)


@query("p3_stitch", f"SELECT cell, area, round(cx, 6) AS cx, round(cy, 6) AS cy, n_spots, n_umis, n_genes, CASE WHEN n_genes < 150 THEN 'few_genes' WHEN n_genes > 190 THEN 'many_genes' ELSE 'kept' END AS reason FROM (SELECT row_number() OVER (ORDER BY t, r) AS cell, area, cx, cy, coalesce(n_spots, 0) AS n_spots, coalesce(n_umis, 0) AS n_umis, coalesce(n_genes, 0) AS n_genes FROM (SELECT cell_a, min(tile) AS t, cell_a+10*min(tile) AS r, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM {TILED} q GROUP BY 1) z LEFT JOIN {CELLS_SQL} c ON c.cell = z.cell_a) y")
def _(fx):
    """Tiles are told apart by ix*2^14+iy; the SQL numbers cells by ix*100+iy, which tiles share where there are over 100 a side."""
    pixels, edges = seam_edges(fx, H.keep(tile_labels(fx, 2**14)))  # read several times
    manifest = H.keep(pixels.select(F.col("tile").alias("id"), F.floor(F.col("x") / 150).alias("ix"), F.floor(F.col("y") / 150).alias("iy")).distinct())
    x = P.stitch(fx["fx_records"].select("x", "y", "gene_id", "cnt"), pixels, manifest, done(manifest), edges, core=150, low=150, high=190)
    roots = x.roots.withColumn("t", F.floor(F.col("root_tile") / 2**14) * 100 + F.pmod("root_tile", F.lit(2**14)))
    number = R.compact_labels(roots, "root_label", ["t"]).select("t", "root_label", "global_id")
    cells = x.cells.join(roots.join(number, ["t", "root_label"]).select("cell", "global_id"), "cell")
    return rounded(cells.select(F.col("global_id").alias("cell"), *x.cells.columns[1:]), "cx", "cy")


def done(manifest):
    return manifest.select("id", F.lit("done").alias("state"), F.lit("f").alias("fingerprint"))


def haloed_labels(fx):
    """The manifest, and each haloed tile's labels by pixel under numbers of its own; tiles of 48 pixels, so that most cells cross seams."""
    n = side(fx)
    tiles = B.make_tiles(fx.spark, n, n, 48, 12)
    k = -(-n // 48)
    h = D.halo_records(fx["fx_labels"].filter("cell_a > 0").select("x", "y", "cell_a"), 48, 12, F.lit(k), F.lit(k)).filter("x >= ix*48-12 and x < ix*48+60 and y >= iy*48-12 and y < iy*48+60")
    return tiles, h.select(F.format_string("x%02d_y%02d", "ix", "iy").alias("tile"), "x", "y", (F.col("cell_a") + F.pmod(F.col("ix") * 3 + F.col("iy"), F.lit(7)) * 100_000).cast("long").alias("label"))


#: Rows or columns of tiles of 48 pixels, as many as the slide has.
SEAM_TILES = "(SELECT unnest(range(CAST(ceil(max(s)/48.0) AS BIGINT))) FROM fx_records)"
NUMBERED = HALOED.replace("range(100)", SEAM_TILES).replace("*150", "*48").replace("+162", "+60").replace("ix*100+iy AS tile", "ix, iy, printf('x%02d_y%02d', ix, iy) AS tile").replace("{c} AS label", "CAST(cell_a + (ix*3+iy) % 7 * 100000 AS BIGINT) AS label").replace("{c}", "cell_a")
MATCHED = f"(SELECT a.ix, a.iy, b.ix AS jx, b.iy AS jy, a.tile AS ta, a.label AS la, b.tile AS tb, b.label AS lb, count(*) AS n FROM {NUMBERED} a JOIN {NUMBERED} b USING (x, y) WHERE (b.ix-a.ix, b.iy-a.iy) IN ((0,1),(1,-1),(1,0),(1,1)) GROUP BY ALL HAVING count(*) >= 30)"


@query("d10_seam_matches", f"SELECT CAST(((ix*16384+iy)*4 + 3*(jx-ix)+jy-iy-1)*2147483648+la AS BIGINT) AS ordinal, ta AS tile_a, la AS label_a, tb AS tile_b, lb AS label_b, n AS pixels, 1.0E0 AS fraction FROM {MATCHED} m")
def _(fx):
    """Both tiles label a pixel alike, so that the least area is the common one."""
    tiles, labels = haloed_labels(fx)
    return Z.seam_matches(labels, tiles)


STITCHED = f"""WITH RECURSIVE e AS (SELECT DISTINCT ta, la, tb, lb FROM {MATCHED} m), n AS (SELECT DISTINCT tile, label FROM {NUMBERED} h),
 reach(t, l, rt, rl) AS (SELECT tile, label, tile, label FROM n UNION SELECT r.t, r.l, u.tb, u.lb FROM reach r JOIN (SELECT * FROM e UNION ALL SELECT tb, lb, ta, la FROM e) u ON u.ta = r.rt AND u.la = r.rl),
 root AS (SELECT t, l, min((rt, rl)) AS root FROM reach GROUP BY 1, 2),
 pix AS (SELECT x, y, dense_rank() OVER (ORDER BY root) AS cell FROM {NUMBERED} h JOIN root ON t = tile AND l = label WHERE floor(x/48) = ix AND floor(y/48) = iy),
 obs AS (SELECT cell, area, cx, cy, coalesce(n_spots, 0) AS n_spots, coalesce(n_umis, 0) AS n_umis, coalesce(n_genes, 0) AS n_genes FROM (SELECT cell, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM pix GROUP BY 1) a
 LEFT JOIN (SELECT cell, count(DISTINCT (x, y)) AS n_spots, CAST(sum(cnt) AS BIGINT) AS n_umis, count(DISTINCT gene_id) AS n_genes FROM fx_records JOIN pix USING (x, y) GROUP BY 1) c USING (cell))"""


def stitched(fx):
    tiles, labels = haloed_labels(fx)
    return P.stitch(fx["fx_records"].select("x", "y", "gene_id", "cnt"), labels, tiles, done(tiles), core=48, low=150, high=190, lowers=(100, 150, 180))


@query("p3_stitch_tiles", f"SELECT * FROM ({STITCHED} SELECT cell, area, round(cx, 6) AS cx, round(cy, 6) AS cy, n_spots, n_umis, n_genes, CASE WHEN n_genes < 150 THEN 'few_genes' WHEN n_genes > 190 THEN 'many_genes' ELSE 'kept' END AS reason FROM obs) z")
def _(fx):
    """From the tiles' pixels: pairs and boxes, matches, union, cells, counts and QC."""
    return rounded(stitched(fx).cells, "cx", "cy")


@query("p3_sensitivity", f"SELECT * FROM ({STITCHED} SELECT CAST(low AS BIGINT) AS lower, count(*) FILTER (WHERE n_genes BETWEEN low AND 190) AS cells, CAST(coalesce(sum(n_umis) FILTER (WHERE n_genes BETWEEN low AND 190), 0) AS BIGINT) AS umis FROM obs, (SELECT unnest([100, 150, 180]) AS low) t GROUP BY 1) z")
def _(fx):
    return stitched(fx).sensitivity


def annotated(fx):
    """Annotation lines of the genes of tax 1, and the documents as their summaries."""
    p = fx["part"].select((F.col("p_size") % 3).alias("tax"), "p_partkey", "p_name", F.concat_ws("|", "p_brand", "p_type").alias("syn"))
    dash = [F.lit("-")]
    value = F.concat_ws("\t", F.col("tax").cast("string"), F.col("p_partkey").cast("string"), "p_name", *dash, "syn", *dash * 11)
    ann = A.parse_gene_info(p.select(F.col("p_partkey").cast("long").alias("line"), value.alias("value")), 1)
    return ann, fx["documents"].select(F.col("doc_id").alias("line"), F.col("doc_id").alias("gene_id"), F.col("text").alias("summary"))


GENES_1 = "(SELECT CAST(p_partkey AS BIGINT) AS gene_id, trim(p_name) AS s, list_sort(list_distinct([upper(trim(p_brand)), upper(trim(p_type))])) AS syn FROM part WHERE p_size % 3 = 1 AND trim(p_name) NOT IN ('', '-'))"
TEXTS_1 = f"(SELECT upper(s) AS symbol, arg_min(concat_ws(' ', 'Gene symbol: ' || s || '.', 'Aliases: ' || list_aggregate(list_filter(syn, lambda v: v <> upper(s)), 'string_agg', ', ') || '.', 'Summary: ' || d.text), gene_id) AS t, arg_min(syn, gene_id) AS syn, min(gene_id) AS ord FROM {GENES_1} g LEFT JOIN (SELECT doc_id, text FROM documents WHERE trim(text) <> '') d ON d.doc_id = g.gene_id GROUP BY 1)"


@query("p4_gene_table", f"WITH x AS {TEXTS_1}, v AS (SELECT symbol, [CAST(length(lower(t))-length(replace(lower(t), c, '')) AS DOUBLE) for c in ['a', 'e', 'i', 'o']] AS v FROM x), a AS (SELECT alias, arg_min(symbol, (ord, symbol)) AS symbol FROM (SELECT unnest(syn) AS alias, symbol, ord FROM x) e WHERE alias NOT IN (SELECT symbol FROM x) GROUP BY 1) SELECT symbol, CAST(i AS INT) AS dim, round(v[i+1]/greatest(sqrt(list_sum([w*w for w in v])), 1e-12), 5) AS value FROM (SELECT * FROM v UNION ALL SELECT alias, v FROM a JOIN v USING (symbol)) q, range(4) r(i)")
def _(fx):
    """Annotation lines and summaries to vectors."""
    x = P.gene_table(*annotated(fx), count_letters)
    return x.select("symbol", F.posexplode("embedding").alias("dim", "v")).select("symbol", "dim", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("p4_gene_lookup", f"SELECT * FROM (WITH x AS {TEXTS_1}, known AS (SELECT symbol FROM x UNION SELECT unnest(syn) FROM x) SELECT gene_id, symbol, CASE WHEN hit THEN dense_rank() OVER (PARTITION BY hit ORDER BY first)-1 ELSE -1 END AS embedding_id FROM (SELECT gene_id, upper(gene_name) AS symbol, upper(gene_name) IN (SELECT symbol FROM known) AS hit, min(gene_id) OVER (PARTITION BY upper(gene_name)) AS first FROM fx_genes) g) z")
def _(fx):
    """The vectors of the annotated genes, written and validated, for all genes of the slide."""
    return P.gene_vectors(*annotated(fx), count_letters, fx["fx_genes"].select("gene_id", F.col("gene_name").alias("symbol"))).lookup


# --- reports of single steps ----------------------------------------------------------------------------------------


_with, _select = _body("i1_random_correlation")
CONSISTENCY_SQL = f"{_with} SELECT c.*, correlation, coalesce(valid_repeats, 0) AS valid_repeats FROM {CELLS_SQL} c LEFT JOIN ({_select}) q USING (cell)"


@query("i1_cell_consistency")
def _(fx):
    spots = fx["fx_labels"].filter("cell_a > 0").select("x", "y", F.col("cell_a").alias("cell"))
    return rounded(C.cell_consistency(fx["fx_records"], fx["fx_labels"], "cell_a", R.half_sides(spots, 10, 7), N_GENES), "correlation", digits=5)


ORACLE_SQL["i1_cell_consistency"] = CONSISTENCY_SQL


@query("i3_cross_totals", f"SELECT count(*) AS source_cells_total, count(m) AS source_cells_matched, count(DISTINCT m) AS target_cells_matched, count(m)-count(DISTINCT m) AS many_to_one_excess FROM (SELECT DISTINCT cell_a AS s FROM fx_labels WHERE cell_a > 0) a LEFT JOIN {BEST_AB} b USING (s)")
def _(fx):
    return C.cross_totals(fx["fx_labels"], "cell_a", "cell_b")


SPLITS = ("train", "validation", "test")


@query("i9_split_audit", "SELECT count(*) AS molecules, " + ", ".join(f"round(avg(CAST({c} AS INT)), 6) AS {n}" for n, c in {"positive": "f = 1", "background": "f = 0", "unknown": "f = -1", **{f"{s}_background": f"f = 0 AND k = {i}" for i, s in enumerate(SPLITS)}}.items()) + " FROM (SELECT foreground AS f, bx % 3 AS k FROM fx_records JOIN fx_labels USING (x, y) JOIN fx_samples USING (bx, by_) WHERE manual_cell > 0) q")
def _(fx):
    m = fx["fx_records"].join(fx["fx_labels"].filter("manual_cell > 0").select("x", "y"), ["x", "y"]).select("x", "y")
    c = fx["fx_samples"].withColumn("split", F.get(F.array(*map(F.lit, SPLITS)), (F.col("bx") % 3).cast("int")))
    x = C.pseudolabel_audit(m, c, splits=SPLITS)
    return rounded(x, *(c for c in x.columns if c != "molecules"))


IOU_PAIRS = "(SELECT c AS cutoff, manual_cell AS s, CASE WHEN area >= c THEN cell_b ELSE 0 END AS t, count(*) AS n FROM fx_records JOIN fx_labels USING (x, y) LEFT JOIN (SELECT cell_b, count(*) AS area FROM fx_labels WHERE cell_b > 0 GROUP BY 1) a USING (cell_b), (SELECT CAST(unnest([8, 900, 1500]) AS BIGINT) AS c) k GROUP BY 1,2,3)"
RANKED_PAIRS = f"(SELECT *, row_number() OVER (PARTITION BY cutoff, s ORDER BY n DESC, t) AS rs, row_number() OVER (PARTITION BY cutoff, t ORDER BY n DESC, s) AS rt FROM {IOU_PAIRS} p WHERE s > 0 AND t > 0)"


@query(
    "i10_cutoff_iou",
    f"SELECT cutoff, any_value(assigned_share) AS assigned_share, count(*) AS manual_cells, count(iou) AS mutual_matches, round(avg(iou), 6) AS matched_only_mean, round(avg(coalesce(iou, 0)), 6) AS all_gt_mean, round(avg(CASE WHEN iou >= 0.5 THEN 1 ELSE 0 END), 6) AS recall50 FROM (SELECT a.cutoff, assigned_share, n/(na+nb-n) AS iou FROM (SELECT cutoff, s, sum(n) AS na FROM {IOU_PAIRS} p WHERE s > 0 GROUP BY 1,2) a JOIN (SELECT cutoff, round(sum(CASE WHEN t > 0 THEN n ELSE 0 END)/sum(n), 6) AS assigned_share FROM {IOU_PAIRS} p GROUP BY 1) h USING (cutoff) LEFT JOIN (SELECT * FROM {RANKED_PAIRS} r JOIN (SELECT cutoff, t, sum(n) AS nb FROM {IOU_PAIRS} p WHERE s > 0 GROUP BY 1,2) b USING (cutoff, t) WHERE rs = 1 AND rt = 1) m USING (cutoff, s)) z GROUP BY 1",
)
def _(fx):
    m = fx["fx_records"].join(fx["fx_labels"], ["x", "y"]).select(F.col("manual_cell").alias("manual"), F.col("cell_b").alias("predicted"))
    return rounded(C.cutoff_iou(m, fx["fx_labels"], "cell_b", [8, 900, 1500]), "assigned_share", "matched_only_mean", "all_gt_mean", "recall50")


_metrics = [(c, w, i, s) for c in ("genes", "umis") for w in ("before", "after") for i, s in enumerate((0, 0.25, 0.5, 0.75, 1))]
_counts = {"retained_cells": "ok", "removed_few": "n_genes < 150", "removed_many": "n_genes > 190", "at_low": "n_genes = 150", "at_high": "n_genes = 190"}
QC_SQL = f"SELECT count(*) AS input_cells, {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in _counts.items())}, CAST(sum(n_umis) AS BIGINT) AS input_umis, CAST(sum(CASE WHEN ok THEN n_umis ELSE 0 END) AS BIGINT) AS retained_umis, round(100*sum(CASE WHEN ok THEN n_umis ELSE 0 END)/sum(n_umis), 6) AS retained_percent, round(100*sum(CASE WHEN ok THEN n_umis ELSE 0 END)/(SELECT sum(cnt) FROM fx_records), 6) AS retained_percent_of_slide, "
QC_SQL += ", ".join(f"quantile_cont({f'n_{c}' if w == 'before' else f'CASE WHEN ok THEN n_{c} END'}, {s}) AS {c}_{w}_{i}" for c, w, i, s in _metrics)


@query("i11_qc_report", f"{QC_SQL} FROM (SELECT *, n_genes BETWEEN 150 AND 190 AS ok FROM {CELLS_SQL} c) q")
def _(fx):
    cells = E.cell_qc_metrics(fx["fx_records"], fx["fx_labels"], "cell_a")
    x = C.qc_report(cells, fx["fx_records"].agg(F.sum("cnt").alias("umis")), 150, 190)
    x = x.withColumns({f"{c}_{w}_{i}": F.get(f"{c}_{w}", F.lit(i)) for c, w, i, _ in _metrics}).drop(*(f"{c}_{w}" for c, w, _, _ in _metrics))
    return rounded(x, "retained_percent", "retained_percent_of_slide")


@query("i11_mitochondrial", "SELECT cell_a AS cell, CAST(sum(CASE WHEN gene_name ILIKE 's%' THEN cnt ELSE 0 END) AS BIGINT) AS mt_umis, round(100*sum(CASE WHEN gene_name ILIKE 's%' THEN cnt ELSE 0 END)/sum(cnt), 6) AS mt_percent FROM fx_records JOIN fx_labels USING (x, y) LEFT JOIN fx_genes USING (gene_id) WHERE cell_a > 0 GROUP BY 1")
def _(fx):
    """The test genes have no MT- symbols: those that begin with S stand for them."""
    g = fx["fx_genes"].select("gene_id", F.col("gene_name").alias("symbol"))
    return rounded(C.mitochondrial(fx["fx_records"], fx["fx_labels"], "cell_a", g, "S"), "mt_percent")


@query("i14_gene_patches", f"SELECT patch, count(*) AS genes, count(*) FILTER (WHERE known) AS mapped, round(avg(CAST(known AS INT)), 6) AS mapped_share FROM (SELECT DISTINCT {TILE_ID} AS patch, gene_id FROM fx_records) c LEFT JOIN (SELECT gene_id, upper(gene_name) IN (SELECT symbol FROM fx_embeddings) AS known FROM fx_genes) g USING (gene_id) GROUP BY 1".replace("avg(CAST(known AS INT))", "avg(CASE WHEN known THEN 1 ELSE 0 END)"))
def _(fx):
    r = fx["fx_records"].withColumn("patch", tile_id())
    known = fx["fx_genes"].select("gene_id", F.upper("gene_name").alias("symbol")).join(fx["fx_embeddings"].select("symbol"), "symbol", "left_semi")
    return rounded(V.evaluation_gene_patches(r.select("patch", "gene_id").distinct(), known), "mapped_share")


_with, _select = _body("d7_label_candidates")


@query("d7_eligible")
def _(fx):
    x = D.label_candidates(fx["fx_bins"], fx["fx_anchor_labels"], E.cell_stats(fx["fx_labels"], "nucleus_id"))
    return D.mark_eligible(x, core=150, margin=30).select("bx", "by_", "foreground", "interior", "eligible")


ORACLE_SQL["d7_eligible"] = f"{_with} SELECT bx, by_, foreground, interior, interior AND foreground >= 0 AS eligible FROM (SELECT *, 3*bx%150 >= 30 AND 3*bx%150 < 120 AND 3*by_%150 >= 30 AND 3*by_%150 < 120 AS interior FROM ({_select}) q) z"


@query("d14_prediction_shares", "SELECT count(*) AS molecules, count(p) AS with_prediction, round(avg(CASE WHEN nucleus_id > 0 THEN 1 ELSE 0 END), 6) AS in_nuclei, round(avg(CASE WHEN p > 0.1 THEN 1 ELSE 0 END), 6) AS over_01, round(avg(CASE WHEN p > 0.5 THEN 1 ELSE 0 END), 6) AS over_05 FROM fx_records LEFT JOIN (SELECT 3*x AS x, 3*y AS y, p FROM fx_pred) q USING (x, y) LEFT JOIN fx_labels USING (x, y)")
def _(fx):
    p = fx["fx_pred"].select((F.col("x") * 3).alias("x"), (F.col("y") * 3).alias("y"), "p")
    return rounded(D.prediction_shares(fx["fx_records"], p, fx["fx_labels"]), "in_nuclei", "over_01", "over_05")


@query("c27_report", f"SELECT count(*) AS tiles, count(*) FILTER (WHERE records > 0) AS expression_tiles, CAST(sum(CASE WHEN s IN ('prepared', 'empty') THEN records ELSE 0 END) AS BIGINT) AS completed_records, round(sum(CASE WHEN s IN ('prepared', 'empty') THEN records ELSE 0 END)/sum(records), 6) AS record_fraction, coalesce(string_agg(CASE WHEN s = 'failed' THEN CAST(id AS VARCHAR) END, ',' ORDER BY id), '') AS failed_tiles, coalesce(string_agg(CASE WHEN s IS NULL AND id % 2 = 0 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id), '') AS active_tiles, count(*) = count(*) FILTER (WHERE s IN ('prepared', 'empty')) AS complete FROM (SELECT id, records, {STATE_SQL} AS s FROM {REPORT_TILES} t) q")
def _(fx):
    tiles, status = report_tiles(fx)
    done = status.withColumn("state", F.when(F.col("state") == "prepared", "done").otherwise(F.col("state")))
    started = tiles.filter("id % 2 = 0").select("id", F.lit("active").alias("state"))
    x = J.progress_report(tiles, done.unionByName(started))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda i: i.cast("string"))).alias(c)
    return rounded(x, "record_fraction").withColumns({c: text(c) for c in ("failed_tiles", "active_tiles")})


@query("j5_one_model", "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS outside, count(DISTINCT y % 3)-1 AS more_models FROM fx_pred")
def _(fx):
    p = fx["fx_pred"].withColumns({"logits": F.array_repeat(F.lit(0.5), 16), "model": F.col("y") % 3})
    return J.validate_predictions(p, fx["fx_pred"])
