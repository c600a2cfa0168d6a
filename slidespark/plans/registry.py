"""Queries by operator id over the derived tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidespark.functions import scalars as S
from slidespark.operators import compare as C
from slidespark.operators import expression as E
from slidespark.operators import gates as J
from slidespark.operators import genes as G
from slidespark.operators import grid as B
from slidespark.operators import identity as H
from slidespark.operators import ranking as R
from slidespark.operators import spatial as D
from slidespark.sources import records as A

from .fixtures import Fixtures, oracle
from .shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
N_GENES = 200


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def side(fx: Fixtures):
    """The slide's side as a number."""
    return fx["fx_records"].agg(F.max("s")).first()[0]


# --- A: sources -------------------------------------------------------------------------------------------------


@query("a2_ingest_records", "SELECT CAST(row_number() OVER (ORDER BY first, gene)-1 AS BIGINT) AS gene_id, gene, n_records, umis FROM (SELECT gene_id AS gene, min(seq) AS first, count(*) AS n_records, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records GROUP BY gene_id) q")
def _(fx):
    return A.ingest_records(fx["fx_records"].withColumnRenamed("gene_id", "gene"))[1]


@query("a2_bounds", "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records")
def _(fx):
    return A.ingest_records(fx["fx_records"].withColumnRenamed("gene_id", "gene"))[2]


@query("a3_decode_gene_runs", "SELECT gene_id, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS umis, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT *, row_number() OVER (ORDER BY gene_id, seq)-1 AS pos FROM fx_records) q GROUP BY gene_id")
def _(fx):
    r = fx["fx_records"]
    runs = A.gene_runs(r.groupBy("gene_id").agg(F.count("*").alias("n")))
    # positions of the gene-sorted file: rank within a range of the gene's file order, after the ranges before and the gene's start
    r = r.withColumn("part", F.floor(F.col("seq") / 100_000))
    before = W.partitionBy("gene_id").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    parts = r.groupBy("gene_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    pos = r.withColumn("k", F.row_number().over(W.partitionBy("gene_id", "part").orderBy("seq")) - 1).join(parts, ["gene_id", "part"]).join(runs, "gene_id")
    pos = pos.withColumn("k", F.col("before") + F.col("k"))
    got = A.decode_gene_runs(pos.select((F.col("start") + F.col("k")).alias("pos"), "cnt"), runs)
    return got.groupBy("gene_id").agg(F.count("*").alias("n"), F.sum("cnt").cast("long").alias("umis"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("a4_spatial_index", "SELECT CAST(floor(x/150) AS BIGINT) AS ix, CAST(floor(y/150) AS BIGINT) AS iy, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records GROUP BY 1,2")
def _(fx):
    return A.tile_totals(fx["fx_records"].withColumns({"ix": F.floor(F.col("x") / 150), "iy": F.floor(F.col("y") / 150)}))


@query("a5_shard_by_patch", "SELECT CAST(floor(x/150) AS BIGINT) AS px, CAST(floor(y/150) AS BIGINT) AS py, x%150 AS x, y%150 AS y, gene_id, cnt FROM fx_records")
def _(fx):
    return A.shard_by_patch(fx["fx_records"], 150)


@query("a6_common_input", "SELECT spot, gene_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM fx_records JOIN (SELECT x, y, CAST(row_number() OVER (ORDER BY x, y)-1 AS BIGINT) AS spot FROM fx_spots) s USING (x, y) GROUP BY spot, gene_id")
def _(fx):
    n = side(fx)
    return A.build_common_input(fx["fx_records"], fx["fx_records"].select("gene_id").distinct(), n, n)[1]


@query("a9_load_embeddings", "SELECT symbol, CAST(len(embedding) AS BIGINT) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS v0 FROM fx_embeddings")
def _(fx):
    x = A.load_embeddings(fx["fx_embeddings"].withColumn("seq", F.lit(0)))
    return x.select("symbol", F.size("embedding").cast("long").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("v0"))


GENE_LINES = "SELECT CAST(p_partkey AS BIGINT) AS gene_id, p_size % 3 AS tax, p_name AS symbol, concat(p_brand, '|', p_type) AS synonyms FROM part"


@query("a7_gene_info", f"SELECT gene_id, symbol, CAST(CASE WHEN upper(trim(split_part(synonyms,'|',1))) = upper(trim(split_part(synonyms,'|',2))) THEN 1 ELSE 2 END AS BIGINT) AS n_synonyms FROM ({GENE_LINES}) g WHERE tax = 1")
def _(fx):
    p = fx["part"].select((F.col("p_size") % 3).alias("tax"), "p_partkey", "p_name", F.concat_ws("|", "p_brand", "p_type").alias("syn"))
    dash = [F.lit("-")]
    value = F.concat_ws("\t", F.col("tax").cast("string"), F.col("p_partkey").cast("string"), "p_name", *dash, "syn", *dash * 11)
    lines = p.select(F.col("p_partkey").cast("long").alias("line"), value.alias("value"))
    return A.parse_gene_info(lines, 1).select("gene_id", "symbol", F.size("synonyms").cast("long").alias("n_synonyms"))


@query("a8_attach_summaries", "SELECT CAST(p_partkey AS BIGINT) AS gene_id, CAST(count(d.doc_id) AS BIGINT) AS n, coalesce(min(length(d.text)), 0) AS chars FROM part LEFT JOIN documents d ON d.doc_id = p_partkey AND trim(d.text) <> '' GROUP BY p_partkey")
def _(fx):
    s = fx["documents"].select(F.col("doc_id").alias("line"), F.col("doc_id").alias("gene_id"), F.col("text").alias("summary"))
    x = G.attach_summaries(fx["part"].select(F.col("p_partkey").cast("long").alias("gene_id")), s)
    return x.select("gene_id", F.size("summaries").cast("long").alias("n"), F.coalesce(F.length(F.get("summaries", F.lit(0))).cast("long"), F.lit(0)).alias("chars"))


@query("a10_predictions", "SELECT x, y, printf('%.2f', p) AS p FROM fx_pred")
def _(fx):
    x = A.format_predictions(fx["fx_pred"].withColumn("logits", F.array(F.col("p"))))
    return x.select("x", "y", F.format_string("%.2f", F.col("p").cast("double")).alias("p"))


@query("a15_flatten_molecules", "SELECT gene_id, CAST(floor(x/5) AS BIGINT) AS gx, CAST(floor(y/5) AS BIGINT) AS gy, count(*) AS n FROM fx_records GROUP BY 1,2,3")
def _(fx):
    pts = fx["fx_records"].groupBy(F.col("bx").alias("cell"), "gene_id").agg(F.collect_list(F.struct("x", "y", F.lit(1).alias("z"))).alias("points")).withColumn("field", F.lit(0))
    return A.flatten_molecules(pts, 5).groupBy("gene_id", "gx", "gy").agg(F.count("*").alias("n"))


# --- B: projections and predicates -------------------------------------------------------------------------------


@query("b1_rebase", "SELECT x-x0 AS x, y-y0 AS y, gene_id, cnt, x1-x0+1 AS height, y1-y0+1 AS width FROM fx_records CROSS JOIN (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fx_records) m")
def _(fx):
    return B.rebase(fx["fx_records"].select("x", "y", "gene_id", "cnt"))


@query("b2_to_bin", "SELECT x, y, bx, by_, 3*bx AS ax, 3*by_ AS ay, bx*(s//3)+by_ AS row FROM fx_records")
def _(fx):
    r = fx["fx_records"].select("x", "y", "s")
    return B.to_bin(r).select("x", "y", "bx", "by_", "ax", "ay", S.flat_row(F.col("bx"), F.col("by_"), F.floor(F.col("s") / 3)).alias("row"))


@query("b3_make_tiles", "SELECT printf('x%02d_y%02d', ix, iy) AS id, ix, iy, ix*150 AS x, iy*150 AS y, least(150, s-ix*150) AS width, least(150, s-iy*150) AS height, CAST(12 AS BIGINT) AS halo, ix*150-12 AS origin_x, iy*150-12 AS origin_y FROM (SELECT max(s) AS s FROM fx_records) m, range(100) a(ix), range(100) b(iy) WHERE ix*150 < s AND iy*150 < s")
def _(fx):
    n = side(fx)
    return B.make_tiles(fx.spark, n, n, 150, 12)


@query("b4_core_only", "SELECT x, y, CAST(floor(x/150) AS BIGINT) AS ix, CAST(floor(y/150) AS BIGINT) AS iy, gene_id, cnt FROM fx_records")
def _(fx):
    n = -(-side(fx) // 150)
    h = D.halo_records(fx["fx_records"].select("x", "y", "gene_id", "cnt"), 150, 12, F.lit(n), F.lit(n))
    return B.core_only(h, 150)


@query("b5_interior", "SELECT bx, by_, (lx >= 42 AND lx < 12+least(150, s-ix*150)-30 AND ly >= 42 AND ly < 12+least(150, s-iy*150)-30) AS inside FROM (SELECT DISTINCT bx, by_, s, CAST(floor(3*bx/150) AS BIGINT) AS ix, CAST(floor(3*by_/150) AS BIGINT) AS iy, (3*bx)%150+12 AS lx, (3*by_)%150+12 AS ly FROM fx_records) q")
def _(fx):
    x = fx["fx_records"].select("bx", "by_", "s").distinct().withColumns({"x": F.col("bx") * 3, "y": F.col("by_") * 3})
    x = B.core_tile(x, 150)
    size = lambda t: F.least(F.lit(150), F.col("s") - F.col(t) * 150)
    return x.select("bx", "by_", B.interior(F.pmod("x", F.lit(150)) + 12, F.pmod("y", F.lit(150)) + 12, size("ix"), size("iy"), 12, 30).alias("inside"))


@query("b6_crop", "SELECT x-30 AS x, y-20 AS y, gene_id, cnt FROM fx_records WHERE x >= 30 AND x < 70 AND y >= 20 AND y < 80")
def _(fx):
    return B.crop(fx["fx_records"].select("x", "y", "gene_id", "cnt"), 30, 20, 40, 60)


@query("b7_validate", "SELECT count(*) AS n_rows, CAST(count(*) FILTER (WHERE c <= 0) AS BIGINT) AS bad_count, CAST(count(*) FILTER (WHERE x < 0 OR y < 0) AS BIGINT) AS negative_xy, CAST(count(*) FILTER (WHERE x >= 80 OR y >= 80) AS BIGINT) AS outside FROM (SELECT x-2 AS x, y-2 AS y, cnt-2 AS c FROM fx_records) q")
def _(fx):
    return B.validate_records(fx["fx_records"].select((F.col("x") - 2).alias("x"), (F.col("y") - 2).alias("y"), (F.col("cnt") - 2).alias("cnt")), 80, 80)


RING_SQL = """
, rings AS MATERIALIZED (SELECT dx, dy, row_number() OVER (ORDER BY greatest(abs(dx),abs(dy)), CASE WHEN abs(dx)=greatest(abs(dx),abs(dy)) THEN 0 ELSE 1 END,
  CASE WHEN abs(dx)=greatest(abs(dx),abs(dy)) THEN dx ELSE dy END, CASE WHEN abs(dx)=greatest(abs(dx),abs(dy)) THEN dy ELSE dx END) AS o
  FROM (SELECT range AS dx FROM range(-10,11)) a, (SELECT range AS dy FROM range(-10,11)) b),
nb AS MATERIALIZED (SELECT c.bx, c.by_, row_number() OVER (PARTITION BY c.bx, c.by_ ORDER BY o)-1 AS rank, n.bx AS nx, n.by_ AS ny
  FROM fx_bins c, rings, fx_bins n WHERE n.bx = c.bx+dx AND n.by_ = c.by_+dy),
nb50 AS MATERIALIZED (SELECT bx, by_, rank, nx, ny FROM nb QUALIFY rank < 50 AND max(rank) OVER (PARTITION BY bx, by_) >= 49)
"""


def ring_oracle(body: str) -> str:
    return oracle("SELECT * FROM fx_bins", "fx_bins").replace(" SELECT * FROM fx_bins", RING_SQL + body)


QUERIES["d2_ring_neighbors"] = lambda spark, d: D.ring_neighbors(Fixtures(spark, d)["fx_bins"])
QUERIES["d2_ring_counts"] = lambda spark, d: D.neighbor_counts(Fixtures(spark, d)["fx_bins"], QUERIES["d2_ring_neighbors"](spark, d))
ORACLE_SQL["d2_ring_counts"] = ring_oracle("SELECT o AS occupied, k AS kept, o-k AS dropped FROM (SELECT count(*) AS o FROM fx_bins) a, (SELECT count(*) AS k FROM nb50 WHERE rank = 0) b")
ORACLE_SQL["d2_ring_neighbors"] = ring_oracle("SELECT bx, by_, rank, nx, ny FROM nb50")
QUERIES["b8_relative_positions"] = lambda spark, d: D.relative_positions(D.ring_neighbors(Fixtures(spark, d)["fx_bins"]))
ORACLE_SQL["b8_relative_positions"] = ring_oracle("SELECT bx, by_, rank, (nx-bx)*3 AS dx, (ny-by_)*3 AS dy FROM nb50")


@query("b10_spatial_holdout", "SELECT bx, by_, CASE WHEN NOT (3*bx > floor(s*0.75) AND 3*by_ > floor(s*0.75)) THEN 'train' WHEN foreground = 1 THEN 'validation' ELSE 'dropped' END AS split FROM fx_samples CROSS JOIN (SELECT max(s) AS s FROM fx_records) m")
def _(fx):
    n = side(fx)
    x = fx["fx_samples"].withColumns({"x": F.col("bx") * 3, "y": F.col("by_") * 3})
    return B.spatial_holdout(x, n, n).select("bx", "by_", "split")


DIRECTION_SQL = "CASE WHEN dx=0 AND dy>=0 THEN 0 WHEN dx=dy AND dx>0 THEN 2 WHEN dy=0 AND dx>0 THEN 4 WHEN dx=-dy AND dx>0 THEN 6 WHEN dx=0 AND dy<0 THEN 8 WHEN dx=dy AND dx<0 THEN 10 WHEN dy=0 AND dx<0 THEN 12 WHEN dx=-dy AND dx<0 THEN 14 ELSE CAST(floor((CASE WHEN atan2(dx,dy)<0 THEN atan2(dx,dy)+2*pi() ELSE atan2(dx,dy) END)/(2*pi()/16)) AS BIGINT) % 16 END"


@query("b11_direction_class", f"SELECT dx, dy, CAST({DIRECTION_SQL} AS BIGINT) AS direction, count(*) AS n FROM (SELECT bx % 21 - 10 AS dx, by_ % 21 - 10 AS dy FROM fx_bins) q GROUP BY dx, dy")
def _(fx):
    x = fx["fx_bins"].select((F.col("bx") % 21 - 10).alias("dx"), (F.col("by_") % 21 - 10).alias("dy"))
    return x.groupBy("dx", "dy").agg(F.count("*").alias("n")).withColumn("direction", S.direction_class(F.col("dx"), F.col("dy")))


@query("b12_stretch", "SELECT x, y, round(greatest(least((stain-p[1])/greatest(p[2]-p[1], 1e-12), 1), 0)*255, 6) AS stretched FROM fx_labels CROSS JOIN (SELECT quantile_cont(stain, [0.01, 0.995]) AS p FROM fx_labels WHERE stain > 0) q")
def _(fx):
    return rounded(B.stretch(fx["fx_labels"].select("x", "y", "stain"), "stain").select("x", "y", "stretched"), "stretched")


@query("b13_affine", "SELECT x, y, round(x*1.01+y*0.02+3, 6) AS ax, round(x*(-0.02)+y*0.99-1, 6) AS ay FROM fx_spots")
def _(fx):
    x = B.apply_affine(fx["fx_spots"].withColumns({"ox": F.col("x"), "oy": F.col("y")}), [[1.01, 0.02, 3.0], [-0.02, 0.99, -1.0]])
    return x.select(F.col("ox").alias("x"), F.col("oy").alias("y"), F.round("x", 6).alias("ax"), F.round("y", 6).alias("ay"))


@query("b14_drop_small_labels", "SELECT x, y, cell_a FROM fx_labels WHERE cell_a IN (SELECT cell_a FROM fx_labels WHERE cell_a > 0 GROUP BY cell_a HAVING count(*) >= 450)")
def _(fx):
    return B.drop_small_labels(fx["fx_labels"].select("x", "y", "cell_a"), "cell_a", 450)


@query("b15_expand_bins", "SELECT 3*bx+dx AS x, 3*by_+dy AS y, tile AS label FROM fx_samples, range(3) a(dx), range(3) b(dy) WHERE 3*bx+dx < (SELECT max(s)-4 FROM fx_records) AND 3*by_+dy < (SELECT max(s)-4 FROM fx_records)")
def _(fx):
    n = F.lit(side(fx) - 4)
    return B.expand_bins(fx["fx_samples"].select("bx", "by_", F.col("tile").alias("label")), 3, n, n).select("x", "y", "label")


# --- C: aggregations ---------------------------------------------------------------------------------------------

EXPR = "(SELECT bx, by_, gene_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM fx_records GROUP BY 1,2,3)"


@query("c1_bin_expression", f"SELECT * FROM {EXPR} e")
def _(fx):
    return E.bin_expression(fx["fx_records"])


@query("c2_pixel_umi", "SELECT x, y, CAST(sum(cnt) AS BIGINT) AS umi FROM fx_records GROUP BY x, y")
def _(fx):
    return E.pixel_umi(fx["fx_records"])


@query("c3_bin_stats", f"SELECT bx, by_, count(*) AS nnz, CAST(sum(cnt) AS BIGINT) AS umi FROM {EXPR} e GROUP BY bx, by_")
def _(fx):
    return E.bin_stats(E.bin_expression(fx["fx_records"]))


@query("c4_merge_symbols", "SELECT bx, by_, upper(gene_name) AS symbol, CAST(sum(cnt) AS BIGINT) AS cnt FROM fx_records JOIN fx_genes USING (gene_id) GROUP BY 1,2,3")
def _(fx):
    g = fx["fx_genes"].select("gene_id", S.gene_symbol(F.col("gene_name"), F.col("gene_identifier")).alias("symbol"))
    return E.merge_symbols(E.bin_expression(fx["fx_records"]), g)


@query("c5_label_expression", "SELECT cell_a AS label, gene_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM fx_records JOIN fx_labels USING (x, y) GROUP BY 1,2")
def _(fx):
    return E.label_expression(fx["fx_records"], fx["fx_labels"], "cell_a")


@query("c6_cell_stats", "SELECT cell_a AS cell, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM fx_labels WHERE cell_a > 0 GROUP BY 1")
def _(fx):
    return rounded(E.cell_stats(fx["fx_labels"], "cell_a"), "cx", "cy")


@query("c7_nucleus_centers", "SELECT nucleus_id AS cell, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM fx_labels WHERE nucleus_id > 0 GROUP BY 1")
def _(fx):
    return rounded(E.cell_stats(fx["fx_labels"], "nucleus_id"), "cx", "cy")


CELLS_SQL = "(SELECT cell_a AS cell, count(DISTINCT (x, y)) AS n_spots, CAST(sum(cnt) AS BIGINT) AS n_umis, count(DISTINCT gene_id) AS n_genes FROM fx_records JOIN fx_labels USING (x, y) WHERE cell_a > 0 GROUP BY 1)"


@query("c8_cell_qc_metrics", f"SELECT * FROM {CELLS_SQL} c")
def _(fx):
    return E.cell_qc_metrics(fx["fx_records"], fx["fx_labels"], "cell_a")


@query("c9_metric_summary", f"SELECT count(*) AS n, round(avg(n_umis), 6) AS mean, round(quantile_cont(n_umis, 0.5), 6) AS median FROM {CELLS_SQL} c WHERE n_spots > 100")
def _(fx):
    return rounded(E.metric_summary(E.cell_qc_metrics(fx["fx_records"], fx["fx_labels"], "cell_a"), "n_umis", F.col("n_spots") > 100), "mean", "median")


@query("c10_quantiles", f"SELECT unnest({list(E.NINE)}) AS share, unnest((SELECT quantile_cont(umi::DOUBLE, {list(E.NINE)}) FROM (SELECT sum(cnt) AS umi FROM fx_records GROUP BY bx, by_) q)) AS value")
def _(fx):
    return E.quantiles(E.bin_stats(E.bin_expression(fx["fx_records"])), "umi")


PEARSON_SQL = "CASE WHEN sqrt(({n}*{aa}-{a}*{a})::DOUBLE)*sqrt(({n}*{bb}-{b}*{b})::DOUBLE) <= 1e-12 THEN NULL ELSE greatest(least(({n}*{ab}-{a}*{b})/(sqrt(({n}*{aa}-{a}*{a})::DOUBLE)*sqrt(({n}*{bb}-{b}*{b})::DOUBLE)),1),-1) END"


@query("c11_row_pearson", "SELECT cell, round(" + PEARSON_SQL.format(n=N_GENES, a="sa", b="sb", aa="saa", bb="sbb", ab="sab") + ", 6) AS r FROM (SELECT cell, CAST(sum(a) AS BIGINT) AS sa, CAST(sum(b) AS BIGINT) AS sb, CAST(sum(a*a) AS BIGINT) AS saa, CAST(sum(b*b) AS BIGINT) AS sbb, CAST(sum(a*b) AS BIGINT) AS sab FROM (SELECT cell_a AS cell, gene_id, sum(CASE WHEN x%2=0 THEN cnt ELSE 0 END) AS a, sum(CASE WHEN x%2=1 THEN cnt ELSE 0 END) AS b FROM fx_records JOIN fx_labels USING (x, y) WHERE cell_a > 0 GROUP BY 1,2) g GROUP BY cell) s")
def _(fx):
    x = fx["fx_records"].join(fx["fx_labels"].filter("cell_a > 0").select("x", "y", F.col("cell_a").alias("cell")), ["x", "y"])
    half = lambda k: x.filter(F.col("x") % 2 == k).groupBy("cell", "gene_id").agg(F.sum("cnt").alias("cnt"))
    return rounded(E.row_pearson(half(0), half(1), N_GENES), "r")


@query("c12_pool_embeddings", f"SELECT bx, by_, dim-1 AS dim, CAST(sum(cnt*v) AS BIGINT) AS value, any_value(nnz) AS nnz FROM (SELECT bx, by_, cnt, symbol, count(*) OVER (PARTITION BY bx, by_, dim) AS nnz, dim, v FROM (SELECT e.bx, e.by_, upper(gene_name) AS symbol, CAST(sum(cnt) AS BIGINT) AS cnt FROM {EXPR} e JOIN fx_genes USING (gene_id) GROUP BY 1,2,3) s JOIN (SELECT symbol, unnest(range(1, len(embedding)+1)) AS dim, CAST(round(CAST(unnest(embedding) AS DOUBLE)*1e6) AS BIGINT) AS v FROM fx_embeddings) v USING (symbol)) q GROUP BY bx, by_, dim")
def _(fx):
    g = fx["fx_genes"].select("gene_id", S.gene_symbol(F.col("gene_name"), F.col("gene_identifier")).alias("symbol"))
    m = E.merge_symbols(E.bin_expression(fx["fx_records"]), g).withColumnRenamed("symbol", "gene_id")
    v = fx["fx_embeddings"].select(F.col("symbol").alias("gene_id"), "embedding")
    # as the fixed-point sum, which has no ties of rounding
    return E.pool_embeddings(m, v).withColumn("value", F.round(F.col("value") * F.col("nnz") * 1e6).cast("long"))


@query("c15_fano_median", "SELECT grp, round(fano, 6) AS fano FROM (SELECT grp, quantile_cont(f, 0.5) AS fano FROM (SELECT grp, greatest((q-s*s::DOUBLE/n)/(n-1), 0)/(s::DOUBLE/n) AS f FROM (SELECT cell_a AS grp, gene_id, sum(c) AS s, sum(c*c) AS q FROM (SELECT x, y, gene_id, sum(cnt) AS c FROM fx_records GROUP BY 1,2,3) e JOIN fx_labels USING (x, y) WHERE cell_a > 0 GROUP BY 1,2) g JOIN (SELECT cell_a AS grp, count(*) AS n FROM fx_labels WHERE cell_a > 0 GROUP BY 1) n USING (grp) WHERE n >= 2) h GROUP BY grp) z")
def _(fx):
    spots = fx["fx_labels"].filter("cell_a > 0").select("x", "y", F.col("cell_a").alias("grp"))
    e = fx["fx_records"].groupBy("x", "y", "gene_id").agg(F.sum("cnt").alias("cnt"))
    return rounded(E.fano_median(spots, e).filter("fano is not null"), "fano")


@query("c16_select_hvg")
def _(fx):
    e = E.bin_expression(fx["fx_records"])
    return rounded(E.select_hvg(e, e.select("bx", "by_").distinct().count(), 50), "score")


@query("c18_classification", "SELECT round(avg(CASE WHEN foreground=1 THEN CAST(target=predicted AS INT) END), 6) AS direction_accuracy, round(avg(CASE WHEN foreground=1 THEN CAST(p>0.5 AS INT) END), 6) AS foreground_recall, round(avg(CASE WHEN foreground<>1 THEN CAST(p<=0.5 AS INT) END), 6) AS background_specificity, round((SELECT avg(r) FROM (SELECT avg(CAST(target=predicted AS INT)) AS r FROM fx_pred WHERE foreground=1 GROUP BY target) q), 6) AS macro_recall, round((avg(CASE WHEN foreground=1 THEN CAST(p>0.5 AS INT) END)+avg(CASE WHEN foreground<>1 THEN CAST(p<=0.5 AS INT) END))/2, 6) AS balanced_accuracy FROM fx_pred")
def _(fx):
    return rounded(E.classification_metrics(fx["fx_pred"]), "direction_accuracy", "foreground_recall", "background_specificity", "macro_recall", "balanced_accuracy")


@query("c19_majority_baseline", "SELECT m.target AS majority, count(*) AS n, round(avg(CAST(p.target = m.target AS INT)), 6) AS accuracy FROM fx_pred p CROSS JOIN (SELECT target FROM fx_pred WHERE x % 2 = 0 GROUP BY target ORDER BY count(*) DESC, target LIMIT 1) m WHERE x % 2 = 1 GROUP BY 1")
def _(fx):
    p = fx["fx_pred"]
    return rounded(E.majority_baseline(p.filter("x % 2 = 0"), p.filter("x % 2 = 1")), "accuracy")


@query("c20_prediction_loss", "SELECT round(avg(CASE WHEN foreground=1 THEN ln(list_sum([exp((k*target % 5)/10.0) for k in range(16)])) - (target*target % 5)/10.0 ELSE 0 END), 6) AS direction_loss, round(avg(greatest(p-0.5, 0)-(p-0.5)*foreground+ln(1+exp(-abs(p-0.5)))), 6) AS foreground_loss FROM fx_pred")
def _(fx):
    logits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (k * F.col("target") % 5) / 10.0)
    return rounded(E.prediction_loss(fx["fx_pred"].withColumns({"logits": logits, "z": F.col("p") - 0.5})), "direction_loss", "foreground_loss")


@query("c21_contingency", "SELECT cell_a, cell_b, count(*) AS n FROM fx_labels GROUP BY 1,2")
def _(fx):
    return E.contingency(fx["fx_labels"], "cell_a", "cell_b")


@query("c22_depth_delta", "SELECT count(*) AS strata, round(sum(least(na,nb)*(mb-ma))/sum(least(na,nb)), 6) AS delta FROM (SELECT CAST(floor(log2(umis)) AS BIGINT) AS s, avg(CASE WHEN m='a' THEN v END) AS ma, avg(CASE WHEN m='b' THEN v END) AS mb, count(CASE WHEN m='a' THEN v END) AS na, count(CASE WHEN m='b' THEN v END) AS nb FROM (SELECT CASE WHEN bx%2=0 THEN 'a' ELSE 'b' END AS m, sum(cnt) AS umis, count(*)::DOUBLE AS v FROM fx_records GROUP BY bx, by_) q GROUP BY 1) z WHERE na > 0 AND nb > 0")
def _(fx):
    x = fx["fx_records"].groupBy("bx", "by_").agg(F.sum("cnt").alias("umis"), F.count("*").alias("value"))
    return rounded(E.depth_stratified_delta(x.withColumn("method", F.when(F.col("bx") % 2 == 0, "a").otherwise("b"))), "delta")


@query("c23_block_mean", "SELECT CAST(floor(x/4) AS BIGINT) AS bx, CAST(floor(y/4) AS BIGINT) AS by_, round(sum(v*(CASE WHEN x=s-1 THEN (4-s%4)%4+1 ELSE 1 END)*(CASE WHEN y=s-1 THEN (4-s%4)%4+1 ELSE 1 END))/16.0, 6) AS value FROM (SELECT x, y, s, sum(cnt) AS v FROM fx_records GROUP BY 1,2,3) q GROUP BY 1,2")
def _(fx):
    n = F.lit(side(fx))
    return rounded(E.block_mean(fx["fx_records"].groupBy("x", "y").agg(F.sum("cnt").alias("value")), 4, n, n), "value")


@query("c24_densest_window", "SELECT wx, wy, CAST(sum(n) AS BIGINT) AS umi FROM (SELECT cx-dx AS wx, cy-dy AS wy, n FROM (SELECT CAST(floor(x/10) AS BIGINT) AS cx, CAST(floor(y/10) AS BIGINT) AS cy, sum(cnt) AS n FROM fx_records GROUP BY 1,2) c, range(3) a(dx), range(3) b(dy)) w, (SELECT max(CAST(floor(x/10) AS BIGINT))-2 AS mx, max(CAST(floor(y/10) AS BIGINT))-2 AS my FROM fx_records) m WHERE wx >= 0 AND wy >= 0 AND wx <= mx AND wy <= my GROUP BY 1,2 ORDER BY 3 DESC, 1, 2 LIMIT 1")
def _(fx):
    return E.densest_window(fx["fx_records"], 30, 10)


@query("c25_mapping_coverage", "SELECT count(*) AS source_genes, count(DISTINCT upper(gene_name)) AS unique_symbols, count(e.symbol) AS mapped_genes, CAST(sum(coalesce(umi,0)) AS BIGINT) AS total_umi, CAST(sum(CASE WHEN e.symbol IS NOT NULL THEN coalesce(umi,0) ELSE 0 END) AS BIGINT) AS mapped_umi FROM fx_genes g LEFT JOIN (SELECT symbol FROM fx_embeddings) e ON e.symbol = upper(gene_name) LEFT JOIN (SELECT gene_id, sum(cnt) AS umi FROM fx_records GROUP BY 1) u USING (gene_id)")
def _(fx):
    g = fx["fx_genes"].select("gene_id", F.upper("gene_name").alias("symbol"))
    return E.mapping_coverage(fx["fx_records"], g, fx["fx_embeddings"])


@query("c28_neighborhood_stats", None)
def _(fx):
    return D.ring_stats(E.bin_expression(fx["fx_records"]))


ORACLE_SQL["c28_neighborhood_stats"] = oracle("SELECT 1 FROM fx_records", "fx_records", "fx_bins").replace(
    " SELECT 1 FROM fx_records", RING_SQL + f"SELECT nb.bx, nb.by_, count(*) FILTER (WHERE rank=0) AS centre_genes, count(DISTINCT gene_id) AS genes, CAST(sum(cnt) AS BIGINT) AS umis FROM nb50 nb JOIN {EXPR} e ON e.bx=nx AND e.by_=ny GROUP BY 1,2"
)


@query("c29_context_reach", None)
def _(fx):
    n = D.ring_neighbors(fx["fx_bins"])
    x = E.context_reach(n, fx["fx_bins"].withColumn("nucleus_id", F.lit(0)))
    return rounded(x.select("p50", "p90", "p99"), "p50", "p90", "p99")


ORACLE_SQL["c29_context_reach"] = ring_oracle("SELECT round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99 FROM (SELECT sqrt(max((nx-bx)*(nx-bx)+(ny-by_)*(ny-by_)))*3 AS d FROM nb50 GROUP BY bx, by_) q")


@query("c31_eligible_nuclei", "SELECT nucleus_id, count(*) AS n_spots, count(*) >= 60 AS eligible FROM fx_labels WHERE nucleus_id > 0 GROUP BY 1")
def _(fx):
    return E.eligible_nuclei(fx["fx_spots"], fx["fx_labels"], 60)


# --- D: joins ----------------------------------------------------------------------------------------------------


@query("d1_halo_records", "SELECT ix, iy, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records, (SELECT ix, iy FROM range(100) a(ix), range(100) b(iy)) t WHERE x >= ix*150-12 AND x < ix*150+162 AND y >= iy*150-12 AND y < iy*150+162 AND ix*150 < s AND iy*150 < s GROUP BY 1,2")
def _(fx):
    n = -(-side(fx) // 150)
    x = D.halo_records(fx["fx_records"].select("x", "y", "cnt"), 150, 12, F.lit(n), F.lit(n))
    x = x.filter("x >= ix*150-12 and x < ix*150+162 and y >= iy*150-12 and y < iy*150+162")
    return x.groupBy("ix", "iy").agg(F.count("*").alias("records"), F.sum("cnt").cast("long").alias("umis"))


@query("d3_gather_tokens", None)
def _(fx):
    return D.gather_tokens(D.ring_neighbors(fx["fx_bins"]), E.bin_expression(fx["fx_records"])).groupBy("rank").agg(F.count("*").alias("tokens"), F.sum("cnt").cast("long").alias("umis"))


ORACLE_SQL["d3_gather_tokens"] = oracle("SELECT 1 FROM fx_records", "fx_records", "fx_bins").replace(
    " SELECT 1 FROM fx_records", RING_SQL + f"SELECT rank, count(*) AS tokens, CAST(sum(cnt) AS BIGINT) AS umis FROM nb50 nb JOIN {EXPR} e ON e.bx=nx AND e.by_=ny GROUP BY 1"
)


@query("d4_lookup_pixels", "SELECT 3*bx AS x, 3*by_ AS y, coalesce(nucleus_id, 0) AS nucleus_id, coalesce(stain, 0) AS stain FROM fx_bins LEFT JOIN fx_labels ON x=3*bx AND y=3*by_")
def _(fx):
    return D.lookup_pixels(fx["fx_bins"].select((F.col("bx") * 3).alias("x"), (F.col("by_") * 3).alias("y")), fx["fx_labels"], ("nucleus_id", "stain"))


@query("d5_gene_lookup", "SELECT gene_id, upper(gene_name) AS symbol, coalesce(r, -1) AS embedding_id FROM fx_genes LEFT JOIN (SELECT symbol, row_number() OVER (ORDER BY f)-1 AS r FROM (SELECT e.symbol, min(gene_id) AS f FROM fx_genes JOIN fx_embeddings e ON e.symbol=upper(gene_name) GROUP BY 1) q) z ON z.symbol=upper(gene_name)")
def _(fx):
    return D.gene_lookup(fx["fx_genes"].select("gene_id", F.upper("gene_name").alias("symbol")), fx["fx_embeddings"])


CENTRES_SQL = "(SELECT nucleus_id AS cell, avg(x) AS cx, avg(y) AS cy FROM fx_labels WHERE nucleus_id > 0 GROUP BY 1)"


@query("d6_background_mask", f"SELECT x, y FROM fx_anchor_labels a WHERE nucleus_id = 0 AND stain <= 10 AND NOT EXISTS (SELECT 1 FROM {CENTRES_SQL} c WHERE (a.x-cx)*(a.x-cx)+(a.y-cy)*(a.y-cy) <= 900)")
def _(fx):
    return D.background_mask(fx["fx_anchor_labels"], E.cell_stats(fx["fx_labels"], "nucleus_id")).select("x", "y")


@query("d6_nearest_nucleus", f"SELECT x, y, cell, round(sqrt(d2), 6) AS distance FROM (SELECT x, y, c.cell, (a.x-cx)*(a.x-cx)+(a.y-cy)*(a.y-cy) AS d2, row_number() OVER (PARTITION BY x, y ORDER BY (a.x-cx)*(a.x-cx)+(a.y-cy)*(a.y-cy), c.cell) AS r FROM fx_anchor_labels a, {CENTRES_SQL} c) q WHERE r = 1")
def _(fx):
    return rounded(D.nearest(fx["fx_anchor_labels"], E.cell_stats(fx["fx_labels"], "nucleus_id")), "distance")


@query("d7_label_candidates", f"SELECT bx, by_, CAST(CASE WHEN nucleus_id > 0 THEN 1 WHEN stain <= 10 AND NOT EXISTS (SELECT 1 FROM {CENTRES_SQL} c WHERE (l.x-cx)*(l.x-cx)+(l.y-cy)*(l.y-cy) <= 900) THEN 0 ELSE -1 END AS BIGINT) AS foreground, round(coalesce(cx-l.x, 0), 6) AS dx, round(coalesce(cy-l.y, 0), 6) AS dy FROM fx_bins JOIN fx_anchor_labels l ON l.x=3*bx AND l.y=3*by_ LEFT JOIN {CENTRES_SQL} c ON c.cell=nucleus_id")
def _(fx):
    x = D.label_candidates(fx["fx_bins"], fx["fx_anchor_labels"], E.cell_stats(fx["fx_labels"], "nucleus_id"))
    return rounded(x.select("bx", "by_", "foreground", "dx", "dy"), "dx", "dy")


@query("d8_best_overlap", "SELECT s, t, n FROM (SELECT cell_a AS s, cell_b AS t, count(*) AS n, row_number() OVER (PARTITION BY cell_a ORDER BY count(*) DESC, cell_b) AS r FROM fx_labels WHERE cell_a > 0 AND cell_b > 0 GROUP BY 1,2) q WHERE r = 1")
def _(fx):
    return D.best_overlap(fx["fx_labels"].select(F.col("cell_a").alias("s"), F.col("cell_b").alias("t")))


@query("d9_overlap_matches", "WITH_ SELECT s, t, n, round(n/least(na,nb), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS rs, row_number() OVER (PARTITION BY t ORDER BY n DESC, s) AS rt FROM (SELECT cell_a AS s, cell_b AS t, count(*) AS n FROM fx_labels WHERE cell_a > 0 AND cell_b > 0 GROUP BY 1,2) p) q JOIN (SELECT cell_a AS s, count(*) AS na FROM fx_labels GROUP BY 1) a USING (s) JOIN (SELECT cell_b AS t, count(*) AS nb FROM fx_labels GROUP BY 1) b USING (t) WHERE rs=1 AND rt=1 AND n >= 30 AND n/least(na,nb) >= 0.5".replace("WITH_ ", ""))
def _(fx):
    return rounded(D.overlap_matches(fx["fx_labels"].select(F.col("cell_a").alias("s"), F.col("cell_b").alias("t"))), "share")


@query("d10_adjacent_tiles", "SELECT printf('x%02d_y%02d', a.ix, a.iy) AS a, printf('x%02d_y%02d', b.ix, b.iy) AS b FROM (SELECT ix, iy FROM (SELECT max(s) AS s FROM fx_records) m, range(100) a(ix), range(100) b(iy) WHERE ix*150 < s AND iy*150 < s) a, (SELECT ix, iy FROM (SELECT max(s) AS s FROM fx_records) m, range(100) a(ix), range(100) b(iy) WHERE ix*150 < s AND iy*150 < s) b WHERE (b.ix-a.ix, b.iy-a.iy) IN ((0,1),(1,-1),(1,0),(1,1))")
def _(fx):
    n = side(fx)
    return D.adjacent_tiles(B.make_tiles(fx.spark, n, n, 150, 12))


@query("d11_kernel_enhance", "SELECT s.x, s.y, e.gene_id, round(sum(c*w), 6) AS value FROM (SELECT x, y, gene_id, sum(cnt) AS c FROM fx_records GROUP BY 1,2,3) e, (SELECT a AS dx, b AS dy, 1.0E0/greatest(a*a+b*b, 1) AS w FROM range(-2, 3) p(a), range(-2, 3) q(b) WHERE a*a+b*b <= 4) o JOIN fx_spots s ON s.x = e.x+dx AND s.y = e.y+dy GROUP BY 1,2,3")
def _(fx):
    e = fx["fx_records"].groupBy("x", "y", "gene_id").agg(F.sum("cnt").alias("cnt"))
    return rounded(D.kernel_enhance(fx["fx_spots"], e, 2), "value")


@query("d12_window_members", f"SELECT cell, count(*) AS spots FROM {CENTRES_SQL} c JOIN fx_spots s ON abs(x-cx) <= 20 AND abs(y-cy) <= 20 GROUP BY 1")
def _(fx):
    return D.window_members(E.cell_stats(fx["fx_labels"], "nucleus_id").select("cell", "cx", "cy"), fx["fx_spots"]).groupBy("cell").agg(F.count("*").alias("spots"))


@query("d13_direction_prior", f"SELECT x, y, CAST({DIRECTION_SQL} AS BIGINT) AS direction, count(*) AS votes FROM (SELECT x, y, cx-x AS dx, cy-y AS dy, max(CAST((x-cx)*(x-cx)+(y-cy)*(y-cy) <= 225 AS INT)) OVER (PARTITION BY x, y) AS a, (x-cx)*(x-cx)+(y-cy)*(y-cy) AS d2 FROM fx_spots JOIN {CENTRES_SQL} c ON abs(x-cx) < 20 AND abs(y-cy) < 20) q WHERE d2*16 <= 25*225 AND a = 1 GROUP BY 1,2,3")
def _(fx):
    return D.direction_prior(fx["fx_spots"], E.cell_stats(fx["fx_labels"], "nucleus_id"))


@query("d14_attach_predictions", "SELECT count(*) AS molecules, count(p) AS covered, round(avg(CASE WHEN p > 0.5 THEN 1 ELSE 0 END), 6) AS above FROM fx_records r LEFT JOIN (SELECT 3*x AS x, 3*y AS y, p FROM fx_pred) q USING (x, y)")
def _(fx):
    p = fx["fx_pred"].select((F.col("x") * 3).alias("x"), (F.col("y") * 3).alias("y"), "p")
    x = D.attach_predictions(fx["fx_records"].select("x", "y"), p)
    return x.agg(F.count("*").alias("molecules"), F.count("p").alias("covered"), F.round(F.avg(F.when(F.col("p") > 0.5, 1.0).otherwise(0.0)), 6).alias("above"))


@query("d16_pair_by_nucleus", "WITH_ SELECT nucleus, a, b, count(*) OVER (PARTITION BY a, b) AS same_pair FROM (SELECT nucleus_id AS nucleus, cell_a AS a FROM (SELECT nucleus_id, cell_a, row_number() OVER (PARTITION BY nucleus_id ORDER BY count(*) DESC, cell_a) AS r FROM fx_labels WHERE nucleus_id>0 AND cell_a>0 GROUP BY 1,2) q WHERE r=1) x JOIN (SELECT nucleus_id AS nucleus, cell_b AS b FROM (SELECT nucleus_id, cell_b, row_number() OVER (PARTITION BY nucleus_id ORDER BY count(*) DESC, cell_b) AS r FROM fx_labels WHERE nucleus_id>0 AND cell_b>0 GROUP BY 1,2) q WHERE r=1) y USING (nucleus)".replace("WITH_ ", ""))
def _(fx):
    return C.pair_by_nucleus(fx["fx_labels"], "cell_a", "cell_b").select("nucleus", "a", "b", "same_pair")


@query("d17_resolve_aliases", None)
def _(fx):
    g = fx["part"].select(F.col("p_partkey").alias("ord"), F.upper("p_name").alias("symbol"), S.split_field(F.concat_ws("|", "p_brand", "p_type")).alias("synonyms"))
    return G.resolve_aliases(g)


ORACLE_SQL["d17_resolve_aliases"] = "WITH f AS (SELECT upper(p_name) AS symbol, min(p_partkey) AS ord FROM part GROUP BY 1), g AS (SELECT f.symbol, ord, unnest([upper(trim(p_brand)), upper(trim(p_type))]) AS alias FROM f JOIN part ON p_partkey = ord) SELECT alias, symbol FROM (SELECT alias, symbol, row_number() OVER (PARTITION BY alias ORDER BY ord, symbol) AS r FROM g WHERE alias NOT IN (SELECT symbol FROM f)) q WHERE r = 1"


# --- E: ranking --------------------------------------------------------------------------------------------------

STRATA = "md5(concat_ws(':', '7', CAST(tile AS VARCHAR), CAST(foreground AS VARCHAR), CAST(bx AS VARCHAR), CAST(by_ AS VARCHAR)))"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY tile, foreground ORDER BY {STRATA}, bx, by_) AS r, count(*) OVER (PARTITION BY tile, foreground) AS n FROM fx_samples)"
KEY, CLASS = ["bx", "by_"], ["tile", "foreground"]


@query("e1_split_points", f"SELECT bx, by_, CASE WHEN n >= 2 AND r <= least(greatest(1, round_even(n*0.1, 0)), n-1) THEN 'validation' ELSE 'train' END AS split FROM {RANKED} q")
def _(fx):
    return R.split_points(fx["fx_samples"], CLASS, KEY, 0.1, 7).select(*KEY, "split")


@query("e2_split_80_10_10", f"SELECT bx, by_, CASE WHEN r <= n//10 THEN 'validation' WHEN r <= 2*(n//10) THEN 'test' ELSE 'train' END AS split FROM {RANKED} q")
def _(fx):
    return R.split_80_10_10(fx["fx_samples"], CLASS, KEY, 7).select(*KEY, "split")


@query("e3_split_tiles", "SELECT tile AS id, CASE WHEN n > 1 AND r <= greatest(1, least(n-1, round_even(n*0.3, 0))) THEN 'validation' ELSE 'train' END AS split FROM (SELECT tile, row_number() OVER (ORDER BY md5(concat_ws(':', '7', '1', CAST(tile AS VARCHAR))), tile) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT tile FROM fx_samples) t) q")
def _(fx):
    return R.split_tiles(fx["fx_samples"].select(F.col("tile").alias("id")).distinct(), 0.3, 7)


@query("e4_cap_background", "SELECT bx, by_, foreground FROM (SELECT *, lag(b, 1, 0) OVER (PARTITION BY tile ORDER BY bx, by_) AS was FROM (SELECT *, c + least(0, min(f-c) OVER (PARTITION BY tile ORDER BY bx, by_ ROWS UNBOUNDED PRECEDING)) AS b FROM (SELECT *, sum(CASE WHEN foreground=0 THEN 1 ELSE 0 END) OVER (PARTITION BY tile ORDER BY bx, by_ ROWS UNBOUNDED PRECEDING) AS c, sum(CASE WHEN foreground=1 THEN 1 ELSE 0 END) OVER (PARTITION BY tile ORDER BY bx, by_ ROWS UNBOUNDED PRECEDING) AS f FROM fx_samples) q) z) y WHERE foreground = 1 OR b > was")
def _(fx):
    return R.cap_background(fx["fx_samples"], ["tile"], KEY).select(*KEY, "foreground")


@query("e5_epoch_sample", f"SELECT bx, by_, foreground FROM (SELECT *, row_number() OVER (PARTITION BY tile, foreground ORDER BY md5(concat_ws(':', '7:2', CAST(tile AS VARCHAR), CAST(foreground AS VARCHAR), CAST(bx AS VARCHAR), CAST(by_ AS VARCHAR))), bx, by_) AS r, least(19, sum(foreground) OVER (PARTITION BY tile)) AS pos FROM fx_samples) q WHERE r <= CASE WHEN foreground=1 THEN 19 ELSE least(19, CASE WHEN pos > 0 THEN pos ELSE 19 END) END")
def _(fx):
    return R.epoch_sample(fx["fx_samples"], ["tile"], KEY, 19, 7, 2).select(*KEY, "foreground")


@query("e6_tile_sample", "SELECT bx, by_ FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY md5(concat_ws(':', '7', CAST(tile AS VARCHAR), CAST(bx AS VARCHAR), CAST(by_ AS VARCHAR))), bx, by_) AS r FROM fx_samples) q WHERE r <= 64")
def _(fx):
    return R.tile_sample(fx["fx_samples"], ["tile"], KEY, 64, 7).select(*KEY)


@query("e7_plan_batches", "SELECT batch, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER (ORDER BY md5(concat_ws(':', '7', 'tiles', CAST(tile AS VARCHAR))), tile, md5(concat_ws(':', '7', CAST(tile AS VARCHAR), CAST(bx AS VARCHAR), CAST(by_ AS VARCHAR))), bx, by_)-1)/32) AS BIGINT) AS batch FROM fx_samples) q GROUP BY 1")
def _(fx):
    return R.plan_batches(fx["fx_samples"], ["tile"], KEY, 32, 7, merge=True).groupBy("batch").agg(F.count("*").alias("n"))


@query("e8_balanced_batch", "SELECT bx, by_, direction FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(concat_ws(':', '7', CAST(cls AS VARCHAR), CAST(bx AS VARCHAR), CAST(by_ AS VARCHAR))), bx, by_) AS r FROM (SELECT *, CASE WHEN foreground=1 THEN direction ELSE -1 END AS cls FROM fx_samples) s) q WHERE r <= CASE WHEN cls < 0 THEN 32 ELSE 2 END")
def _(fx):
    return R.balanced_batch(fx["fx_samples"], KEY, 2, 7).select(*KEY, "direction")


@query("e9_prefix_offsets", "SELECT tile, n, CAST(sum(n) OVER (ORDER BY tile) AS BIGINT) AS stop, CAST(sum(n) OVER (ORDER BY tile) AS BIGINT)-n AS start FROM (SELECT tile, count(*) AS n FROM fx_samples GROUP BY 1) q")
def _(fx):
    return R.prefix_offsets(fx["fx_samples"].groupBy("tile").agg(F.count("*").alias("n")), ["tile"], "n")


@query("e10_compact_labels", "SELECT tile, cell_a, row_number() OVER (PARTITION BY tile ORDER BY cell_a) AS local_id, row_number() OVER (ORDER BY tile, cell_a) AS global_id FROM (SELECT DISTINCT CAST(floor(x/150) AS BIGINT) AS tile, cell_a FROM fx_labels WHERE cell_a > 0) q")
def _(fx):
    return R.compact_labels(fx["fx_labels"].withColumn("tile", F.floor(F.col("x") / 150)), "cell_a", ["tile"])


@query("e12_top_k", "SELECT gene_id, CAST(sum(cnt) AS BIGINT) AS umi FROM fx_records GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(fx):
    return R.top_k(fx["fx_records"].groupBy("gene_id").agg(F.sum("cnt").cast("long").alias("umi")), "umi", "gene_id", 10)


@query("e13_half_split", "SELECT repeat, side, count(*) AS n FROM (SELECT repeat, CAST(substr(md5(concat_ws(':', '7', CAST(repeat AS VARCHAR), CAST(x AS VARCHAR), CAST(y AS VARCHAR))), 1, 1) >= '8' AS BIGINT) AS side FROM fx_spots, range(10) t(repeat)) q GROUP BY 1,2")
def _(fx):
    return R.half_split(fx["fx_spots"], 10, 7).groupBy("repeat", "side").agg(F.count("*").alias("n"))


@query("e14_bins", "SELECT bx, by_, CAST(floor(log2(greatest(sum(cnt),1))) AS BIGINT) AS depth, CAST((sum(cnt) > 10)::INT + (sum(cnt) > 30)::INT AS BIGINT) AS q FROM fx_records GROUP BY 1,2")
def _(fx):
    x = E.bin_stats(E.bin_expression(fx["fx_records"]))
    return x.select("bx", "by_", S.log2_bin(F.col("umi")).alias("depth"), S.quantile_bin(F.col("umi"), F.array(F.lit(10), F.lit(30))).alias("q"))


# --- F, G: sets and scalars --------------------------------------------------------------------------------------


@query("f1_union_patches", "SELECT CASE WHEN x % 2 = 0 THEN 'even' ELSE 'odd' END AS patch, count(*) AS n FROM fx_spots GROUP BY 1")
def _(fx):
    s = fx["fx_spots"]
    return J.union_patches({"even": s.filter("x % 2 = 0"), "odd": s.filter("x % 2 = 1"), "none": s.filter("x < 0")}).groupBy("patch").agg(F.count("*").alias("n"))


@query("f2_check_splits", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS unassigned FROM fx_samples")
def _(fx):
    return J.check_splits(R.split_points(fx["fx_samples"], CLASS, KEY, 0.1, 7), KEY)


@query("f3_check_subset", "SELECT DISTINCT cell_b FROM fx_labels WHERE cell_b NOT IN (SELECT cell_b FROM fx_labels WHERE nucleus_id > 0)")
def _(fx):
    x = fx["fx_labels"]
    return J.check_subset(x, x.filter("nucleus_id > 0"), ["cell_b"])


@query("f4_distinct", "SELECT DISTINCT cell_a, cell_b FROM fx_labels")
def _(fx):
    return J.distinct_on(fx["fx_labels"], ["cell_a", "cell_b"])


@query("g1_split_field", "SELECT p_partkey AS id, upper(trim(split_part(concat(p_brand,'|',p_type),'|',1))) AS a, upper(trim(split_part(concat(p_brand,'|',p_type),'|',2))) AS b FROM part")
def _(fx):
    a = S.split_field(F.concat_ws("|", "p_brand", "p_type"))
    return fx["part"].select(F.col("p_partkey").alias("id"), F.get(a, F.lit(0)).alias("a"), F.get(a, F.lit(1)).alias("b"))


@query("g2_gene_symbol", "SELECT gene_id, upper(gene_name) AS symbol, gene_identifier AS identifier FROM fx_genes")
def _(fx):
    n, i = F.col("gene_name"), F.col("gene_identifier")
    return fx["fx_genes"].select("gene_id", S.gene_symbol(n, i).alias("symbol"), S.gene_identifier(n, i).alias("identifier"))


@query("g4_fingerprint", "SELECT gene_id, sha256(concat_ws(chr(31), gene_identifier, gene_name)) AS h FROM fx_genes")
def _(fx):
    return fx["fx_genes"].select("gene_id", S.fingerprint(F.col("gene_identifier"), F.col("gene_name")).alias("h"))


@query("g5_vectors", "SELECT vec_id, round(sqrt(list_sum([CAST(v AS DOUBLE)*CAST(v AS DOUBLE) for v in embedding])), 6) AS norm FROM embeddings")
def _(fx):
    return fx["embeddings"].select("vec_id", F.round(S.vec_norm(F.col("embedding")), 6).alias("norm"))


@query("g6_is_mt", "SELECT gene_id, starts_with(upper(concat(CASE WHEN gene_id % 7 = 0 THEN 'mt-' ELSE '' END, gene_name)), 'MT-') AS mt FROM fx_genes")
def _(fx):
    return fx["fx_genes"].select("gene_id", S.is_mt(F.concat(F.when(F.col("gene_id") % 7 == 0, "mt-").otherwise(""), "gene_name")).alias("mt"))


@query("g7_safe_div", "SELECT bx, by_, round(greatest(least(CAST(bx AS DOUBLE)/nullif(by_ % 4, 0), 9), 1), 6) AS r FROM fx_bins WHERE by_ % 4 <> 0 UNION ALL SELECT bx, by_, NULL FROM fx_bins WHERE by_ % 4 = 0")
def _(fx):
    r = S.safe_div(F.col("bx").cast("double"), F.col("by_") % 4)
    return fx["fx_bins"].select("bx", "by_", F.when(r.isNotNull(), F.round(S.clip(r, 1.0, 9.0), 6)).alias("r"))


# --- H: identity -------------------------------------------------------------------------------------------------

TILED = "(SELECT x, y, cell_a, CAST(floor(x/150) AS BIGINT)*100+CAST(floor(y/150) AS BIGINT) AS tile FROM fx_labels WHERE cell_a > 0)"


def tile_labels(fx, wide=100):
    """Labels of each tile are numbered on their own. The SQL's number of a tile, ix*100+iy, is in the label; a larger wide keeps tiles apart where there are over 100 a side."""
    number = lambda n: F.floor(F.col("x") / 150) * n + F.floor(F.col("y") / 150)
    return fx["fx_labels"].filter("cell_a > 0").select("x", "y", number(wide).alias("tile"), (F.col("cell_a") + number(100) * 10).alias("label"), "cell_a")


def seam_edges(fx, x=None):
    """The pixels of tile_labels, and edges: parts of one cell in several tiles are joined to the first."""
    x = tile_labels(fx) if x is None else x
    parts = x.select("tile", "label", "cell_a").distinct()
    first = parts.groupBy("cell_a").agg(F.min(F.struct("tile", "label")).alias("f"))
    e = parts.join(first, "cell_a").filter("tile <> f.tile").select((F.col("tile") * 10**6 + F.col("label")).alias("ordinal"), F.col("f.tile").alias("tile_a"), F.col("f.label").alias("label_a"), F.col("tile").alias("tile_b"), F.col("label").alias("label_b"))
    return x.select("x", "y", "tile", "label"), e


@query("h1_reconcile_labels", f"SELECT tile, cell_a+tile*10 AS label, min(tile) OVER (PARTITION BY cell_a) AS root_tile, cell_a+10*min(tile) OVER (PARTITION BY cell_a) AS root_label FROM (SELECT DISTINCT tile, cell_a FROM {TILED} t) q")
def _(fx):
    pixels, edges = seam_edges(fx)
    return H.reconcile_labels(edges, pixels.select("tile", "label"))


@query("h3_stitch_slide", f"SELECT row_number() OVER (ORDER BY t, r) AS cell, n AS area, round(sx/n, 6) AS cx, round(sy/n, 6) AS cy FROM (SELECT cell_a, min(tile) AS t, cell_a+10*min(tile) AS r, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM {TILED} q GROUP BY 1) z")
def _(fx):
    pixels, edges = seam_edges(fx)
    return rounded(H.stitch_slide(pixels, edges), "cx", "cy")


# --- I: comparison -----------------------------------------------------------------------------------------------


@query("i1_random_correlation", None)
def _(fx):
    spots = fx["fx_labels"].filter("cell_a > 0").select("x", "y", F.col("cell_a").alias("cell"))
    return rounded(C.split_correlation(fx["fx_records"], R.half_sides(spots, 10, 7), N_GENES), "correlation", digits=5)


SPLIT_SQL = "SELECT cell, round(avg(r), 5) AS correlation, count(r) AS valid_repeats FROM (SELECT repeat, cell, " + PEARSON_SQL.format(n=N_GENES, a="sa", b="sb", aa="saa", bb="sbb", ab="sab") + " AS r FROM (SELECT repeat, cell, CAST(sum(a) AS BIGINT) AS sa, CAST(sum(t-a) AS BIGINT) AS sb, CAST(sum(a*a) AS BIGINT) AS saa, CAST(sum((t-a)*(t-a)) AS BIGINT) AS sbb, CAST(sum(a*(t-a)) AS BIGINT) AS sab FROM (SELECT repeat, cell, gene_id, sum(CASE WHEN side=1 THEN cnt ELSE 0 END) AS a, sum(cnt) AS t FROM fx_records JOIN ({split}) s USING (x, y) GROUP BY 1,2,3) g GROUP BY 1,2) z) y GROUP BY cell"
ORACLE_SQL["i1_random_correlation"] = oracle(SPLIT_SQL.replace("{split}", "SELECT x, y, cell_a AS cell, repeat, CAST(substr(md5(concat_ws(':', '7', CAST(repeat AS VARCHAR), CAST(x AS VARCHAR), CAST(y AS VARCHAR))), 1, 1) >= '8' AS BIGINT) AS side FROM fx_labels, range(10) t(repeat) WHERE cell_a > 0"))


@query("i2_directional_correlation", None)
def _(fx):
    spots = fx["fx_labels"].filter("cell_a > 0").select("x", "y", F.col("cell_a").alias("cell"))
    c = E.cell_stats(fx["fx_labels"], "cell_a").select("cell", F.floor("cx").alias("cx"), F.floor("cy").alias("cy"))
    return rounded(C.split_correlation(fx["fx_records"], R.line_sides(spots.join(c, "cell"), 10).select("x", "y", "cell", "sides"), N_GENES), "correlation", digits=5)


ORACLE_SQL["i2_directional_correlation"] = oracle(SPLIT_SQL.replace("{split}", "SELECT x, y, cell_a AS cell, i AS repeat, CAST((x-cx)*(CASE WHEN i%2=1 THEN i ELSE 10-i END)+(y-cy)*(CASE WHEN i%2=1 THEN 10-i ELSE -i END) >= 0 AS BIGINT) AS side FROM fx_labels JOIN (SELECT cell_a, CAST(floor(avg(x)) AS BIGINT) AS cx, CAST(floor(avg(y)) AS BIGINT) AS cy FROM fx_labels GROUP BY 1) c USING (cell_a), range(10) t(i) WHERE cell_a > 0"))


@query("i3_cross_correlation", None)
def _(fx):
    return rounded(C.cross_correlation(fx["fx_records"], fx["fx_labels"], "cell_a", "cell_b", N_GENES), "source_correlation", "target_correlation", digits=5)


BEST_AB = "(SELECT s, t AS m FROM (SELECT cell_a AS s, cell_b AS t, row_number() OVER (PARTITION BY cell_a ORDER BY count(*) DESC, cell_b) AS r FROM fx_labels WHERE cell_a > 0 AND cell_b > 0 GROUP BY 1,2) q WHERE r = 1)"
ORACLE_SQL["i3_cross_correlation"] = oracle(
    "SELECT cell, round(ra, 5) AS source_correlation, round(rb, 5) AS target_correlation, so AS overlap_umis, sa AS source_unique_umis, sb AS target_unique_umis, least(so,sa,sb) >= 100 AS enough FROM (SELECT *, "
    + PEARSON_SQL.format(n=N_GENES, a="so", b="sa", aa="soo", bb="saa", ab="soa") + " AS ra, " + PEARSON_SQL.format(n=N_GENES, a="so", b="sb", aa="soo", bb="sbb", ab="sob")
    + " AS rb FROM (SELECT cell, CAST(sum(o) AS BIGINT) AS so, CAST(sum(a) AS BIGINT) AS sa, CAST(sum(b) AS BIGINT) AS sb, CAST(sum(o*o) AS BIGINT) AS soo, CAST(sum(a*a) AS BIGINT) AS saa, CAST(sum(b*b) AS BIGINT) AS sbb, CAST(sum(o*a) AS BIGINT) AS soa, CAST(sum(o*b) AS BIGINT) AS sob FROM (SELECT cell, gene_id, sum(o) AS o, sum(a) AS a, sum(b) AS b FROM (SELECT m AS cell, gene_id, 0 AS o, CASE WHEN m=t THEN 0 ELSE cnt END AS a, 0 AS b FROM l WHERE m > 0 UNION ALL SELECT t, gene_id, CASE WHEN m=t THEN cnt ELSE 0 END, 0, CASE WHEN m=t THEN 0 ELSE cnt END FROM l WHERE t > 0) u GROUP BY 1,2) g GROUP BY 1) s) z WHERE ra IS NOT NULL AND rb IS NOT NULL AND least(so,sa,sb) > 0".replace(
        "FROM l WHERE", f"FROM (SELECT gene_id, cnt, coalesce(m, 0) AS m, cell_b AS t FROM fx_records JOIN fx_labels USING (x, y) LEFT JOIN {BEST_AB} b ON b.s = cell_a) l WHERE"
    )
)


@query("i5_transcript_iou", "SELECT manual, coalesce(CASE WHEN mutual THEN p END, NULL) AS predicted, round(CASE WHEN mutual THEN n/(na+nb-n) ELSE 0 END, 6) AS iou, mutual FROM (SELECT a.m AS manual, f.p, f.n, na, nb, coalesce(k.m = a.m, FALSE) AS mutual FROM (SELECT manual_cell AS m, count(*) AS na FROM fx_records JOIN fx_labels USING (x, y) WHERE manual_cell > 0 GROUP BY 1) a LEFT JOIN (SELECT * FROM (SELECT manual_cell AS m, cell_b AS p, count(*) AS n, row_number() OVER (PARTITION BY manual_cell ORDER BY count(*) DESC, cell_b) AS r FROM fx_records JOIN fx_labels USING (x, y) WHERE manual_cell > 0 AND cell_b > 0 GROUP BY 1,2) q WHERE r=1) f ON f.m = a.m LEFT JOIN (SELECT cell_b AS p, count(*) AS nb FROM fx_records JOIN fx_labels USING (x, y) WHERE manual_cell > 0 GROUP BY 1) b ON b.p = f.p LEFT JOIN (SELECT * FROM (SELECT manual_cell AS m, cell_b AS p, row_number() OVER (PARTITION BY cell_b ORDER BY count(*) DESC, manual_cell) AS r FROM fx_records JOIN fx_labels USING (x, y) WHERE manual_cell > 0 AND cell_b > 0 GROUP BY 1,2) q WHERE r=1) k ON k.p = f.p) z")
def _(fx):
    m = fx["fx_records"].join(fx["fx_labels"].filter("manual_cell > 0").select("x", "y", F.col("manual_cell").alias("manual"), F.col("cell_b").alias("predicted")), ["x", "y"])
    return rounded(C.transcript_iou(m), "iou")


@query("i8_segmentation_quality", "SELECT (SELECT count(DISTINCT cell_b) FROM fx_labels WHERE cell_b > 0) AS cells, (SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM fx_labels WHERE cell_b > 0 GROUP BY cell_b) q) AS median_area, (SELECT round(sum(CASE WHEN cell_b > 0 THEN cnt ELSE 0 END)/sum(cnt), 6) FROM fx_records JOIN fx_labels USING (x, y)) AS assigned, (SELECT round(avg(m), 6) FROM (SELECT max(CAST(cell_b > 0 AS INT)) AS m FROM fx_labels WHERE nucleus_id > 0 GROUP BY nucleus_id) z) AS nuclei_matched")
def _(fx):
    return rounded(C.segmentation_quality(fx["fx_records"], fx["fx_labels"], "cell_b"), "assigned", "nuclei_matched")


@query("i10_size_sensitivity", "SELECT cutoff, CAST(sum(CASE WHEN n >= cutoff THEN 1 ELSE 0 END) AS BIGINT) AS cells, CAST(sum(CASE WHEN n >= cutoff THEN n ELSE 0 END) AS BIGINT) AS pixels FROM (SELECT cell_a, count(*) AS n FROM fx_labels WHERE cell_a > 0 GROUP BY 1) q, (SELECT CAST(unnest([8, 200, 450]) AS BIGINT) AS cutoff) c GROUP BY 1")
def _(fx):
    return C.size_sensitivity(fx["fx_labels"], "cell_a", [8, 200, 450])


@query("i11_cell_qc", f"SELECT CASE WHEN n_genes < 150 THEN 'few_genes' WHEN n_genes > 190 THEN 'many_genes' ELSE 'kept' END AS reason, count(*) AS cells, CAST(sum(n_umis) AS BIGINT) AS umis FROM {CELLS_SQL} c GROUP BY 1")
def _(fx):
    return C.qc_summary(C.cell_qc(E.cell_qc_metrics(fx["fx_records"], fx["fx_labels"], "cell_a"), 150, 190))


@query("i12_qc_sensitivity", f"SELECT CAST(lower_ AS BIGINT) AS lower, CAST(sum(CASE WHEN n_genes >= lower_ AND n_genes <= 5000 THEN 1 ELSE 0 END) AS BIGINT) AS cells, CAST(sum(CASE WHEN n_genes >= lower_ AND n_genes <= 5000 THEN n_umis ELSE 0 END) AS BIGINT) AS umis FROM {CELLS_SQL} c, (SELECT unnest([20, 50, 100, 200, 500]) AS lower_) l GROUP BY 1")
def _(fx):
    return C.qc_sensitivity(E.cell_qc_metrics(fx["fx_records"], fx["fx_labels"], "cell_a"))


@query("i13_mask_unmapped", f"SELECT e.gene_id, count(*) AS bins, CAST(sum(cnt) AS BIGINT) AS umis FROM {EXPR} e JOIN fx_genes g ON g.gene_id = e.gene_id WHERE upper(gene_name) IN (SELECT symbol FROM fx_embeddings) GROUP BY 1")
def _(fx):
    look = D.gene_lookup(fx["fx_genes"].select("gene_id", F.upper("gene_name").alias("symbol")), fx["fx_embeddings"])
    return C.mask_unmapped(E.bin_expression(fx["fx_records"]), look).groupBy("gene_id").agg(F.count("*").alias("bins"), F.sum("cnt").cast("long").alias("umis"))


@query("i16_orientation_audit", "SELECT swap, CAST(shift AS BIGINT) AS shift, count(*) AS points, round(avg(CASE WHEN EXISTS (SELECT 1 FROM fx_labels r WHERE cell_a > 0 AND r.x = (CASE WHEN swap THEN q.y ELSE q.x END)+shift AND r.y = (CASE WHEN swap THEN q.x ELSE q.y END)+shift) THEN 1 ELSE 0 END), 6) AS inside FROM (SELECT x, y FROM fx_labels WHERE manual_cell > 0) q, (SELECT unnest([TRUE, FALSE]) AS swap) a, (SELECT unnest([-1, 0]) AS shift) b GROUP BY 1,2")
def _(fx):
    x = fx["fx_labels"]
    return rounded(C.orientation_audit(x.filter("manual_cell > 0"), x.filter("cell_a > 0")), "inside")


# --- J, K: gates and streaming -----------------------------------------------------------------------------------


@query("j1_conservation", "SELECT count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records")
def _(fx):
    r = fx["fx_records"]
    J.assert_conserved(r, E.bin_expression(r), records=False)
    return J.totals(r)


@query("j3_duplicates", "SELECT x, y, gene_id, count(*) AS n FROM fx_records GROUP BY 1,2,3 HAVING count(*) > 1")
def _(fx):
    return J.duplicates(fx["fx_records"], ["x", "y", "gene_id"])


@query("j5_validate_predictions", "SELECT CAST((SELECT count(*) FROM fx_pred WHERE x % 10 = 0) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS not_finite, CAST((SELECT count(*) FROM fx_pred WHERE x % 10 <> 0 AND p > 0.9) AS BIGINT) AS outside")
def _(fx):
    p = fx["fx_pred"].withColumns({"p": F.col("p") + 0.1, "logits": F.array_repeat(F.lit(0.5), 16)})
    p = p.withColumn("p", F.round("p", 6))
    return J.validate_predictions(p.filter("x % 10 <> 0"), fx["fx_pred"])


@query("k1_stream_ingest", "SELECT CAST(floor(x/150) AS BIGINT) AS ix, CAST(floor(y/150) AS BIGINT) AS iy, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis FROM fx_records GROUP BY 1,2")
def _(fx):
    from slidespark.streaming.ingest import stream_ingest

    base = new_folder(fx.spark, "stream")
    fx["fx_records"].select("gene_id", "x", "y", "cnt").repartition(6).write.parquet(f"{base}/in")
    return stream_ingest(fx.spark, f"{base}/in", f"{base}/out", f"{base}/log", 150)


@query("k1_ingest_status", "SELECT 3 AS batches, count(DISTINCT (floor(x/150), floor(y/150))) AS tiles, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS umis, true AS complete FROM fx_records")
def _(fx):
    from slidespark.streaming.ingest import ingest_status, stream_ingest

    base = new_folder(fx.spark, "stream")
    fx["fx_records"].select("gene_id", "x", "y", "cnt").repartition(6).write.parquet(f"{base}/in")
    stream_ingest(fx.spark, f"{base}/in", f"{base}/out", f"{base}/log", 150, files=2)
    return ingest_status(fx.spark, f"{base}/out", fx.spark.read.parquet(f"{base}/in").count())
