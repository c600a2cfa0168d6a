"""Readers, ingest and sinks of molecule records and their companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidespark.operators.gates import assert_conserved

# fixed values: header spellings of the record files
ALIASES = {
    "gene": ("geneID", "gene", "geneName"),
    "x": ("x", "row"),
    "y": ("y", "column", "col"),
    "cnt": ("MIDCounts", "MIDCount", "UMICount", "UMICounts", "count", "counts"),
}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A1: tab-separated records with a header; # lines are comments; a missing column is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, comment="#")
    found = {}
    for want, names in ALIASES.items():
        hit = next((c for n in names for c in raw.columns if c == n), None)
        if hit is None:
            raise ValueError(f"no column for {want}: one of {names} is needed")
        found[want] = hit
    num = lambda c: F.col(f"`{c}`").cast("long")
    return raw.select(F.col(f"`{found['gene']}`").alias("gene"), *(num(found[k]).alias(k) for k in ("x", "y", "cnt")))


def ingest_records(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A2: (records, genes, bounds) of df (seq, gene, x, y, cnt); gene ids in order of first appearance."""
    g = df.groupBy("gene").agg(F.min("seq").alias("first"), F.count("*").alias("n_records"), F.sum("cnt").cast("long").alias("umis"))
    genes = g.withColumn("gene_id", (F.row_number().over(W.orderBy("first", "gene")) - 1).cast("long")).drop("first")  # one row a gene
    records = df.join(F.broadcast(genes.select("gene", "gene_id")), "gene").select("gene_id", "x", "y", "cnt")
    bounds = df.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("records"), F.sum("cnt").cast("long").alias("umis"))
    return records, genes, bounds


def gene_runs(genes: DataFrame) -> DataFrame:
    """A3: (gene_id, start, stop) of gene-sorted records; genes (gene_id, n). One row a gene."""
    w = W.orderBy("gene_id").rowsBetween(W.unboundedPreceding, 0)
    return genes.select("gene_id", (F.sum("n").over(w) - F.col("n")).cast("long").alias("start"), F.sum("n").over(w).cast("long").alias("stop"))


def decode_gene_runs(positions: DataFrame, runs: DataFrame, bucket: int = 4096) -> DataFrame:
    """A3: positions (pos, ..) with the gene whose run holds them; the interval join is an equi-join on buckets."""
    r = runs.filter("stop > start").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))))
    p = positions.withColumn("_b", F.floor(F.col("pos") / bucket))
    return p.join(r, "_b").filter("pos >= start and pos < stop").drop("_b", "start", "stop")


def _stripe(x: Column, core: int) -> Column:
    """The stripe of a tile that a file holds: 16 a tile at most, and of 2**16 pixels at least, so that small tiles are one file each."""
    return F.floor(F.pmod(x, F.lit(core)) / max(-(-core // 16), -(-(2**16) // core)))


def write_spatial_index(records: DataFrame, path: str, core: int = 1200) -> DataFrame:
    """A4: records by tile, sorted within files so that boxes prune; returns records and counts by tile."""
    x = records.withColumns({"ix": F.floor(F.col("x") / core).cast("int"), "iy": F.floor(F.col("y") / core).cast("int")})
    x.repartition("ix", "iy", _stripe(F.col("x"), core)).sortWithinPartitions("ix", "iy", "x", "y").write.mode("errorifexists").partitionBy("ix", "iy").parquet(path)
    return tile_totals(records.sparkSession.read.parquet(path))


#: Tiles a side that a tile's code leaves room for.
SIDE = 2**20


def tile_code(ix: Column, iy: Column) -> Column:
    """One number for a tile."""
    return ix.cast("long") * SIDE + iy.cast("long")


def read_region(spark: SparkSession, path: str, tiles: list[tuple[int, int]], core: int = 1200, halo: int = 60) -> DataFrame:
    """A4 with D1: the index's records (x, y, gene_id, cnt) in the haloed boxes of the given tiles (ix, iy), each once.

    Only folders of these tiles and of those next to them are read; in them files are sorted, so rows of pixels prune too."""
    if 2 * halo > core:
        raise ValueError("halos of tiles beyond the adjacent ones")
    if not tiles:
        return spark.read.parquet(path).select("x", "y", "gene_id", "cnt").limit(0)
    near = {(ix + dx) * SIDE + iy + dy for ix, iy in tiles for dx in (-1, 0, 1) for dy in (-1, 0, 1) if ix + dx >= 0 and iy + dy >= 0}
    x = spark.read.parquet(path).filter(tile_code(F.col("ix"), F.col("iy")).isin(sorted(near)))
    rows = [ix for ix, _ in tiles]
    x = x.filter((F.col("x") >= min(rows) * core - halo) & (F.col("x") < (max(rows) + 1) * core + halo))
    own = [ix * SIDE + iy for ix, iy in sorted(tiles)]
    corner = lambda a, b: tile_code(F.floor((F.col("x") + a) / core), F.floor((F.col("y") + b) / core)).isin(own)
    inside = corner(-halo, -halo) | corner(-halo, halo) | corner(halo, -halo) | corner(halo, halo)
    return x.filter(inside).select("x", "y", "gene_id", "cnt")


def tile_totals(index: DataFrame) -> DataFrame:
    return index.groupBy(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).agg(F.count("*").alias("records"), F.sum("cnt").cast("long").alias("umis"))


def shard_by_patch(records: DataFrame, size: int = 1200) -> DataFrame:
    """A5: records with patch row and column and patch-local coordinates, in one pass."""
    return records.select(
        F.floor(F.col("x") / size).cast("long").alias("px"), F.floor(F.col("y") / size).cast("long").alias("py"), F.pmod("x", F.lit(size)).alias("x"), F.pmod("y", F.lit(size)).alias("y"), "gene_id", "cnt"
    )


def build_common_input(records: DataFrame, genes: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(spots, counts): observed coordinates in (x, y) order and sums by spot and gene; unknown genes and outside pixels are errors.

    Spot numbers are ranks within rows of pixels plus the rows' offsets, so no task holds all spots."""
    bad = records.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_anti").limit(1).count()
    out = records.filter((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= height) | (F.col("y") >= width)).limit(1).count()
    if bad or out:
        raise ValueError("unknown gene" if bad else "record outside the image")
    xy = records.select("x", "y").distinct()
    per = xy.groupBy("x").agg(F.count("*").alias("n"))
    per = per.select("x", (F.sum("n").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))  # one row a pixel row
    spots = xy.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("y"))).join(F.broadcast(per), "x").select("x", "y", (F.col("start") + F.col("r") - 1).cast("long").alias("spot"))
    counts = records.join(spots, ["x", "y"]).groupBy("spot", "gene_id").agg(F.sum("cnt").cast("long").alias("cnt"))
    return spots, counts


def parse_gene_info(lines: DataFrame, tax_id: int = 9606) -> DataFrame:
    """Lines (line, value) of a 16-column table: the first non-empty value of each field by gene, all synonyms."""
    x = lines.select("line", F.split("value", "\t").alias("f")).filter((F.size("f") >= 16) & (F.get("f", F.lit(0)) == str(tax_id)))
    value = lambda i: F.nullif(F.nullif(F.trim(F.get("f", F.lit(i))), F.lit("-")), F.lit(""))
    x = x.select("line", F.get("f", F.lit(1)).cast("long").alias("gene_id"), *(value(i).alias(n) for n, i in (("symbol", 2), ("synonyms", 4), ("name", 8), ("designations", 13))))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    from slidespark.functions.scalars import split_field

    return x.groupBy("gene_id").agg(first("symbol"), first("name"), first("designations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(split_field(F.col("synonyms")))))).alias("synonyms"))


def read_gene_info(spark: SparkSession, path: str, tax_id: int = 9606) -> DataFrame:
    """As parse_gene_info, from files in the order of their names; lines keep file order.

    Spark packs small files by size, so a line is placed by its file's name and its place among that file's splits."""
    lines = spark.read.text(path).select("value", F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("row")).alias("line"))
    return parse_gene_info(lines, tax_id)


def load_embeddings(df: DataFrame) -> DataFrame:
    """(symbol, embedding) of df (seq, symbol, embedding), upper-cased, the last of a symbol wins; unequal dimensions, empties and non-finite values are errors."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    c = df.agg(F.countDistinct(F.size("embedding")).alias("dims"), F.count_if(~F.coalesce(fine, F.lit(False)) | (F.size("embedding") < 1) | (F.coalesce("symbol", F.lit("")) == "")).alias("bad"), F.count("*").alias("n")).first()
    if not c.n or c.bad or c.dims != 1:
        raise ValueError(f"embeddings: {c.n} rows, {c.dims} dimensions, {c.bad} bad rows")
    return df.groupBy(F.upper("symbol").alias("symbol")).agg(F.max_by("embedding", "seq").alias("embedding"))


def format_predictions(df: DataFrame) -> DataFrame:
    """A10: (x, y, p, logits) as text columns; logits joined by colons with 8 digits."""
    return df.select("x", "y", F.format_string("%.8g", "p").alias("p"), F.concat_ws(":", F.transform("logits", lambda v: F.format_string("%.8g", v))).alias("logits"))


def write_predictions(df: DataFrame, path: str) -> None:
    format_predictions(df).write.csv(path, sep="\t", header=False)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.csv(path, sep="\t", schema="x long, y long, p double, l string", header=False)
    return x.select("x", "y", "p", F.split("l", ":").cast("array<double>").alias("logits"))


def load_schema(spark: SparkSession, path: str) -> dict:
    """A JSON manifest whose fingerprint is the SHA-256 of its other fields in canonical form."""
    import hashlib
    import json

    d = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect()))
    own = d.pop("fingerprint", None)
    if hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest() != own:
        raise ValueError("fingerprint does not match the schema")
    return d | {"fingerprint": own}


def write_cell_stats(stats: DataFrame, path: str) -> None:
    """A12."""
    stats.write.csv(path, header=True)


def write_spot2cell(spots: DataFrame, path: str) -> None:
    """Gzip tab-separated spot -> cell."""
    spots.write.option("compression", "gzip").csv(path, sep="\t", header=True)


def write_cell_matrix(counts: DataFrame, obs: DataFrame, var: DataFrame, path: str) -> None:
    """Three tables; counts are read again and compared."""
    for name, d in (("counts", counts), ("obs", obs), ("var", var)):
        d.write.parquet(f"{path}/{name}")
    assert_conserved(counts, counts.sparkSession.read.parquet(f"{path}/counts"))


def publish(df: DataFrame, path: str, marker: str) -> None:
    """An existing path is refused; the table is written under a temporary name and renamed when whole, then the marker follows.

    A failed write leaves only the temporary folder, which the next run replaces."""
    spark = df.sparkSession
    to, temporary = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.partial"))
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to):
        raise FileExistsError(f"{path} already exists")
    df.write.mode("overwrite").parquet(f"{path}.partial")
    if not fs.rename(temporary, to):
        raise OSError(f"{path}.partial could not be renamed")
    spark.range(1).select(F.lit(path).alias("path")).write.mode("errorifexists").json(marker)


def write_shards(records: DataFrame, path: str, size: int = 1200) -> None:
    """A5: the patches of shard_by_patch as one partition each, written in one pass."""
    x = shard_by_patch(records, size)
    x.repartition("px", "py", _stripe(F.col("x"), size)).write.mode("errorifexists").partitionBy("px", "py").parquet(path)


def flatten_molecules(nested: DataFrame, factor: int = 5) -> DataFrame:
    """Nested (field, cell, gene_id, points array<struct<x, y, z>>) as molecule rows on the grid; z must be 1."""
    m = nested.select("field", F.col("cell").alias("manual"), "gene_id", F.explode("points").alias("p"))
    m = m.withColumn("_ok", F.when(F.col("p.z") == 1, 1).otherwise(F.raise_error(F.lit("z is not 1")).cast("int"))).filter("_ok = 1")
    return m.select("field", "manual", "gene_id", F.floor(F.col("p.x") / factor).cast("long").alias("gx"), F.floor(F.col("p.y") / factor).cast("long").alias("gy"))
