"""What the operators of this subpackage share: input columns, scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows an Arrow batch may hold, so that one batch of long documents fits a worker.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Arrow batches small enough for rows that are whole documents; this package on every executor's path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parents[1]
        if root.is_dir():  # else we run from a shipped archive already
            to = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
            with zipfile.ZipFile(to, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            sc.addPyFile(str(to))
        sc._llm_shipped = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one job in the shared folder. ``keep`` writes a table and reads it back, which cuts its lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in frames:
            p = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def whole_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts empty; other columns, whatever their names, are left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def least_hashes(rows: DataFrame, n: int, salt: str, *keys: str) -> DataFrame:
    """The n rows of least hash of the keys (ties by the keys). A threshold leaves about 4 n rows to be sorted, whatever the number of partitions."""
    total = rows.count()
    h = F.xxhash64(*keys, F.lit(salt))
    if total > 8 * n + 100:
        few = rows.filter(F.pmod(h, F.lit(2**40)) < int(2**40 * 4 * n / total))
        if few.count() >= n:
            rows = few
    return rows.orderBy(F.pmod(h, F.lit(2**40)), *keys).limit(n)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5 == 0


#: Keys that hot_join may broadcast.
HOT = 10_000


def hot_join(rows: DataFrame, of: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of rows with of by keys, where a few keys may hold most rows; n of ``of`` is the number of rows with the key.

    If ``of`` has at most HOT rows, it is broadcast. Else the keys that hold the HOT-th part of the rows or more, of
    which there are HOT at most (times the rows of ``of`` a key), are broadcast, and the others are shuffled. ``of``
    should be a written table: it is read several times."""
    count, total = of.agg(F.count("*"), F.sum(n)).first()
    if count <= HOT:
        return rows.join(F.broadcast(of), keys)
    least = max(total / HOT, 1000)
    hot = F.broadcast(of.filter(F.col(n) >= least))
    cold = rows.join(F.broadcast(of.filter(F.col(n) >= least).select(*keys).distinct()), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(of, keys))


def connected(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by minimum labels with pointer jumping.

    nodes: (id); links: (a, b), either direction, ids of nodes. Returns (id, component), component the smallest
    id reachable. Every round halves the distance to the root, so rounds grow with the logarithm of the longest
    path. Links of a hub are an ordinary skewed join side; nothing is collected. Ids that are in no link keep
    themselves; empty inputs give empty results.
    """
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    label = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        near = label.join(seen, "id").select("id", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        up = near.select(F.col("id").alias("up"), F.col("component").alias("upper"))
        new = scratch.keep(near.join(up, near.component == up.up, "left").select("id", F.least("component", F.coalesce("upper", "component")).alias("component"), "was"))
        changed = new.filter("component <> was").limit(1).count()
        scratch.drop(label)
        label = new
        if not changed:
            break
    scratch.drop(both)
    return nodes.join(label.select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


LONG, INT, STR, DBL, BIN, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BinaryType(), T.BooleanType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
