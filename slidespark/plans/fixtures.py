"""Derived test tables: one SQL text for both engines; {table} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("lineitem", "part", "embeddings")

RECORDS = """
WITH p AS (SELECT 3*CAST(floor(sqrt(count(*)/6.0)) AS BIGINT) AS s FROM {lineitem}),
r AS (SELECT (l_orderkey*7919+l_linenumber*31) % s AS x, (l_partkey*104729+l_suppkey*17) % s AS y,
 (l_suppkey*5+l_linenumber) % 200 AS gene_id, CAST(l_quantity AS BIGINT) % 9 + 1 AS cnt, s, l_orderkey*8+l_linenumber AS seq FROM {lineitem} CROSS JOIN p),
b AS (SELECT *, CAST(floor(x/3) AS BIGINT) AS bx, CAST(floor(y/3) AS BIGINT) AS by_ FROM r)
SELECT x,y,CAST(gene_id AS BIGINT) AS gene_id,cnt,bx,by_,s,CAST(seq AS BIGINT) AS seq FROM b WHERE (bx*bx+3*by_) % 5 <> 0
"""
LABELS_OF = """
SELECT x,y,CASE WHEN d2<=49 AND (kx+ky)%5<>4 THEN kx*1000+ky+1 ELSE 0 END AS nucleus_id,
 CAST(CASE WHEN d2<=49 THEN 200 WHEN d2<=400 THEN 30 ELSE 5 END AS BIGINT) AS stain,
 CASE WHEN d2<=400 THEN kx*1000+ky+1 ELSE 0 END AS cell_a,
 CASE WHEN e2<=576 THEN 500000+(CASE WHEN ky%2=0 THEN kx-kx%2 ELSE kx END)*1000+ky+1 ELSE 0 END AS cell_b,
 CASE WHEN d2<=484 THEN 900000+kx*1000+ky+1 ELSE 0 END AS manual_cell FROM
 (SELECT *, (x-cx)*(x-cx)+(y-cy)*(y-cy) AS d2, (x-cx-3)*(x-cx-3)+(y-cy+4)*(y-cy+4) AS e2 FROM
  (SELECT *, 72*kx+30+(kx*5+ky*3)%7 AS cx, 72*ky+36-(kx+2*ky)%5 AS cy FROM
   (SELECT x,y,CAST(floor(x/72) AS BIGINT) AS kx,CAST(floor(y/72) AS BIGINT) AS ky FROM {of}) k) c) d
"""
VIEWS = {
    "fx_records": RECORDS,
    "fx_spots": "SELECT DISTINCT x, y FROM {fx_records}",
    "fx_bins": "SELECT DISTINCT bx, by_ FROM {fx_records}",
    "fx_labels": LABELS_OF.replace("{of}", "{fx_spots}"),
    "fx_anchor_labels": LABELS_OF.replace("{of}", "(SELECT 3*bx AS x, 3*by_ AS y FROM {fx_bins}) q"),
    "fx_genes": "SELECT CAST(p_partkey AS BIGINT) AS gene_id, concat('ENS',CAST(p_partkey AS VARCHAR(20))) AS gene_identifier, p_name AS gene_name FROM {part}",
    "fx_embeddings": """SELECT s.symbol, e.embedding FROM (SELECT symbol, row_number() OVER (ORDER BY symbol)-1 AS r FROM
 (SELECT DISTINCT upper(p_name) AS symbol FROM {part}) q) s JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id)-1 AS k, count(*) OVER () AS n FROM {embeddings}) e ON e.k=s.r % e.n WHERE s.r % 8 <> 7""",
    # samples: bins with a class and a foreground flag by integer rules
    "fx_samples": "SELECT bx, by_, CAST(floor(bx/50) AS BIGINT) AS tile, CASE WHEN (bx+2*by_) % 3 = 0 THEN 1 ELSE 0 END AS foreground, (bx*7+by_*3) % 16 AS direction FROM {fx_bins}",
    # predictions: integer rules of the bin
    "fx_pred": "SELECT bx AS x, by_ AS y, foreground, direction AS target, (direction + CASE WHEN (bx+by_) % 4 = 0 THEN 0 ELSE (bx % 3) END) % 16 AS predicted, ((bx*31+by_*17) % 101)/100.0E0 AS p FROM {fx_samples}",
}

#: Views with one row a key. Their values are read as aggregates by key, which changes no row: a filter on a label then stays
#: above that grouping, instead of being written out in full in the join that makes the records, in each branch another way.
KEYS = {"fx_labels": ("x", "y"), "fx_anchor_labels": ("x", "y"), "fx_samples": ("bx", "by_")}


def oracle(body: str, *views: str) -> str:
    """body with the views it names as leading WITH entries."""
    need, todo = [], list(views) or re.findall(r"fx_\w+", body)
    while todo:
        v = todo.pop(0)
        need = [v, *(x for x in need if x != v)]
        todo += re.findall(r"\{(fx_\w+)\}", VIEWS[v])
    parts = [f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v]).strip()})" for v in need]
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Fixtures:
    """The views over one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                need = {n: self[n] for n in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
                view = self.spark.sql(VIEWS[name], **need)
                if keys := KEYS.get(name):
                    view = view.groupBy(*keys).agg(*(F.max(c).alias(c) for c in view.columns if c not in keys))
                self.made[name] = view
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]
