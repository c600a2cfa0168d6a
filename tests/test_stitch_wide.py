"""P3 on a slide with more than 100 tiles a side, where the SQL's numbers of tiles (ix*100+iy) are not unique."""

import duckdb
from slidespark.plans import registry
from slidespark.plans.fixtures import LABELS_OF, Fixtures
from slidespark.plans.more_queries import ORACLE_SQL, QUERIES


def test_tiles_that_share_a_number_are_told_apart(spark, tmp_path, monkeypatch):
    c = duckdb.connect()
    # two strips of rows, so that cells of tiles 100 columns and a row apart share a number; some lie in one row of buckets
    at = "(SELECT unnest(range(0, 70)) UNION ALL SELECT unnest(range(270, 350))) a(x), (SELECT unnest(range(0, 200)) UNION ALL SELECT unnest(range(15000, 15200))) b(y)"
    c.execute(f"CREATE TABLE fx_records AS SELECT x, y, (x*7+y*3) % 200 AS gene_id, (x+y) % 9 + 1 AS cnt, 15300::BIGINT AS s FROM {at}")
    c.execute(f"CREATE TABLE fx_labels AS {LABELS_OF.replace('{of}', '(SELECT x, y FROM fx_records) q')}")
    sql = ORACLE_SQL["p3_stitch"]
    want = c.execute(sql[sql.index("SELECT cell, area, round(cx") :]).fetchall()
    shared = "SELECT tile FROM (SELECT DISTINCT x//150 AS ix, y//150 AS iy, ix*100+iy AS tile FROM fx_labels WHERE cell_a > 0) GROUP BY 1 HAVING count(*) > 1"
    assert c.execute(shared).fetchall()
    fx = Fixtures(spark, str(tmp_path))
    for name in ("fx_records", "fx_labels"):
        c.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        fx.made[name] = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(registry, "Fixtures", lambda *_: fx)
    got = QUERIES["p3_stitch"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    # numbers by the tiles' rows and columns alone would differ
    first = c.execute("SELECT cell_a, min((x//150, y//150, cell_a)) AS k, min(x//150*100 + y//150) AS t FROM fx_labels WHERE cell_a > 0 GROUP BY 1").fetchall()
    assert [r[0] for r in sorted(first, key=lambda r: tuple(r[1]) if isinstance(r[1], tuple) else tuple(r[1].values()))] != [r[0] for r in sorted(first, key=lambda r: (r[2], r[0]))]
