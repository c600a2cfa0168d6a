"""The SQL of the seams holds every tile of a slide with more than 100 a side."""

import duckdb

from slidespark.plans.more_queries import SEAM_TILES


def test_seam_tiles_grow_with_the_slide():
    c = duckdb.connect()
    for s in (947, 4800, 4801, 7348):
        c.execute(f"CREATE OR REPLACE TABLE fx_records AS SELECT {s} AS s FROM range(3)")
        assert [r[0] for r in c.execute(f"SELECT ix FROM {SEAM_TILES} a(ix) ORDER BY ix").fetchall()] == list(range(-(-s // 48)))
