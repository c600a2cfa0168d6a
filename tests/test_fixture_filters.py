"""Filters on values of the derived tables stay above the join that makes the records."""

import pytest

from slidespark.plans.fixtures import KEYS, VIEWS, Fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, column", [("fx_labels", "cell_a"), ("fx_labels", "cell_b"), ("fx_anchor_labels", "nucleus_id"), ("fx_samples", "foreground")])
def test_a_filter_on_a_value_stays_out_of_the_join(spark, name, column):
    plan = Fixtures(spark, SF)[name].filter(f"{column} > 0").groupBy(column).count()._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("CASE WHEN" in line or "* 72" in line for line in joins), joins


def test_grouping_by_key_changes_no_row(spark):
    fx = Fixtures(spark, SF)
    for name, keys in KEYS.items():
        need = {n: fx[n] for n in ("fx_spots", "fx_bins") if "{" + n + "}" in VIEWS[name]}
        plain = spark.sql(VIEWS[name], **need)
        assert fx[name].columns == plain.columns and dict(fx[name].dtypes) == dict(plain.dtypes)
        assert plain.count() == plain.select(*keys).distinct().count()
        assert sorted(map(tuple, fx[name].collect())) == sorted(map(tuple, plain.collect()))
