"""Every registered query has a shape the oracle shares; a sample is compared at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["d05_delay_flags", "q02_line_ranking", "f05_pair_table", "w16_recent_traffic", "w22_forecast_deviation", "g06_project_points", "c12_label_back", "e14_inner_segments", "m12_ranking_metrics"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 240


@pytest.mark.parametrize("name", SAMPLE)
def test_sample(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = connect(SF).sql(entry.oracle_sql()[name]).df()
    assert compare(got, want) in ("", "EMPTY")
