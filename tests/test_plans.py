"""Physical plans: shuffles, pruning and joins stay as designed."""

import re

import pytest

import __spark_entry__ as entry
from tidepanel.operators import diagnostics as dg
from tidepanel.operators import features as ft
from tidepanel.plans import base as b
from tidepanel.plans import q_etl as qe

SF = "/root/testdata/sf0.001"
SW = ft.SeriesWindow()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("series"))
    b.series(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_feature_pool_and_fill_share_one_shuffle(stored):
    pool = ft.feature_pool(stored, SW)
    filled = ft.fill_features(pool, SW, ft.feature_names(pool, SW))
    assert exchanges(filled) == 1


def test_unused_features_are_pruned(stored):
    few = ft.feature_pool(stored, SW).select("series", "ds", "lag_3", "rolling_mean_60")
    assert "stddev" not in plan(few) and exchanges(few) == 1


def test_all_break_rounds_share_one_shuffle(stored):
    assert exchanges(dg.structural_breaks(stored)) == 1


@pytest.mark.parametrize("build", [dg.outliers_mad, dg.seasonal_decompose, dg.cusum, dg.from_first_report])
def test_per_series_diagnostics_shuffle_once(stored, build):
    assert exchanges(build(stored)) == 1


def test_panel_reads_only_its_columns_and_aggregates_before_the_shuffle(spark):
    text = plan(qe.panel_simple(spark, SF))
    lineitem = next(x for x in text.splitlines() if "FileScan" in x and "l_orderkey" in x)
    assert "l_comment" not in lineitem and "l_tax" not in lineitem and "l_shipdate" not in lineitem
    first = [x for x in text.splitlines() if "HashAggregate" in x or "Exchange hash" in x]
    assert "partial_sum" in first[-1]              # the deepest step: sums per input partition, then the shuffle


def test_filter_reaches_the_scan(spark):
    df = b.table(spark, SF, "orders").filter("o_totalprice > 400000").select("o_custkey")
    assert "GreaterThan(o_totalprice" in plan(df)


@pytest.mark.parametrize("name", ["a3_hierarchy_simple", "j4_align_asof", "j7_period_join", "f1_pearson_to_target", "s14_upsert_articles", "k5_duplicate_rows", "m15_rolling_origins", "m24_apply_adjustments", "m31_hodges_lehmann", "d7_kpss_statistic"])
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["a18_column_profile", "a22_rank_table", "m27_wilcoxon_signed_rank", "w2_rolling", "d3_outliers_mad", "s14_upsert_articles", "a3_hierarchy_simple"])
def test_no_single_partition_step(spark, name):
    assert "SinglePartition" not in plan(entry.queries()[name](spark, SF))
