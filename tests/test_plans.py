"""Plans keep what scale depends on: pushed filters, pruned columns, few exchanges, no all-pairs joins."""

import re

import pytest

from verdance.plans import catalogue

SF = "/root/testdata/sf0.001"
#: One-row tables and pairs of a checked few classes.
ALL_PAIRS = {"scalar_broadcast", "sam_pairs", "sam_matrix"}
#: Ranks over tables that have a row per pair of classes, and a top-k report's single merge.
ONE_PARTITION = {"sam_pairs"}


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_all_pairs_join_and_no_global_window(spark, name):
    text = plan(spark, name)
    if name not in ALL_PAIRS:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ONE_PARTITION:
        assert not re.search(r"Window \[.*\n.*Sort.*\n.*Exchange SinglePartition", text)


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(spark, "scene_scan_filter")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate.*LessThan\(l_shipdate", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert "l_comment" not in schema and "l_returnflag" not in schema and "l_tax" not in schema
    assert "l_extendedprice" not in plan(spark, "qa_bitmask")


@pytest.mark.parametrize("name, most", [("defoliation_extent", 3), ("anomaly_sigma_mask", 2), ("relative_deviation", 2), ("glcm_props", 4), ("phenology_dates", 4), ("group_mean_std_count", 1)])
def test_few_exchanges(spark, name, most):
    text = plan(spark, name)
    found = len(re.findall(r"\bExchange (?!SinglePartition)", text))
    assert found <= most, text
