"""Queries that shuffled their table several times, or held a task's whole share of it: how often rows travel, and into how many tasks."""

import pytest

from plumage.plans.catalog import QUERIES
from plumage.sources import fixtures

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


@pytest.mark.parametrize("name,most", [("raster_bubble_fill", 2), ("raster_bubble_write", 4), ("box_order_votes", 1), ("detector_layout_blocks", 2), ("detector_pipeline", 1), ("detector_text_and_bubbles", 5), ("box_reading_order_ltr", 1), ("box_sort_variants", 1)])
def test_shuffles(spark, name, most):
    assert shuffles(QUERIES[name](spark, DIR)) <= most


@pytest.mark.parametrize("name", ["detector_pipeline", "detector_text_and_bubbles"])
def test_pages_are_folded_once(spark, name):
    assert plan(QUERIES[name](spark, DIR)).count("MapIn") == 1


@pytest.mark.parametrize("name", ["box_sort_variants", "box_order_votes", "box_reading_order_ltr", "detector_layout_blocks"])
def test_tasks_grow_in_number_only(spark, name, monkeypatch):
    want = sorted(map(tuple, QUERIES[name](spark, DIR).collect()))
    monkeypatch.setattr(fixtures, "ROWS", 500)
    found = QUERIES[name](spark, DIR)
    assert sorted(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DIR}/lineitem.parquet").count() // 500) > 4
