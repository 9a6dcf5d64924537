"""What must hold of the plans of all core queries."""

import re

import pytest

from strataleaf.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"streamed_refreshes", "streamed_hours"}))
def test_no_all_pairs_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_columns_are_pruned(spark, whole_plans):
    read = re.findall(r"ReadSchema: (\S+)", plan(spark, "p3_found"))
    assert read and all(set(re.findall(r"(\w+):", r)) <= {"ledger_id", "snapshot_no", "url", "status", "sha256", "fetched_at"} for r in read)
    read = re.findall(r"ReadSchema: (\S+)", plan(spark, "strata"))
    assert read and not any(c in r for r in read for c in ("catchline", "body", "legacy_cite", "renumbered_from", "doc_id"))
    read = re.findall(r"ReadSchema: (\S+)", plan(spark, "class_counts"))
    assert read and not any(c in r for r in read for c in ("source_line", "all_pas", "note"))


def test_filters_are_pushed(spark, whole_plans):
    assert "IsNotNull(snapshot_no)" in plan(spark, "p3_found")
    assert "EqualTo(snapshot_no,8)" in plan(spark, "coverage")
