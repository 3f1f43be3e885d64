"""Physical-plan properties of the registered queries."""
import pytest

from meterlake.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udfs(spark, name):
    p = plan(QUERIES[name](spark, SF))
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p


def test_scan_prunes_columns(spark):
    df = QUERIES["daily_stats"](spark, SF)
    p = plan(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in p
    assert "event_type" not in p.split("ReadSchema")[1].split("\n")[0]


def test_ordered_windows_are_chunked(spark):
    p = plan(QUERIES["segments"](spark, SF))
    # raw readings are windowed per (meter, day chunk), never per meter alone
    assert "hashpartitioning(meter_id#" in p and "_chunk" in p


def test_per_group_limit_for_tails(spark):
    p = QUERIES["trend_tail"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_single_partition_funnel(spark, name):
    """No query moves its data through one partition; the only global top-k is
    the listing page, bounded by max_keys + 1 rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SinglePartition" not in p
    if name != "key_page":
        assert "TakeOrderedAndProject" not in p
