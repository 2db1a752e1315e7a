"""Every registered report against its SQL, on the smallest tables."""

import datetime as dt
import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.operators import views as vi
from clickloom.plans import catalog, extras, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(df):
    value = lambda v: None if v is None or v is pd.NA or v != v else bool(v) if isinstance(v, (bool, np.bool_)) else round(float(v), 6) if isinstance(v, numbers.Number) else v
    return sorted(repr(tuple(map(value, row))) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


QUERIES, SQL = catalog.queries() | extras.QUERIES, oracle.oracle_sql() | extras.ORACLE_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_report(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_percentiles_of_odd_groups(spark):
    """Places are exact for repeated, missing and far-off values and for missing keys, and no task gathers a group's values."""
    rows = [("a", None, float(i % 7)) for i in range(200)] + [(None, "x", 1e9), (None, "x", None), ("b", "x", None)]
    rows += [("c", "y", v) for v in (-5.0, 3.0, 3.0, 1e300)] + [("c", "z", float(i * i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, m string, v double")
    for p in (0.0, 0.5, 0.9, 1.0):
        want = df.rollup("k", "m").agg(F.grouping_id().alias("level"), F.percentile("v", F.lit(p)).alias("p")).filter("p is not null")
        got = extras.rollup_percentile(df, ["k", "m"], "v", p)
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in want.collect())))
    plan = extras.lineitem_profile(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan


def test_unknown_report(spark):
    with pytest.raises(KeyError, match="r01_daily_summary"):
        catalog.run_report(spark, SF, "nothing")


def test_filters_reach_the_scan(spark):
    plan = catalog.run_report(spark, SF, "r02_ctr_by_campaign", start=dt.datetime(2024, 1, 5), end=dt.datetime(2024, 1, 9))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "event_id" not in plan.split("ReadSchema")[1]


def test_summaries_see_all_rows(spark):
    plan = catalog.run_report(spark, SF, "r10b_fatigue_summary")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_look_back_reports_take_a_day(spark):
    for report in catalog.REPORTS.values():
        if not report.ranged:
            with pytest.raises(ValueError, match="no start or end"):
                report.over(None, end=dt.datetime(2024, 1, 20))
    assert catalog.REPORTS["v22_creative_ctr_change"].looks_back and catalog.REPORTS["r10b_fatigue_summary"].looks_back
    assert not catalog.REPORTS["v10_cross_network_assets"].looks_back and not catalog.REPORTS["r01_daily_summary"].looks_back
    early, late = (catalog.run_report(spark, SF, "v03_network_daily", as_of=dt.date(2024, 1, day)).count() for day in (1, 31))
    assert early >= late


def test_means_on_a_rounding_border(spark):
    """Eight rates add up to 314.29; an eighth of it is 39.28625."""
    clicks = dict(enumerate([(1, 3), (2, 3), (1, 7), (2, 7), (3, 7), (4, 7), (5, 7), (0, 1)], 1))
    rows = [(dt.datetime(2024, 1, 10 + d), dt.date(2024, 1, 10 + d), "x", kind) for d, (c, v) in clicks.items() for kind in ["click"] * c + ["pageview"] * v]
    rows += [(dt.datetime(2024, 1, 30), dt.date(2024, 1, 30), "x", kind) for kind in ("click", "pageview")]
    got = vi.ctr_change(spark.createDataFrame(rows, "ts timestamp_ntz, day date, h string, type string"), keys=("h",), known="h", least=1).first()
    assert (got["recent_ctr"], got["prior_ctr"]) == (100.0, 39.2863)


@pytest.mark.parametrize("name", ["r10a_creative_fatigue", "r16_attribution_first_touch", "r17_attribution_last_touch", "r22_common_paths", "c09_dwell_histogram", "c12_funnel_drop_off", "q06_engagement_levels", "v04_daily_session_summary"])
def test_events_are_read_once(spark, name):
    report = catalog.run_report(spark, SF, name)
    report.collect()
    assert report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1


def test_session_views_do_not_read_all_history(spark):
    plan = catalog.run_report(spark, SF, "v05_session_funnels")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2023-12-25" in plan


def test_buckets_come_in_order(spark):
    order = lambda name, column: [r[column] for r in catalog.run_report(spark, SF, name).collect()]
    found = order("c09_dwell_histogram", "dwell_bucket")
    assert found == [x for x in ("0-5s", "5-10s", "10-20s", "20-30s", "30-60s", "1-2m", "2-5m", "5m+") if x in found]
    stages = catalog.run_report(spark, SF, "c12_funnel_drop_off").collect()
    rank = ["no_engagement", "view_only", "clicked_no_scroll", "single_page", "multi_page_no_convert", "converted", "other"].index
    keys = [(r["campaign_id"], r["network"], rank(r["drop_stage"])) for r in stages]
    assert keys == sorted(keys)
    found = order("r27_returning_user_analysis", "user_segment")
    assert found == [x for x in ("new", "returning_2", "returning_3_5", "returning_6_10", "returning_11_plus") if x in found]
