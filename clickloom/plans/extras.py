"""Registered queries of single operators (joins, maps, registries, streams in their batch form), with their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.maps import query_map, query_string
from ..functions.metrics import is_type, n_if, pct
from ..functions.normalize import normalized
from ..operators import dimensions as di, sessions as se
from ..schema import sanitized
from ..sources.events import events, read_table, with_params
from ..sources.lake import campaigns, creatives
from ..sources.published import scratch
from ..sources.registry import read_metrics, with_missing_days
from ..sources.sinks import write_metrics
from ..streaming.ingest import live_traffic
from .oracle import BASE, C, V, us


def user_trees(spark: SparkSession, d: str) -> DataFrame:
    t = di.user_trees(events(spark, d))
    return t.select("user_id", "session_count", "acquired_by", "conversions", "events", "active_days", "first_seen", "last_seen", F.aggregate("sessions", F.lit(0).cast("long"), lambda a, s: a + s["event_count"]).alias("events_in_sessions"))


def session_containment(spark: SparkSession, d: str) -> DataFrame:
    return di.converting_sessions(events(spark, d)).select("user_id", "goal_ts", "goal", F.col("seq").cast("long").alias("seq"), "session_start", "session_end")


def normalized_events(spark: SparkSession, d: str) -> DataFrame:
    return normalized(with_params(events(spark, d)).select("event_id", "params")).select("event_id", "network", "campaign_id", "creative_id", "headline", "image_id")


def page_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Each parameter of a page's query, and the query made again from the map."""
    m = read_table(spark, d, "pages").select("page_id", query_map(F.regexp_extract("url", r"\?([^#]*)", 1)).alias("m"))
    return m.select("page_id", query_string(F.col("m")).alias("query"), F.explode_outer("m").alias("name", "value"))


def campaign_dimension(spark: SparkSession, d: str) -> DataFrame:
    return campaigns(events(spark, d).withColumn("campaign_name", F.upper("campaign_id")))


def creative_dimension(spark: SparkSession, d: str) -> DataFrame:
    return creatives(events(spark, d))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Users who clicked and purchased, and those who clicked but did not convert on the web's first page."""
    e = events(spark, d)
    users = lambda c: e.filter(c).select("user_id", "url")
    both = users(is_type("click")).intersect(users(is_type("purchase"))).withColumn("part", F.lit("both"))
    only = users(is_type("click")).exceptAll(users(is_type("conversion"))).distinct().withColumn("part", F.lit("only"))
    return both.unionByName(only)


def rollup_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Exact percentile of a value for each group of a rollup: (*keys, level, percentile), `level` as grouping_id gives it.

    Approximate percentiles about p cut each group's values into a few parts. These are counted, and only the part that holds the exact place is put in order, each
    different value once, so that no task gathers a group. The cuts decide how small that part is, not what is found in it.
    """
    df = df.filter(F.col(value).isNotNull())
    cuts = [x for x in (p - 0.05, p - 0.005, p - 0.0005, p + 0.0005, p + 0.005, p + 0.05) if 0 <= x <= 1]
    size = df.rollup(*keys).agg(F.grouping_id().alias("level"), F.percentile_approx(value, cuts, 2000).alias("cuts"), (F.lit(p) * (F.count("*") - 1)).alias("place"))
    size = F.broadcast(size.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("level").alias("of_level"), "cuts", "place"))
    own = reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], F.col("level") == F.col("of_level"))
    values = df.groupingSets([[*keys[:i], value] for i in range(len(keys), -1, -1)], *keys, value)
    values = values.agg(F.floor(F.grouping_id() / 2).alias("level"), F.count("*").alias("n")).join(size, own).select(*keys, "level", value, "n", "place", F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("part"))
    group = [*keys, "level"]
    below = F.sum("n").over(W.partitionBy(*group).orderBy("part"))
    parts = values.groupBy(*group, "part", "place").agg(F.sum("n").alias("n")).withColumn("below", below - F.col("n"))
    parts = parts.filter((F.col("below") <= F.ceil("place")) & (F.col("below") + F.col("n") > F.floor("place")))
    parts = F.broadcast(parts.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("level").alias("of_level"), F.col("part").alias("of_part"), "below"))
    near = values.join(parts, own & (F.col("part") == F.col("of_part")))
    near = near.withColumn("upto", F.col("below") + F.sum("n").over(W.partitionBy(*group, "part").orderBy(value)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    ends = near.groupBy(*group, "place").agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"))
    between = (F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b")
    return ends.select(*group, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).cast("double").alias("percentile"))


def lineitem_profile(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles, deviation and totals of prices with subtotals."""
    li, keys = read_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    totals = li.rollup(*keys).agg(
        F.grouping_id().alias("level"), F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.stddev_samp("l_quantity"), 6).alias("deviation"), F.count_distinct("l_suppkey").alias("suppliers")
    )
    p90 = rollup_percentile(li, keys, "l_extendedprice", 0.9).select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("level").alias("of_level"), F.round("percentile", 4).alias("p90"))
    own = reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], F.col("level") == F.col("of_level"))
    return totals.join(p90, own, "left").select(*keys, "rows", "total", "deviation", "p90", "suppliers")


def customer_running_total(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_totalprice").over(w).alias("before"), F.row_number().over(w).cast("long").alias("position"))


def nation_orders(spark: SparkSession, d: str) -> DataFrame:
    """Left and semi joins: orders of each nation's customers that have a returned item."""
    returned = read_table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = read_table(spark, d, "orders").join(returned, "o_orderkey", "left_semi")
    c = read_table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = read_table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


def filled_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Each creative on every day between its first and last, with zero where nothing happened, and the value three days before."""
    g = events(spark, d).groupBy("creative_id", "day").agg(n_if(is_type("click")).alias("clicks"))
    span = g.groupBy("creative_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    full = span.select("creative_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")).join(g, ["creative_id", "day"], "left").fillna(0, ["clicks"])
    before = full.select("creative_id", F.date_add("day", 3).alias("day"), F.col("clicks").alias("clicks_before"))
    return full.join(before, ["creative_id", "day"], "left").select("creative_id", F.col("day").cast("string").alias("day"), "clicks", "clicks_before")


def daily_metrics(e: DataFrame) -> DataFrame:
    m = e.groupBy("network", F.date_format("day", "yyyyMMdd").cast("int").alias("date"), "campaign_id")
    return m.agg(n_if(is_type("pageview")).alias("impressions"), n_if(is_type("click")).alias("clicks"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("spend_micros"))


def spend_rollup(spark: SparkSession, d: str) -> DataFrame:
    return di.spend(daily_metrics(events(spark, d)))


def metric_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each campaign of a network after an upsert of each event as a new version."""
    e = events(spark, d).select("network", "campaign_id", F.col("type").alias("status"), F.col("event_id").alias("synced_at"))
    old, new = e.filter("synced_at % 2 = 0"), e.filter("synced_at % 2 = 1")
    return di.upserted(old, new, ("network", "campaign_id"))


def sanitized_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    e = events(spark, d).select("event_id", (k * 2 - 20).cast("long").alias("scroll_depth_pct"), (k - 50).cast("long").alias("dwell_time_ms"), (k % 4).cast("long").alias("viewport_width"), (k / F.lit(50.0)).alias("quality_score"))
    return sanitized(e)


def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    return live_traffic(events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def live_session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = se.live_sessions(events(spark, d))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "event_count")


def campaign_rates(spark: SparkSession, d: str) -> DataFrame:
    """Click-through rate from aliases of the same selection."""
    g = events(spark, d).groupBy("campaign_id").agg(n_if(is_type("pageview")).alias("views"), n_if(is_type("click")).alias("clicks"))
    return g.withColumn("rate", pct("clicks", "views"))


def parameter_groups(spark: SparkSession, d: str) -> DataFrame:
    """Events by their whole set of parameters: maps are equal whatever the order of their keys, which here changes from event to event."""
    e = with_params(events(spark, d))
    e = e.withColumn("params", F.map_filter("params", lambda k, v: k.isin("network", "utm_medium", "campaign_id", "tb_headline")))
    turned = F.map_from_entries(F.reverse(F.map_entries("params")))
    g = e.select(F.when(F.col("event_id") % 2 == 0, F.col("params")).otherwise(turned).alias("params"), "type", "session_id").groupBy("params")
    g = g.agg(F.count("*").alias("events"), n_if(is_type("click")).alias("clicks"), F.count_distinct("session_id").alias("sessions"))
    named = lambda n: F.try_element_at("params", F.lit(n)).alias(n)
    return g.select(query_string(F.col("params")).alias("params"), named("campaign_id"), named("tb_headline"), F.array_contains(F.map_keys("params"), "utm_medium").alias("has_medium"), "events", "clicks", "sessions")


def registry_days(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views of each network, from a metric registry that is written and read back for a list of days, two of which it does not have."""
    path = scratch(spark, "registry")
    m = events(spark, d).groupBy(F.col("day").alias("date"), "network").agg(n_if(is_type("pageview")).alias("impressions"), n_if(is_type("click")).alias("clicks"))
    write_metrics(m, path)
    rows, missing = read_metrics(spark, path, [dt.date(2024, 1, 20) + dt.timedelta(days=i) for i in range(14)])
    return with_missing_days(spark, rows, missing).withColumn("date", F.col("date").cast("string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "t01_user_trees": user_trees,
    "jn16_session_containment": session_containment,
    "jn06_filled_calendar": filled_calendar,
    "jn12_nation_orders": nation_orders,
    "v19_normalized_events": normalized_events,
    "fn26_page_parameters": page_parameters,
    "fn40_sanitized_values": sanitized_values,
    "src06_campaigns": campaign_dimension,
    "src06_creatives": creative_dimension,
    "set02_set_operations": set_operations,
    "agg11_lineitem_profile": lineitem_profile,
    "win13_customer_running_total": customer_running_total,
    "q09_campaign_rates": campaign_rates,
    "q11_spend_rollup": spend_rollup,
    "t03_metric_upsert": metric_upsert,
    "str_hourly_windows": hourly_windows,
    "str_live_sessions": live_session_windows,
    "agg16_parameter_groups": parameter_groups,
    "src11_registry_days": registry_days,
}

_WHOLE = f"w AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 0 WHEN {us('lag(ts) OVER (PARTITION BY user_id ORDER BY ts)', 'ts')} // 60000000 > 30 THEN 1 ELSE 0 END AS st FROM ev), sq AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS seq FROM w)"
_GAPS = f"w AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR {us('lag(ts) OVER (PARTITION BY user_id ORDER BY ts)', 'ts')} > 1800000000 THEN 1 ELSE 0 END AS st FROM ev), sq AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS seq FROM w)"

_PARAMS = [f"CASE WHEN {v} IS NOT NULL THEN '{n}=' || replace({v}, ' ', '%20') END" for n, v in (("campaign_id", "campaign_id"), ("network", "network"), ("tb_headline", "tb_headline"), ("utm_medium", "utm_medium"))]

ORACLE_SQL: dict[str, str] = {
    "agg16_parameter_groups": f"""{BASE} SELECT concat_ws('&', {", ".join(_PARAMS)}) AS params, campaign_id, tb_headline, utm_medium IS NOT NULL AS has_medium, count(*) AS events, {C} AS clicks, count(DISTINCT session_id) AS sessions
FROM ev GROUP BY network, utm_medium, campaign_id, tb_headline""",
    "src11_registry_days": f"""{BASE}, m AS (SELECT day, network, {V} AS impressions, {C} AS clicks FROM ev GROUP BY day, network), days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT CAST(days.day AS VARCHAR) AS date, network, impressions, clicks, network IS NULL AS is_missing FROM days LEFT JOIN m ON m.day = days.day""",
    "t01_user_trees": f"""{BASE}, {_WHOLE}, a AS (SELECT user_id, arg_min(network, ts) AS acquired_by FROM ev WHERE network <> 'unknown' GROUP BY 1)
SELECT user_id, count(DISTINCT seq) AS session_count, any_value(acquired_by) AS acquired_by, count(*) FILTER (type = 'conversion') AS conversions, count(*) AS events, count(DISTINCT day) AS active_days, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events_in_sessions FROM sq LEFT JOIN a USING (user_id) GROUP BY user_id""",
    "jn16_session_containment": f"""{BASE}, {_WHOLE}, b AS (SELECT user_id, seq, min(ts) AS session_start, max(ts) AS session_end FROM sq GROUP BY 1, 2) SELECT b.user_id, ts AS goal_ts, type AS goal, seq, session_start, session_end FROM ev JOIN b ON b.user_id = ev.user_id AND ts BETWEEN session_start AND session_end WHERE type IN ('conversion', 'purchase')""",
    "jn06_filled_calendar": f"""{BASE}, g AS (SELECT creative_id, day, {C} AS clicks FROM ev GROUP BY 1, 2), s AS (SELECT creative_id, unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS t FROM g GROUP BY 1),
f AS (SELECT s.creative_id, CAST(t AS DATE) AS day, coalesce(clicks, 0) AS clicks FROM s LEFT JOIN g ON g.creative_id = s.creative_id AND g.day = CAST(t AS DATE)) SELECT f.creative_id, CAST(f.day AS VARCHAR) AS day, f.clicks, b.clicks AS clicks_before FROM f LEFT JOIN f b ON b.creative_id = f.creative_id AND b.day = f.day - 3""",
    "jn12_nation_orders": """SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) o ON o_custkey = c_custkey GROUP BY n_name""",
    "v19_normalized_events": f"""{BASE} SELECT event_id, network, campaign_id, CASE network WHEN 'taboola' THEN tb_image WHEN 'outbrain' THEN ob_creative WHEN 'unknown' THEN creative_id END AS creative_id, CASE network WHEN 'taboola' THEN tb_headline END AS headline,
CASE network WHEN 'taboola' THEN tb_image WHEN 'outbrain' THEN ob_creative END AS image_id FROM ev""",
    "fn26_page_parameters": r"""WITH q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages), p AS (SELECT page_id, unnest(string_split(q, '&')) AS pair FROM q WHERE q LIKE '%=%'),
kv AS (SELECT page_id, split_part(pair, '=', 1) AS name, split_part(pair, '=', 2) AS value FROM p), m AS (SELECT page_id, string_agg(name || '=' || value, '&' ORDER BY name) AS query FROM kv GROUP BY 1)
SELECT q.page_id, coalesce(query, '') AS query, name, value FROM q LEFT JOIN m ON m.page_id = q.page_id LEFT JOIN kv ON kv.page_id = q.page_id""",
    "fn40_sanitized_values": f"""{BASE} SELECT event_id, CASE WHEN 2 * k - 20 BETWEEN 0 AND 100 THEN CAST(2 * k - 20 AS BIGINT) END AS scroll_depth_pct, CASE WHEN k >= 50 THEN CAST(k - 50 AS BIGINT) END AS dwell_time_ms, CASE WHEN k % 4 > 0 THEN CAST(k % 4 AS BIGINT) END AS viewport_width,
CASE WHEN k <= 50 THEN k / 50.0::DOUBLE END AS quality_score FROM ev""",
    "src06_campaigns": f"{BASE} SELECT DISTINCT campaign_id, upper(campaign_id) AS campaign_name, network FROM ev",
    "src06_creatives": f"{BASE} SELECT DISTINCT creative_id, headline, image_id, network FROM ev",
    "set02_set_operations": f"""{BASE} SELECT user_id, url, 'both' AS part FROM (SELECT user_id, url FROM ev WHERE type = 'click' INTERSECT SELECT user_id, url FROM ev WHERE type = 'purchase')
UNION ALL SELECT DISTINCT user_id, url, 'only' FROM (SELECT user_id, url FROM ev WHERE type = 'click' EXCEPT ALL SELECT user_id, url FROM ev WHERE type = 'conversion')""",
    "agg11_lineitem_profile": """SELECT l_returnflag, l_linestatus, count(*) AS rows, round(sum(l_extendedprice), 2) AS total, round(stddev_samp(l_quantity), 6) AS deviation, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "win13_customer_running_total": """SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_totalprice) OVER w AS before, row_number() OVER w AS position FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "q09_campaign_rates": f"{BASE} SELECT campaign_id, {V} AS views, {C} AS clicks, round(100.0::DOUBLE * {C} / nullif({V}, 0), 2) AS rate FROM ev GROUP BY 1",
    "q11_spend_rollup": f"""{BASE}, m AS (SELECT network, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date, {V} AS impressions, {C} AS clicks, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS spend_micros FROM ev GROUP BY 1, 2)
SELECT *, CASE WHEN impressions > 0 THEN clicks * 10000 // impressions END AS ctr_bps, CASE WHEN clicks > 0 THEN spend_micros // clicks END AS cpc_micros, CASE WHEN impressions > 0 THEN spend_micros * 1000 // impressions END AS cpm_micros FROM m""",
    "t03_metric_upsert": f"{BASE} SELECT network, campaign_id, arg_max(type, event_id) AS status, max(event_id) AS synced_at FROM ev GROUP BY 1, 2",
    "str_hourly_windows": f"{BASE} SELECT date_trunc('hour', ts) AS start, network, count(*) AS events, {V} AS views, {C} AS clicks FROM ev GROUP BY 1, 2",
    "str_live_sessions": f"{BASE}, {_GAPS} SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS event_count FROM sq GROUP BY user_id, seq",
}
