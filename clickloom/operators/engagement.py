"""Counts, click-through and dwell reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.metrics import bucket, ctr, is_type, n_if, pct, rank_in, top, with_total
from ..sources.events import AS_OF, since


def views() -> Column:
    return n_if(is_type("pageview"))


def clicks() -> Column:
    return n_if(is_type("click"))


def daily_summary(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("day").alias("date"), F.col("utm_source").alias("source"), "type").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("unique_sessions"))


def ctr_by_campaign(e: DataFrame) -> DataFrame:
    g = e.groupBy(F.col("campaign_id").alias("campaign"), F.col("utm_source").alias("source")).agg(views().alias("views"), clicks().alias("clicks"), ctr().alias("ctr_pct"))
    return top(g, 50, F.desc("clicks"), F.asc("campaign"), F.asc_nulls_last("source"))


def campaign_steps(e: DataFrame) -> DataFrame:
    """Views, clicks, scrolls and dwells of each campaign, each as a rate of the step before."""
    steps = {"pageviews": "pageview", "clicks": "click", "scrolls": "scroll", "dwells": "dwell"}
    g = e.groupBy(F.col("campaign_id").alias("campaign")).agg(*[n_if(is_type(t)).alias(n) for n, t in steps.items()])
    g = g.select("*", pct("clicks", "pageviews").alias("click_through_pct"), pct("scrolls", "clicks").alias("scroll_after_click_pct"), pct("dwells", "scrolls").alias("dwell_after_scroll_pct"))
    return top(g, 20, F.desc("pageviews"), F.asc("campaign"))


def top_headlines(e: DataFrame) -> DataFrame:
    g = e.filter("tb_headline is not null").groupBy(F.col("tb_headline").alias("headline"), F.col("utm_source").alias("source"))
    g = g.agg(clicks().alias("clicks"), F.count_distinct("campaign_id").alias("num_campaigns"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return top(g, 50, F.desc("clicks"), F.asc("headline"), F.asc("source"))


def top_images(e: DataFrame) -> DataFrame:
    g = e.filter("tb_image is not null").groupBy(F.col("tb_image").alias("image_id"), F.col("utm_source").alias("source"))
    g = g.agg(clicks().alias("clicks"), F.count_distinct("campaign_id").alias("num_campaigns"), F.count_distinct("tb_headline").alias("num_headlines"))
    return top(g, 50, F.desc("clicks"), F.asc("image_id"), F.asc("source"))


def creative_combinations(e: DataFrame, least: int = 10) -> DataFrame:
    g = e.filter("tb_headline is not null and tb_image is not null").groupBy(F.col("tb_headline").alias("headline"), F.col("tb_image").alias("image"))
    return top(g.agg(clicks().alias("clicks"), ctr().alias("ctr")).filter(F.col("clicks") >= least), 20, F.desc("clicks"), F.asc("headline"), F.asc("image"))


def network_comparison(e: DataFrame) -> DataFrame:
    g = e.groupBy(F.col("utm_source").alias("network"))
    return g.agg(views().alias("views"), clicks().alias("clicks"), ctr().alias("ctr"), F.count_distinct("campaign_id").alias("num_campaigns"), F.count_distinct("tb_headline").alias("num_headlines"))


def cross_network_creatives(e: DataFrame) -> DataFrame:
    """Creative ids that more than one network shows."""
    each = lambda c, n: e.filter(F.col(c).isNotNull()).select(F.col(c).alias("creative_id"), F.lit(n).alias("network"))
    g = each("tb_image", "taboola").unionByName(each("ob_creative", "outbrain")).groupBy("creative_id")
    return g.agg(F.count_distinct("network").alias("num_networks"), F.array_sort(F.collect_set("network")).alias("networks")).filter("num_networks > 1")


def trending_campaigns(e: DataFrame, as_of: dt.date = AS_OF, least: int = 10) -> DataFrame:
    """Mean clicks a day in the last week against the week before."""
    daily = since(e, 14, as_of).groupBy("day", F.col("campaign_id").alias("campaign")).agg(clicks().alias("clicks"))
    recent = F.col("day") >= F.lit(as_of - dt.timedelta(days=7))
    g = daily.groupBy("campaign").agg(F.avg(F.when(recent, F.col("clicks"))).alias("recent"), F.avg(F.when(~recent, F.col("clicks"))).alias("prior")).filter(F.col("prior") > least)
    g = g.select("campaign", F.round("recent", 2).alias("recent_clicks"), F.round("prior", 2).alias("prior_clicks"), pct(F.col("recent") - F.col("prior"), "prior").alias("momentum_pct"))
    return top(g, 20, F.desc("momentum_pct"), F.asc("campaign"))


def hourly_pattern(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    return since(e, 7, as_of).groupBy(F.hour("ts").cast("long").alias("hour_of_day"), "type").agg(F.count("*").alias("events"))


def click_rates(e: DataFrame, keys: list[Column], least: int = 0, *more: Column) -> DataFrame:
    """Views, clicks and CTR by any keys, with enough views."""
    return e.groupBy(*keys).agg(views().alias("views"), clicks().alias("clicks"), ctr().alias("ctr_pct"), *more).filter(F.col("views") >= least)


def ctr_campaign(e: DataFrame, least: int = 10) -> DataFrame:
    more = (F.count_distinct("session_id").alias("unique_sessions"), F.count_distinct("user_id").alias("unique_users"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    g = click_rates(e.filter("campaign_id is not null"), ["network", "campaign_id", "campaign_name"], least, *more)
    return top(g, 100, F.desc("clicks"), F.asc("network"), F.asc("campaign_id"), F.asc_nulls_last("campaign_name"))


def ctr_creative(e: DataFrame, least: int = 20) -> DataFrame:
    keys = ["network", "creative_id", "headline", "image_id"]
    g = click_rates(e.filter("creative_id is not null"), keys, least, F.count_distinct("campaign_id").alias("num_campaigns"), F.count_distinct("session_id").alias("unique_sessions"))
    return top(g, 50, F.desc("ctr_pct"), F.desc("clicks"), *map(F.asc, keys))


def ctr_network_daily(e: DataFrame) -> DataFrame:
    return click_rates(e, [F.col("day").alias("date"), "network"], 0, F.count_distinct("campaign_id").alias("active_campaigns"), F.count_distinct("creative_id").alias("active_creatives"))


def ctr_matrix(e: DataFrame, least: int = 5) -> DataFrame:
    """Daily CTR of each creative of a campaign, with its views so far on the days that have enough of them."""
    g = e.filter("campaign_id is not null and creative_id is not null").groupBy("campaign_id", "creative_id", "headline", F.col("day").alias("date"))
    g = g.agg(views().alias("views"), clicks().alias("clicks"), ctr().alias("ctr_pct")).filter(F.col("views") >= least)
    so_far = W.partitionBy("campaign_id", "creative_id").orderBy("date", F.asc_nulls_last("headline")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return g.withColumn("cumulative_views", F.sum("views").over(so_far))


DWELL_CLASSES = [(5_000, "< 5s (bounce)"), (15_000, "5-15s (skim)"), (30_000, "15-30s (reading)"), (60_000, "30-60s (engaged)")]
DWELL_BUCKETS = [(5_000, "0-5s"), (10_000, "5-10s"), (20_000, "10-20s"), (30_000, "20-30s"), (60_000, "30-60s"), (120_000, "1-2m"), (300_000, "2-5m")]


def dwells(e: DataFrame) -> DataFrame:
    return e.filter("type = 'dwell' and dwell_time_ms is not null and session_id is not null")


def dwell_by_session(e: DataFrame, agg: str = "sum") -> DataFrame:
    """Dwell per session and page; agg: `sum`, or `max` where pings carry running totals."""
    g = dwells(e).groupBy("session_id", "url", "network", "campaign_id", "creative_id")
    g = g.agg(getattr(F, agg)("dwell_time_ms").alias("ms"), F.count("*").alias("dwell_ping_count"), F.avg("dwell_visible_pct").alias("v"), F.min("ts").alias("first_dwell_ts"), F.max("ts").alias("last_dwell_ts"))
    g = top(g, 1000, F.desc("ms"), F.asc("session_id"), F.asc("url"), F.asc("network"), F.asc("campaign_id"), F.asc("creative_id"))
    return g.select(
        "session_id", "url", "network", "campaign_id", "creative_id", F.round(F.col("ms") / F.lit(1000.0), 1).alias("dwell_time_seconds"), "dwell_ping_count",
        F.round("v", 1).alias("avg_visible_pct"), "first_dwell_ts", "last_dwell_ts", bucket(F.col("ms"), DWELL_CLASSES, "60s+ (deep)").alias("dwell_category"),
    )


def dwell_by_landing(e: DataFrame, least: int = 5) -> DataFrame:
    ms = F.col("dwell_time_ms")
    sec = lambda c: F.round(c / F.lit(1000.0), 1)
    g = dwells(e).groupBy("url", "network", "campaign_id").agg(
        F.count_distinct("session_id").alias("sessions"), sec(F.avg(ms)).alias("avg_dwell_seconds"), sec(F.min(ms)).alias("min_dwell_seconds"), sec(F.max(ms)).alias("max_dwell_seconds"),
        sec(F.percentile(ms, F.lit(0.5))).alias("median_dwell_seconds"), sec(F.percentile(ms, F.lit(0.9))).alias("p90_dwell_seconds"), F.round(F.avg("dwell_visible_pct"), 1).alias("avg_visible_pct"),
    )
    return top(g.filter(F.col("sessions") >= least), 50, F.desc("avg_dwell_seconds"), F.asc("url"), F.asc("network"), F.asc("campaign_id"))


def dwell_by_creative(e: DataFrame, least: int = 10) -> DataFrame:
    keys = ["campaign_id", "creative_id", "headline", "network"]
    s = dwells(e).groupBy(*keys, "session_id").agg(F.sum("dwell_time_ms").alias("ms"))
    ms = F.col("ms")
    g = s.groupBy(*keys).agg(
        F.count("*").alias("sessions_with_dwell"), F.round(F.avg(ms) / F.lit(1000.0), 1).alias("avg_dwell_seconds"), F.round(F.percentile(ms, F.lit(0.5)) / F.lit(1000.0), 1).alias("median_dwell_seconds"),
        n_if(ms < 5000).alias("bounce_count"), n_if(ms >= 30000).alias("engaged_count"), pct(n_if(ms >= 30000), F.count("*"), 1).alias("engagement_rate_pct"),
    )
    return top(g.filter(F.col("sessions_with_dwell") >= least), 50, F.desc("avg_dwell_seconds"), *map(F.asc, keys))


def dwell_inferred(e: DataFrame) -> DataFrame:
    """Dwell as the time to the session's next event; the last event counts for 30 minutes, longer gaps for nothing."""
    w = W.partitionBy("session_id").orderBy("ts")
    gap = F.timestamp_diff("MILLISECOND", F.col("ts"), F.coalesce(F.lead("ts").over(w), F.col("ts") + F.expr("interval 30 minutes")))
    s = e.filter("session_id is not null").select("session_id", "url", "ts", gap.alias("ms"), F.lead("url").over(w).alias("next_url")).filter("ms <= 1800000")
    sec = lambda c: F.round(c / F.lit(1000.0), 1)
    g = s.groupBy("session_id", "url").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("event_count"), F.max("ms").alias("most"), sec(F.max("ms")).alias("max_dwell_seconds"),
        sec(F.avg("ms")).alias("avg_dwell_seconds"), F.max(F.when(F.col("next_url").isNull(), "exited").otherwise("continued")).alias("exit_type"),
    )
    return top(g, 100, F.desc("most"), F.asc("session_id"), F.asc("url")).drop("most")


def dwell_histogram(e: DataFrame) -> DataFrame:
    d = e.filter("type = 'dwell' and dwell_time_ms is not null")
    g = d.groupBy(bucket(F.col("dwell_time_ms"), DWELL_BUCKETS, "5m+").alias("dwell_bucket")).agg(F.count("*").alias("dwell_events"), F.count_distinct("session_id").alias("unique_sessions"))
    g = with_total(g, "unique_sessions", "t", few=True).select("dwell_bucket", "dwell_events", "unique_sessions", pct("unique_sessions", "t", 1).alias("session_pct"))
    return g.orderBy(rank_in("dwell_bucket", [*[label for _, label in DWELL_BUCKETS], "5m+"]))
