"""Views over events, sessions and assets, and the documented stand-alone queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.metrics import bucket, days, is_type, n_if, pct, ratio, seconds, top, with_total
from ..schema import DEFAULTS, EVENTS, VERSIONS, columns_of, evolved
from ..sources.events import AS_OF, since
from .engagement import click_rates, clicks, views


def day() -> Column:
    return F.col("day").alias("date")


def ago(days_: int, as_of: dt.date):
    return F.lit(as_of - dt.timedelta(days=days_))


# --- events ----------------------------------------------------------------------------------------------------------


def campaign_daily(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    g = since(e, 90, as_of).groupBy(day(), "network", "campaign_id")
    return g.agg(
        views().alias("views"), clicks().alias("clicks"), n_if(is_type("scroll")).alias("scrolls"), n_if(is_type("dwell")).alias("dwells"), F.count_distinct("session_id").alias("unique_sessions"), F.count_distinct("user_id").alias("unique_users"),
        pct(clicks(), views()).alias("ctr_pct"), pct(n_if(is_type("scroll")), views()).alias("scroll_rate_pct"),
    )


def creative_performance(e: DataFrame, as_of: dt.date = AS_OF, least: int = 100) -> DataFrame:
    more = (F.count_distinct("campaign_id").alias("num_campaigns"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return click_rates(since(e, 30, as_of).filter("creative_id is not null"), ["network", "creative_id", "headline"], least, *more)


def network_daily(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    return click_rates(since(e, 30, as_of), [day(), "network"], 0, F.count_distinct("campaign_id").alias("campaigns"), F.count_distinct("creative_id").alias("creatives"))


def compatible(e: DataFrame) -> DataFrame:
    """All columns of the newest schema version: defaults for those that older files lack, else null."""
    have, ts = set(e.columns), e.schema["ts"].dataType

    def one(f: T.StructField) -> Column:
        c = F.col(f.name) if f.name in have else F.lit(None).cast(ts if isinstance(f.dataType, T.TimestampType) else f.dataType)
        return (F.coalesce(c, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else c).alias(f.name)

    return e.select(*map(one, EVENTS))


def quality_filtered(e: DataFrame) -> DataFrame:
    """Valid, verified events of good quality; what is unknown counts as good."""
    good = F.col("is_valid") & F.col("is_verified") & (F.col("quality_score") >= 0.5) & (F.col("bot_probability") < 0.5) & (F.col("fraud_score") < 0.5)
    return compatible(e).filter(good).select(*[n for n, _ in columns_of(1)], "referrer", "device_type")


def engagement_events(e: DataFrame) -> DataFrame:
    """Page views, scrolls and dwells with their measures; only the score has a default."""
    kept = ("ts", "network", "campaign_id", "creative_id", "headline", "type", "device_type", "device_os", *[n for n, _ in VERSIONS[3]])
    found = evolved(e.filter(is_type("scroll", "dwell", "pageview")).withColumn("at", F.col("ts"))).withColumn("ts", F.col("at"))
    return found.select(*kept, F.coalesce("quality_score", F.lit(1.0)).alias("quality_score"), "attribution_touches", "attribution_days_to_convert")


def attribution_daily(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    mean = lambda c, default=None: F.round(F.avg(c if default is None else F.coalesce(c, F.lit(default))), 6)
    return since(e, 90, as_of).groupBy(day(), "network", "campaign_id", "campaign_name", "creative_id", "headline").agg(
        views().alias("views"), clicks().alias("clicks"), n_if(is_type("scroll")).alias("scrolls"), n_if(is_type("dwell")).alias("dwells"),
        mean("attribution_touches").alias("avg_touches_to_convert"), mean("attribution_days_to_convert").alias("avg_days_to_convert"), F.count_distinct("device_type").alias("device_types"), F.count_distinct("device_os").alias("os_types"),
        mean("quality_score", 1.0).alias("avg_quality_score"), n_if(F.coalesce("bot_probability", F.lit(0.0)) > 0.5).alias("bot_count"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"),
    )


#: Schema levels, the column that tells of each, and what is said if it has values or not; fixed values.
LEVELS = (
    ("V001 (base)", "referrer", "YES - Compatible", "YES - Native"),
    ("V002 (referrer/attribution)", "referrer", "YES - Native", "NO - Missing columns"),
    ("V003 (engagement)", "scroll_depth_pct", "YES - Native", "NO - Missing columns"),
    ("V004 (quality)", "quality_score", "YES - Native", "NO - Missing columns"),
)


def column_presence(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Which schema levels the events of the last day have values of."""
    said = [F.struct(F.lit(level).alias("schema_level"), F.when(F.count(c) > 0, yes).otherwise(no).alias("status")) for level, c, yes, no in LEVELS]
    return since(e, 1, as_of).agg(F.array(*said).alias("said")).select(F.inline("said"))


# --- assets ----------------------------------------------------------------------------------------------------------


def assets(e: DataFrame) -> DataFrame:
    """One row for each network, kind and content: the asset dimension with its counters. One scan: each event gives its assets."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("content")) for k, c in (("headline", "headline"), ("image", "image_id"))])
    a = e.select("*", F.inline(kinds)).filter("content is not null")
    return a.groupBy("network", "kind", "content").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), views().alias("total_views"), clicks().alias("total_clicks"), n_if(is_type("conversion")).alias("total_conversions"),
        F.count_distinct("session_id").alias("total_sessions"), F.count_distinct("campaign_id").alias("campaign_count"), F.round(F.avg("quality_score"), 6).alias("avg_quality_score"),
    ).withColumn("asset_id", F.concat_ws(":", "network", "kind", "content"))


def asset_summary(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    a = assets(e).filter(F.col("first_seen") >= ago(90, as_of))
    return a.groupBy("network", "kind").agg(
        F.count("*").alias("total_assets"), F.sum("total_views").alias("views"), F.sum("total_clicks").alias("clicks"), pct(F.sum("total_clicks"), F.sum("total_views")).alias("overall_ctr"),
        F.sum("total_conversions").alias("conversions"), pct(F.sum("total_conversions"), F.sum("total_sessions")).alias("overall_conversion_rate"), F.round(F.avg("avg_quality_score"), 4).alias("quality"),
        n_if(F.col("first_seen") >= ago(7, as_of)).alias("new_assets_7d"), n_if(F.col("last_seen") >= ago(7, as_of)).alias("active_assets_7d"),
    )


def asset_headlines(e: DataFrame, as_of: dt.date = AS_OF, least: int = 100) -> DataFrame:
    a = assets(e).filter((F.col("kind") == "headline") & (F.col("last_seen") >= ago(30, as_of)) & (F.col("total_views") >= least))
    return a.select("network", "asset_id", F.col("content").alias("headline"), "total_views", "total_clicks", pct("total_clicks", "total_views").alias("ctr"), "total_conversions", "campaign_count", "avg_quality_score", "first_seen", "last_seen")


def asset_fatigue(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Volatility of the daily CTR of each headline."""
    daily = since(e, 30, as_of).filter("headline is not null").groupBy("day", "headline", "network").agg(views().alias("v"), clicks().alias("c"))
    m = daily.withColumn("ctr", F.when(F.col("v") > 0, F.lit(100.0) * F.col("c") / F.col("v"))).groupBy("headline", "network").agg(F.avg("ctr").alias("mean"), F.stddev_samp("ctr").alias("dev"), F.count("*").alias("days_active"))
    a = assets(e).filter((F.col("kind") == "headline") & (F.col("last_seen") >= ago(7, as_of))).withColumnRenamed("content", "headline")
    status = F.when(F.col("dev") > 0.5 * F.col("mean"), "HIGH_VOLATILITY").when(F.col("avg_quality_score") < 0.5, "LOW_QUALITY").when(F.col("days_active") > 14, "POTENTIALLY_FATIGUED").otherwise("HEALTHY")
    return a.join(m, ["headline", "network"]).select(
        "headline", "network", "total_views", "total_clicks", pct("total_clicks", "total_views").alias("overall_ctr"), F.round("mean", 2).alias("avg_daily_ctr"), F.round("dev", 2).alias("ctr_volatility"), "days_active", status.alias("fatigue_status"),
    )


def cross_network_assets(e: DataFrame, least: int = 100) -> DataFrame:
    """Contents that several networks show, with each network's figures in an array of structs."""
    a = assets(e).filter(F.col("total_views") >= least)
    each = F.struct("network", F.col("total_views").alias("views"), F.col("total_clicks").alias("clicks"), pct("total_clicks", "total_views").alias("ctr"))
    g = a.groupBy(F.lower(F.trim("content")).alias("content_group"), "kind").agg(
        F.array_join(F.array_sort(F.collect_set("network")), ", ").alias("networks"), F.count_distinct("network").alias("network_count"), F.sum("total_views").alias("views"), F.sum("total_clicks").alias("clicks"),
        pct(F.sum("total_clicks"), F.sum("total_views")).alias("overall_ctr"), F.sum("total_conversions").alias("conversions"), F.array_sort(F.collect_list(each)).alias("network_performance"),
    )
    return g.filter("network_count >= 2")


def cross_network_flat(e: DataFrame, least: int = 100) -> DataFrame:
    """The same, with a row for each network's figures."""
    c = cross_network_assets(e, least)
    return c.select("content_group", "kind", "networks", "network_count", "views", "clicks", "overall_ctr", "conversions", F.explode("network_performance").alias("p")).select("*", F.col("p.network").alias("one_network"), F.col("p.ctr").alias("one_ctr")).drop("p")


def asset_trends(e: DataFrame, as_of: dt.date = AS_OF, least: int = 100) -> DataFrame:
    """CTR of each headline in the last week against the week before."""
    d = since(e, 30, as_of).filter("headline is not null")
    week, before = F.col("day") >= ago(7, as_of), (F.col("day") >= ago(14, as_of)) & (F.col("day") < ago(7, as_of))
    g = d.groupBy("headline", "network").agg(
        n_if(week & is_type("click")).alias("clicks_7d"), n_if(week & is_type("pageview")).alias("views_7d"), n_if(before & is_type("click")).alias("clicks_7d_prev"), n_if(before & is_type("pageview")).alias("views_7d_prev"),
        clicks().alias("clicks_total"), views().alias("views_total"),
    ).filter(F.col("views_7d") >= least)
    zero = F.lit(0)
    trend = F.lit(100.0) * (F.col("clicks_7d") / F.nullif("views_7d", zero)) / F.nullif(F.col("clicks_7d_prev") / F.nullif("views_7d_prev", zero), F.lit(0.0)) - 100
    return g.select("*", pct("clicks_7d", "views_7d").alias("ctr_7d"), pct("clicks_7d_prev", "views_7d_prev").alias("ctr_7d_prev"), F.when(F.col("views_7d_prev") > 0, F.round(trend, 2)).alias("ctr_trend_pct"), pct("clicks_total", "views_total").alias("ctr_overall"))


# --- normalised campaigns --------------------------------------------------------------------------------------------


def top_creatives(e: DataFrame, as_of: dt.date = AS_OF, least: int = 10) -> DataFrame:
    g = since(e, 7, as_of).filter("headline is not null").groupBy("network", "headline", "creative_id")
    g = g.agg(clicks().alias("clicks"), views().alias("views"), pct(clicks(), views()).alias("ctr_pct"), F.count_distinct("campaign_id").alias("campaigns_used"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return top(g.filter(F.col("clicks") >= least), 100, F.desc("clicks"), F.asc("network"), F.asc("headline"), F.asc("creative_id"))


def ctr_change(e: DataFrame, keys: tuple[str, ...] = ("network", "creative_id", "headline"), known: str = "creative_id", as_of: dt.date = AS_OF, least: int = 100, n: int = 50) -> DataFrame:
    """Mean daily CTR of the last week against the two weeks before, where `known` is not null.

    Daily rates have two digits; their means and the change are ratios of whole numbers, so that a value on a rounding border is rounded alike everywhere.
    """
    daily = since(e, 30, as_of).dropna(subset=[known]).groupBy("day", *keys).agg(F.round(pct(clicks(), views()) * 100).cast("long").alias("hundredths"), views().alias("v")).filter(F.col("v") >= least)
    recent, prior = F.col("day") >= ago(7, as_of), (F.col("day") < ago(7, as_of)) & (F.col("day") >= ago(21, as_of))
    of = lambda days_, s, c: (F.sum(F.when(days_, F.col("hundredths"))).alias(s), F.count(F.when(days_, F.col("hundredths"))).alias(c))
    g = daily.groupBy(*keys).agg(*of(recent, "r", "rn"), *of(prior, "p", "pn")).filter("p > 0")
    change = ratio(100 * (F.col("r") * F.col("pn") - F.col("p") * F.col("rn")), F.col("p") * F.col("rn"), 2)
    out = g.select(*keys, ratio(F.col("r"), 100 * F.col("rn"), 4).alias("recent_ctr"), ratio(F.col("p"), 100 * F.col("pn"), 4).alias("prior_ctr"), change.alias("fatigue_change_pct"))
    return top(out, n, F.asc_nulls_last("fatigue_change_pct"), *map(F.asc, keys))


def headline_fingerprints(e: DataFrame, as_of: dt.date = AS_OF, least: int = 20) -> DataFrame:
    """Headlines that are equal but for case and signs on several networks."""
    d = since(e, 14, as_of).filter("headline is not null")
    g = d.groupBy(F.regexp_replace(F.lower("headline"), r"[^a-z0-9\s]", "").alias("normalized_headline"))
    g = g.agg(F.count_distinct("network").alias("num_networks"), F.array_join(F.array_sort(F.collect_set("network")), ",").alias("networks"), clicks().alias("total_clicks"), views().alias("total_views"), pct(clicks(), views()).alias("overall_ctr"))
    return top(g.filter((F.col("num_networks") > 1) & (F.col("total_clicks") >= least)), 50, F.desc("total_clicks"), F.asc("normalized_headline"))


# --- documented queries ----------------------------------------------------------------------------------------------


def campaign_roi(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    g = since(e, 30, as_of).groupBy(F.col("campaign_id").alias("campaign"), F.col("utm_source").alias("source"), F.col("utm_medium").alias("medium"))
    g = g.agg(views().alias("views"), clicks().alias("clicks"), n_if(is_type("conversion")).alias("conversions"), F.coalesce(F.sum(F.when(is_type("conversion"), F.col("revenue"))), F.lit(0)).cast("double").alias("revenue"))
    g = g.withColumn("revenue_per_click", F.round(F.col("revenue") / F.nullif("clicks", F.lit(0)), 2))
    return top(g, 20, F.desc("revenue"), F.asc("campaign"), F.asc_nulls_last("source"), F.asc_nulls_last("medium"))


def session_counts(e: DataFrame, as_of: dt.date, window: int = 7) -> DataFrame:
    kinds = {"pageviews": "pageview", "clicks": "click", "scrolls": "scroll", "dwells": "dwell"}
    return since(e, window, as_of).filter("session_id is not null").groupBy("session_id").agg(
        *[n_if(is_type(t)).alias(n) for n, t in kinds.items()], (seconds(F.min("ts"), F.max("ts")) / 60).alias("minutes"), F.count("*").alias("events"), F.count_distinct("url").alias("urls")
    )


def session_histogram(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    keys = ["pageviews", "clicks", "scrolls", "dwells"]
    g = session_counts(e, as_of).groupBy(*keys).agg(F.round(F.avg("minutes"), 2).alias("avg_duration_minutes"), F.count("*").alias("num_sessions"))
    return top(g, 20, F.desc("num_sessions"), *map(F.asc, keys))


def session_journeys(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """The pages of the sessions with the most events; lists are made of those sessions only."""
    e = since(e, 7, as_of).filter("session_id is not null")
    longest = top(e.groupBy("session_id", "user_id").agg(F.count("*").alias("n")).filter("n >= 2"), 50, F.desc("n"), F.asc("session_id")).withColumnRenamed("user_id", "owner")
    e = e.alias("e").join(F.broadcast(longest.alias("s")), (F.col("e.session_id") == F.col("s.session_id")) & F.col("e.user_id").eqNullSafe(F.col("s.owner")), "left_semi")
    return e.groupBy("session_id", "user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "url"))), lambda x: x["url"]), " -> ").alias("journey"), F.count("*").alias("events"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end")
    ).orderBy(F.desc("events"), F.asc("session_id"))


def user_totals(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    g = since(e, 30, as_of).filter("user_id is not null").groupBy("user_id").agg(
        F.count_distinct("session_id").alias("num_sessions"), views().alias("total_pageviews"), clicks().alias("total_clicks"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), (days(F.min("ts"), F.max("ts")) + 1).alias("days_active")
    )
    return top(g, 50, F.desc("num_sessions"), F.asc("user_id"))


def session_sources(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    keys = [F.col("utm_source").alias("source"), F.col("campaign_id").alias("campaign"), F.col("utm_medium").alias("medium")]
    s = since(e, 7, as_of).filter("session_id is not null").groupBy("session_id", *keys).agg(F.min("day").alias("d"))
    g = s.groupBy("source", "campaign", "medium").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.when(F.col("d") >= ago(1, as_of), F.col("session_id"))).alias("sessions_last_day"))
    return top(g, 20, F.desc("sessions"), F.asc_nulls_last("source"), F.asc("campaign"), F.asc_nulls_last("medium"))


def engagement_levels(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    v, m = F.col("pageviews"), F.col("minutes")
    level = F.when((v >= 5) & (m >= 5), "high").when((v >= 3) | (m >= 2), "medium").when(v >= 2, "low").otherwise("bounce")
    mean = lambda c: F.round(F.avg(c), 2)
    g = session_counts(e, as_of).groupBy(level.alias("engagement_level")).agg(F.count("*").alias("num_sessions"), mean("pageviews").alias("avg_pageviews"), mean("clicks").alias("avg_clicks"), mean("minutes").alias("avg_duration_minutes"))
    return with_total(g, "num_sessions", "t", few=True).withColumn("pct_sessions", pct("num_sessions", "t")).drop("t")


def link_decoration(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    kind = bucket(F.col("urls"), [(2, "single_page"), (4, "multi_page_low")], "multi_page_high")
    return session_counts(e, as_of).groupBy(kind.alias("session_type")).agg(F.count("*").alias("num_sessions"), F.round(F.avg("events"), 2).alias("avg_events_per_session"))


def source_daily(e: DataFrame) -> DataFrame:
    """Daily totals of each source; sessions are counted once in each campaign."""
    d = e.groupBy(day(), F.col("utm_source").alias("source"), "campaign_id").agg(views().alias("v"), clicks().alias("c"), F.count_distinct("session_id").alias("s"))
    return d.groupBy("date", "source").agg(F.count_distinct("campaign_id").alias("active_campaigns"), F.sum("v").alias("total_views"), F.sum("c").alias("total_clicks"), pct(F.sum("c"), F.sum("v")).alias("overall_ctr"), F.sum("s").alias("total_sessions"))
