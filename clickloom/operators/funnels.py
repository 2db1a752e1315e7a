"""Funnels and drop-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.metrics import is_type, n_if, pct, rank_in, seconds, top

DEEP = 3  # distinct pages that count as a conversion by depth
STEPS = ((1, "Pricing View", ("/pricing",), ()), (2, "Signup", ("/signup",), ("signup",)), (3, "Checkout", ("/checkout",), ("purchase",)), (4, "Conversion", ("/thank-you",), ("conversion",)))


def session_stages(e: DataFrame) -> DataFrame:
    """One row a session: least dimensions, counts, and whether it converted (an event, or by depth)."""
    s = e.filter("session_id is not null").groupBy("session_id").agg(
        *[F.min(c).alias(c) for c in ("network", "campaign_id", "creative_id", "headline")], F.min("ts").alias("start"), F.max("ts").alias("end"),
        *[n_if(is_type(t)).alias(n) for n, t in (("views", "pageview"), ("clicks", "click"), ("scrolls", "scroll"), ("dwells", "dwell"), ("goals", "conversion"))], F.count_distinct("url").alias("pages"),
    )
    return s.withColumn("converted", (F.col("goals") > 0) | (F.col("pages") >= DEEP))


def full_funnel(e: DataFrame, least: int = 10) -> DataFrame:
    """Landed, clicked, scrolled, engaged and converted sessions of each campaign."""
    g = session_stages(e).filter("campaign_id is not null").groupBy("campaign_id", "network").agg(
        F.count("*").alias("landing_sessions"), n_if(F.col("clicks") > 0).alias("click_sessions"), n_if(F.col("scrolls") > 0).alias("scroll_sessions"),
        n_if((F.col("pages") >= 2) | (F.col("dwells") > 0)).alias("engaged_sessions"), n_if(F.col("converted")).alias("converted_sessions"),
    ).filter(F.col("landing_sessions") >= least)
    g = g.select(
        "*", pct("click_sessions", "landing_sessions").alias("landing_to_click_pct"), pct("scroll_sessions", "click_sessions").alias("click_to_scroll_pct"), pct("engaged_sessions", "scroll_sessions").alias("scroll_to_engage_pct"),
        pct("converted_sessions", "engaged_sessions").alias("engage_to_convert_pct"), pct("converted_sessions", "landing_sessions").alias("overall_conversion_pct"),
    )
    return top(g, 50, F.desc("converted_sessions"), F.asc("campaign_id"), F.asc("network"))


def creative_funnel(e: DataFrame, least: int = 10) -> DataFrame:
    """Sessions with a creative, each counted once for each creative that it shows, with what they did while it was shown."""
    keys = ["creative_id", "headline", "network"]
    s = e.filter("session_id is not null and creative_id is not null").groupBy("session_id", *keys).agg(
        seconds(F.min("ts"), F.max("ts")).alias("sec"), n_if(is_type("click")).alias("clicks"), n_if(is_type("scroll")).alias("scrolls"), n_if(is_type("conversion")).alias("goals"), F.count_distinct("url").alias("pages"),
    )
    won, clicked = n_if((F.col("goals") > 0) | (F.col("pages") >= DEEP)), n_if(F.col("clicks") > 0)
    g = s.groupBy(*keys).agg(
        F.count("*").alias("sessions"), clicked.alias("clicked"), n_if(F.col("scrolls") > 0).alias("scrolled"), n_if(F.col("pages") >= 2).alias("multi_page"), won.alias("conversions"),
        pct(won, F.count("*")).alias("conversion_rate_pct"), pct(clicked, F.count("*")).alias("click_rate_pct"), F.round(F.avg("sec"), 1).alias("avg_duration_seconds"),
    ).filter(F.col("sessions") >= least)
    return top(g, 50, F.desc("conversion_rate_pct"), F.desc("sessions"), *map(F.asc, keys))


DROP_STAGES = ["no_engagement", "view_only", "clicked_no_scroll", "single_page", "multi_page_no_convert", "converted"]


def drop_stages(e: DataFrame, least: int = 5) -> DataFrame:
    """At which of seven stages sessions of a campaign end."""
    s = e.filter("session_id is not null and campaign_id is not null").groupBy("session_id", "network", "campaign_id").agg(
        F.min_by("type", F.struct("ts", "type")).alias("first"), *[(n_if(is_type(t)) > 0).alias(t) for t in ("click", "scroll")],
        F.count("*").alias("n"), F.count_distinct("url").alias("pages"), (n_if(is_type("conversion")) > 0).alias("converted"),
    )
    click, scroll = F.col("click"), F.col("scroll")
    stage = (
        F.when(F.col("n") == 1, "no_engagement")
        .when((F.col("first") == "pageview") & ~click & ~scroll, "view_only")
        .when(click & ~scroll, "clicked_no_scroll")
        .when(scroll & (F.col("pages") < 2), "single_page")
        .when((F.col("pages") >= 2) & ~F.col("converted"), "multi_page_no_convert")
        .when(F.col("converted"), "converted")
        .otherwise("other")
    )
    g = s.groupBy("campaign_id", "network", "converted", stage.alias("drop_stage")).agg(F.count("*").alias("sessions"), F.round(F.avg("n"), 1).alias("avg_events"), F.round(F.avg("pages"), 1).alias("avg_pages"))
    g = g.filter(F.col("sessions") >= least).withColumn("t", F.sum("sessions").over(W.partitionBy("campaign_id", "network")))
    g = g.select("campaign_id", "network", "drop_stage", "sessions", pct("sessions", "t", 1).alias("stage_pct"), "avg_events", "avg_pages")
    return g.orderBy("campaign_id", "network", rank_in("drop_stage", DROP_STAGES))


def time_to_convert(e: DataFrame, least: int = 3) -> DataFrame:
    """How long converted sessions last."""
    s = e.filter("session_id is not null and campaign_id is not null").groupBy("session_id", "network", "campaign_id").agg(
        seconds(F.min("ts"), F.max("ts")).alias("sec"), n_if(is_type("pageview")).alias("views"), F.count_distinct("url").alias("pages"), n_if(is_type("conversion")).alias("goals")
    ).filter((F.col("goals") > 0) | (F.col("pages") >= DEEP))
    sec = F.col("sec")
    g = s.groupBy("campaign_id", "network").agg(
        F.count("*").alias("conversions"), F.round(F.avg(sec), 1).alias("avg_session_seconds"), F.round(F.percentile(sec, F.lit(0.5)), 1).alias("median_session_seconds"), F.round(F.avg("views"), 1).alias("avg_pageviews"),
        F.round(F.avg("pages"), 1).alias("avg_unique_pages"), n_if(sec < 30).alias("under_30s"), n_if(sec.between(30, 120)).alias("between_30s_2m"), n_if(sec > 120).alias("over_2m"),
    ).filter(F.col("conversions") >= least)
    return top(g, 50, F.desc("conversions"), F.asc("campaign_id"), F.asc("network"))


def daily_funnel(e: DataFrame) -> DataFrame:
    """Sessions of each day and network, and how many of them clicked, scrolled or converted at any time of the range.

    The flags come from one pass over the sessions, joined back by session_id.
    """
    flags = session_stages(e).select("session_id", (F.col("clicks") > 0).alias("c"), (F.col("scrolls") > 0).alias("s"), F.col("converted").alias("v"))
    d = e.filter("session_id is not null").select("session_id", F.col("day").alias("date"), "network").distinct().join(flags, "session_id")
    return d.groupBy("date", "network").agg(
        F.count("*").alias("total_sessions"), n_if(F.col("c")).alias("sessions_with_click"), n_if(F.col("s")).alias("sessions_with_scroll"), n_if(F.col("v")).alias("conversions"), pct(n_if(F.col("v")), F.count("*")).alias("daily_conversion_rate"),
    )


def step_of(steps=STEPS) -> Column:
    """The number of the first step whose page or event type fits; else null."""
    tests = []
    for number, _, pages, types in steps:
        fits = F.lit(False)
        for p in pages:
            fits = fits | F.col("url").contains(p)
        tests.append(F.when(fits | F.col("type").isin(*types) if types else fits, number))
    return F.coalesce(*tests)


def step_funnel(e: DataFrame, steps=STEPS) -> DataFrame:
    """Users that reach each step, against the step before."""
    g = e.filter("user_id is not null").withColumn("step_number", step_of(steps)).filter("step_number is not null").groupBy("step_number").agg(F.count_distinct("user_id").alias("users_reached_step"))
    g = g.withColumn("prev_step_users", F.lag("users_reached_step").over(W.orderBy("step_number")))  # a row for each step only
    name = F.element_at(F.create_map(*[F.lit(x) for n, label, _, _ in steps for x in (n, label)]), F.col("step_number"))
    rate = F.when(F.col("prev_step_users") > 0, pct("users_reached_step", "prev_step_users")).otherwise(100.0)
    return g.select("step_number", name.alias("step_name"), "users_reached_step", "prev_step_users", rate.alias("conversion_rate_pct"))
