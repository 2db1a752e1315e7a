"""Gap sessions, journeys, paths and flows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.metrics import bucket, is_type, n_if, pct, rank_in, seconds, top, with_total
from ..sources.events import AS_OF, at, between, since


def gap_sessions(e: DataFrame, key: str = "user_id", timeout_minutes: float = 30.0) -> DataFrame:
    """Add `seq` (from 1): a new session starts at an event more than the timeout after the one before."""
    w = W.partitionBy(key).orderBy("ts")
    gap = seconds(F.lag("ts").over(w), F.col("ts"))
    e = e.filter(F.col(key).isNotNull()).withColumn("starts", F.when(gap.isNull() | (gap > timeout_minutes * 60), 1).otherwise(0))
    return e.withColumn("seq", F.sum("starts").over(w.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("starts")


def summed(e: DataFrame, *keys: str) -> DataFrame:
    """One row a session: bounds, counts, and what its first event says."""
    first = lambda c: F.min_by(c, "ts")
    return e.groupBy(*keys).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("event_count"), F.count_distinct("url").alias("unique_pages"),
        F.bround(seconds(F.min("ts"), F.max("ts"))).cast("long").alias("duration_seconds"), first("url").alias("landing_page"), first("network").alias("source_network"),
        first("campaign_id").alias("campaign"), first("device_type").alias("device_type"), F.array_sort(F.collect_set("type")).alias("event_types"),
    )


def reconstruct(e: DataFrame, timeout_minutes: float = 30.0, most_hours: float = 4.0, n: int = 1000) -> DataFrame:
    """The newest gap sessions within each session_id, without overlong ones."""
    s = summed(gap_sessions(e, "session_id", timeout_minutes), "session_id", "seq", "user_id").filter(F.col("duration_seconds") <= most_hours * 3600)
    s = s.withColumn("session_id", F.concat("session_id", F.lit("_"), F.col("seq").cast("string"))).withColumn("is_bounce", F.col("event_count") == 1)
    return top(s.drop("seq", "event_types"), n, F.desc("session_start"), F.asc("session_id"))


def journeys(e: DataFrame, user_id: str | None = None, timeout_minutes: float = 30.0, n: int | None = None) -> DataFrame:
    """Gap sessions of each user (or of one) with the event types they hold; all of them, or the n first by user and time."""
    if user_id is not None:
        e = e.filter(F.col("user_id") == F.lit(user_id))
    s = summed(gap_sessions(e, "user_id", timeout_minutes), "user_id", "seq").withColumnRenamed("seq", "session_seq").drop("device_type")
    return s if n is None else top(s, n, F.asc("user_id"), F.asc("session_start"))


def flow(e: DataFrame) -> DataFrame:
    """Steps from one event type to the next within sessions."""
    w = W.partitionBy("session_id").orderBy("ts")
    s = e.filter("session_id is not null").select("session_id", "type", F.lag("type").over(w).alias("prev_type")).filter("prev_type is not null")
    g = s.groupBy("prev_type", "type").agg(F.count("*").alias("flow_count"), F.count_distinct("session_id").alias("unique_sessions"))
    return top(g, 20, F.desc("flow_count"), F.asc("prev_type"), F.asc("type"))


def flow_matrix(e: DataFrame) -> DataFrame:
    """Steps from page to page among page views."""
    w = W.partitionBy("session_id").orderBy("ts")
    s = e.filter("session_id is not null and type = 'pageview'").select("session_id", F.col("url").alias("from_page"), F.lead("url").over(w).alias("to_page"))
    g = s.filter("to_page is not null").groupBy("from_page", "to_page").agg(F.count("*").alias("transition_count"), F.count_distinct("session_id").alias("unique_sessions"))
    return top(g, 100, F.desc("transition_count"), F.asc("from_page"), F.asc("to_page"))


def landing_pages(e: DataFrame, by: str = "url") -> DataFrame:
    """Sessions and bounce rate of landing pages; by `url` (the least url) or `time` (the first)."""
    landing = F.min("url") if by == "url" else F.min_by("url", "ts")
    s = e.filter("session_id is not null").groupBy("session_id").agg(landing.alias("landing_url"), n_if(is_type("pageview")).alias("views"))
    one = n_if(F.col("views") == 1)
    g = s.groupBy("landing_url").agg(F.count("*").alias("sessions"), one.alias("bounced"), pct(one, F.count("*")).alias("bounce_rate_pct"))
    return top(g, 20, F.desc("sessions"), F.asc("landing_url"))


def in_order(c: str):
    """The values of a column in the order of time; nulls stay."""
    return F.transform(F.array_sort(F.collect_list(F.struct("ts", c))), lambda x: x[c])


def common_paths(e: DataFrame, most_steps: int = 10, n: int = 50) -> DataFrame:
    """How often each sequence of viewed pages occurs."""
    place = F.row_number().over(W.partitionBy("session_id").orderBy("ts", "url"))
    s = e.filter("session_id is not null and type = 'pageview'").select("session_id", "ts", "url", place.alias("place")).filter(F.col("place") <= most_steps + 1)  # one more tells that there are too many
    s = s.groupBy("session_id").agg(in_order("url").alias("path"), F.count("*").alias("steps")).filter(F.col("steps") <= most_steps)
    g = with_total(s.groupBy("path", "steps").agg(F.count("*").alias("frequency")), "frequency", "t")
    return top(g, n, F.desc("frequency"), F.asc("path")).select("path", "steps", "frequency", pct("frequency", "t").alias("percentage"))


def drop_off(e: DataFrame, n: int = 50) -> DataFrame:
    """The last event of sessions, its page and the page before. Only the last two events are kept of each session."""
    w = W.partitionBy("session_id", "user_id").orderBy(F.desc("ts"))
    s = e.filter("session_id is not null").withColumn("r", F.row_number().over(w)).groupBy("session_id", "user_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("type"))).alias("last_event_type"), F.max(F.when(F.col("r") == 1, F.col("url"))).alias("last_url"),
        F.max(F.when(F.col("r") == 2, F.col("url"))).alias("second_to_last_url"), F.count("*").alias("events"),
    )
    g = s.groupBy("last_event_type", "last_url", "second_to_last_url")
    g = g.agg(F.count("*").alias("sessions"), F.count_distinct("user_id").alias("unique_users"), F.round(F.avg("events"), 4).alias("avg_events_before_dropoff"))
    return top(g, n, F.desc("sessions"), F.asc("last_event_type"), F.asc("last_url"), F.asc_nulls_last("second_to_last_url"))


SEGMENTS = [(2, "new"), (3, "returning_2"), (6, "returning_3_5"), (11, "returning_6_10")]


def returning_users(e: DataFrame) -> DataFrame:
    """Users by how many sessions they have."""
    u = e.filter("user_id is not null").groupBy("user_id").agg(
        F.count_distinct("session_id").alias("s"), F.count("*").alias("n"), F.count_distinct("url").alias("p"), F.count_distinct("day").alias("d")
    )
    g = u.groupBy(bucket(F.col("s"), SEGMENTS, "returning_11_plus").alias("user_segment"))
    mean = lambda c: F.round(F.avg(c), 4)
    return g.agg(
        F.count("*").alias("user_count"), F.sum("s").alias("total_sessions"), F.sum("n").alias("total_events"),
        mean("s").alias("avg_sessions_per_user"), mean("d").alias("avg_active_days"), mean("p").alias("avg_unique_pages"),
    ).orderBy(rank_in("user_segment", [label for _, label in SEGMENTS]))


def session_table(e: DataFrame) -> DataFrame:
    """One row for each session_id, as the sessions table holds it."""
    first, last = (lambda c: F.min_by(c, "ts")), (lambda c: F.max_by(c, "ts"))
    s = e.filter("session_id is not null").groupBy("session_id", "user_id").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("event_count"), n_if(is_type("pageview")).alias("pageviews"), n_if(is_type("click")).alias("clicks"),
        n_if(is_type("scroll")).alias("scrolls"), n_if(is_type("dwell")).alias("dwells"), n_if(is_type("conversion")).alias("conversions"), F.count_distinct("url").alias("unique_pages"), first("url").alias("landing_page"), last("url").alias("exit_page"),
        first("network").alias("network"), first("campaign_id").alias("campaign_id"), first("creative_id").alias("creative_id"), first("device_type").alias("device_type"),
        F.coalesce(F.sum("dwell_time_ms"), F.lit(0)).alias("dwell_ms"), F.max("scroll_depth_pct").alias("max_scroll_pct"),
    )
    return s.withColumns({
        "duration_seconds": F.bround(seconds(F.col("session_start"), F.col("session_end"))).cast("long"), "is_bounce": F.col("event_count") == 1, "converted": F.col("conversions") > 0,
    })


DURATIONS = [(10, "0-10s"), (30, "10-30s"), (60, "30-60s"), (180, "1-3m"), (300, "3-5m")]


def recent_sessions(e: DataFrame, days: int, as_of: dt.date, longest: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
    """The sessions that began in the last days before a day (or on it), whole. Events older than that by the longest session are not read."""
    start = dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days)
    return session_table(between(e, start - longest)).filter(F.col("session_start") >= at(e, start))


def session_rows(e: DataFrame, as_of: dt.date = AS_OF, days: int = 7) -> DataFrame:
    """The sessions table of the last days' events."""
    return session_table(since(e, days, as_of))


def session_daily(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Totals, conversions, bounces and depth of each day and network."""
    s = recent_sessions(e, 90, as_of).groupBy(F.to_date("session_start").alias("date"), "network")
    won, bounced = n_if(F.col("converted")), n_if(F.col("is_bounce"))
    return s.agg(
        F.count("*").alias("sessions"), F.sum("pageviews").alias("total_pageviews"), F.sum("clicks").alias("total_clicks"), F.sum("scrolls").alias("total_scroll_events"), F.sum("dwells").alias("total_dwell_events"),
        won.alias("converted_sessions"), pct(won, F.count("*")).alias("conversion_rate_pct"), F.round(F.avg("duration_seconds"), 4).alias("avg_duration_seconds"),
        bounced.alias("bounces"), pct(bounced, F.count("*")).alias("bounce_rate_pct"), F.round(F.avg("unique_pages"), 4).alias("avg_depth"),
    )


def session_funnel(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Sessions of each day, network and campaign with a page view, a click, three pages, a conversion."""
    g = recent_sessions(e, 30, as_of).groupBy(F.to_date("session_start").alias("date"), "network", "campaign_id").agg(
        n_if(F.col("pageviews") >= 1).alias("landing_sessions"), n_if(F.col("clicks") >= 1).alias("engaged_sessions"),
        n_if(F.col("unique_pages") >= 3).alias("browsing_sessions"), n_if(F.col("converted")).alias("converted_sessions"),
    )
    return g.withColumns({
        "landing_to_engagement_pct": pct("engaged_sessions", "landing_sessions"), "engagement_to_browsing_pct": pct("browsing_sessions", "engaged_sessions"),
        "browsing_to_conversion_pct": pct("converted_sessions", "browsing_sessions"),
    })


def session_quality(e: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Conversions, bounces and depth of sessions by network, campaign and duration."""
    g = recent_sessions(e, 30, as_of).groupBy("network", "campaign_id", bucket(F.col("duration_seconds"), DURATIONS, "5m+").alias("duration_bucket"))
    won, bounced = n_if(F.col("converted")), n_if(F.col("is_bounce"))
    return g.agg(
        F.count("*").alias("sessions"), won.alias("conversions"), pct(won, F.count("*")).alias("conversion_rate_pct"), F.round(F.avg("unique_pages"), 4).alias("avg_depth"),
        bounced.alias("bounces"), pct(bounced, F.count("*")).alias("bounce_rate_pct"),
    )


def live_sessions(stream: DataFrame, timeout: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """The same gap sessions for a stream (or a table) of events with a timestamp `ts`: session windows behind a watermark."""
    e = stream.filter("user_id is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy("user_id", F.session_window("ts", timeout).alias("w")).agg(F.count("*").alias("event_count"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count")
