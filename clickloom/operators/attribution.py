"""Attribution of conversions to touches, and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.metrics import days, is_type, n_if, pct, top, with_total

TOUCH = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "network", "campaign_id", "creative_id")


def touches(e: DataFrame) -> DataFrame:
    """Events of sessions with the dimensions that get the credit."""
    e = e.filter("session_id is not null")
    return e.withColumns({"utm_campaign": F.col("campaign_id"), "utm_content": F.col("creative_id"), "utm_term": F.lit(None).cast("string"), "gain": F.when(is_type("conversion"), F.col("revenue"))})


def labelled(g: DataFrame, total: str, *columns) -> DataFrame:
    """The fifty best rows with labels for what is missing, and each one's share."""
    g = with_total(g, total, "t")
    labels = {"source": ("utm_source", "(direct)"), "medium": ("utm_medium", "(none)"), "campaign": ("utm_campaign", "(not set)"), "content": ("utm_content", "(not set)"), "term": ("utm_term", "(not set)"), "ad_network": ("network", "(unknown)")}
    out = g.select(*[F.coalesce(c, F.lit(d)).alias(n) for n, (c, d) in labels.items()], *columns, pct(total, "t").alias("attribution_pct"))
    return top(out, 50, F.desc("attributed_revenue"), *[F.asc(n) for n in labels])


def money(c: str):
    return F.round(F.col(c).cast("double"), 2).alias("attributed_revenue")


def first_touch(e: DataFrame) -> DataFrame:
    """Credit goes to the first event of the session."""
    s = touches(e).groupBy("session_id").agg(F.min_by(F.struct(*TOUCH), "ts").alias("f"), n_if(is_type("conversion")).alias("c"), F.coalesce(F.sum("gain"), F.lit(0)).alias("r"))
    g = s.select("session_id", "f.*", "c", "r").groupBy(*TOUCH).agg(F.sum("c").alias("conversions"), F.sum("r").alias("revenue"), F.count_distinct("session_id").alias("attributed_sessions"))
    return labelled(g.filter("conversions > 0 or revenue > 0"), "conversions", "attributed_sessions", "conversions", money("revenue"))


def last_touch(e: DataFrame) -> DataFrame:
    """Credit goes to the last event that is followed by a conversion, or is one with an event before it."""
    w = W.partitionBy("session_id").orderBy("ts")
    s = touches(e).withColumns({"after": F.lead("type").over(w), "before": F.lag("type").over(w)}).filter("after = 'conversion' or (type = 'conversion' and before is not null)")
    s = s.groupBy("session_id").agg(F.max_by(F.struct(*TOUCH, "revenue"), "ts").alias("f")).select("session_id", "f.*")
    g = s.groupBy(*TOUCH).agg(F.count("*").alias("conversions"), F.coalesce(F.sum("revenue"), F.lit(0)).alias("r"), F.count_distinct("session_id").alias("attributed_sessions"))
    return labelled(g, "conversions", "attributed_sessions", "conversions", money("r"))


def linear(e: DataFrame, normalized: bool = False) -> DataFrame:
    """Credit is dealt evenly over the session's touches: over its events, or (normalized) over its distinct touches."""
    t = touches(e)
    won = t.groupBy("session_id").agg(n_if(is_type("conversion")).alias("c"), F.coalesce(F.sum("gain"), F.lit(0)).cast("double").alias("r"), F.count("*").alias("n")).filter("c > 0")
    d = t.join(won, "session_id").select("session_id", *TOUCH, "c", "r", "n").distinct()
    if normalized:
        d = d.withColumn("n", F.count("*").over(W.partitionBy("session_id")))
    g = d.groupBy(*TOUCH).agg(F.sum(F.col("c") / F.col("n")).alias("a"), F.sum(F.col("r") / F.col("n")).alias("m"), F.count_distinct("session_id").alias("touched_sessions"))
    return labelled(g, "a", "touched_sessions", F.round("a", 6).alias("attributed_conversions"), F.round("m", 6).alias("attributed_revenue"))


def multi_touch(e: DataFrame, goals: tuple[str, ...] = ("conversion", "purchase", "signup"), n: int | None = None) -> DataFrame:
    """Every session of a user that began before a goal, in order, with the days up to it; all of them, or the n first by user."""
    first = F.min_by(F.struct("network", "campaign_id", "creative_id", "url", F.col("type").alias("event_type")), "ts")
    t = e.filter("user_id is not null").groupBy("user_id", "session_id").agg(first.alias("f"), F.min("ts").alias("session_ts")).select("user_id", "session_id", "f.*", "session_ts")
    c = e.filter(F.col("type").isin(*goals)).groupBy("user_id", "session_id", F.col("type").alias("conversion_type")).agg(F.min("ts").alias("conversion_ts")).drop("session_id")
    j = t.join(c, "user_id").filter("session_ts <= conversion_ts")
    user = W.partitionBy("user_id")
    j = j.withColumns({
        "touch_position": F.row_number().over(user.orderBy("session_ts", "conversion_ts", "conversion_type")).cast("long"), "total_touches": F.count("*").over(user),
        "days_to_conversion": days(F.col("session_ts"), F.col("conversion_ts")),
    })
    j = j.withColumns({"attribution_model_first": F.when(F.col("touch_position") == 1, "first_touch"), "attribution_model_last": F.when(F.col("touch_position") == F.col("total_touches"), "last_touch")})
    return j if n is None else top(j, n, F.asc("user_id"), F.asc("touch_position"))


def cohorts(e: DataFrame, by: str = "network") -> DataFrame:
    """Activity of users by what brought them (`network` or `campaign`) or when they came (`day`), and days since then."""
    what = {"network": F.min_by("network", "ts"), "campaign": F.min_by("campaign_id", "ts"), "day": F.to_date(F.min("ts")).cast("string")}[by]
    u = e.filter("user_id is not null").groupBy("user_id").agg(what.alias("cohort"), F.min("ts").alias("came"))
    s = e.groupBy("user_id", "session_id").agg(F.min("ts").alias("start"), F.count("*").alias("n"), F.count_distinct("url").alias("p")).join(u, "user_id")
    g = s.groupBy("cohort", days(F.col("came"), F.col("start")).alias("day_number"))
    return g.agg(F.count_distinct("user_id").alias("active_users"), F.count("*").alias("sessions"), F.round(F.avg("n"), 4).alias("avg_events_per_session"), F.round(F.avg("p"), 4).alias("avg_pages_per_session"))
