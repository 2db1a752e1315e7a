"""Creative fatigue and traffic alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.metrics import days, is_type, n_if, top
from ..sources.events import AS_OF, at, since

CREATIVE = ("creative_key", "creative_id", "headline", "image_id", "network")


def daily_creatives(e: DataFrame, as_of: dt.date = AS_OF, window: int = 60, least: int = 10) -> DataFrame:
    """Views and clicks of each creative and day with enough views. A creative without an id is known by network, headline and image."""
    e = since(e, window, as_of).filter("creative_id is not null or headline is not null")
    blank = lambda c: F.coalesce(c, F.lit(""))
    network = F.coalesce("network", F.lit("unknown"))
    keys = {
        "creative_key": F.coalesce("creative_id", F.concat_ws("|", network, blank("headline"), blank("image_id"))),
        "id": F.coalesce("creative_id", F.concat(F.lit("composite-"), F.md5(F.concat(network, blank("headline"), blank("image_id"))))),
        "title": F.coalesce("headline", F.lit("(unnamed)")), "image": blank("image_id"), "net": network,
    }
    d = e.groupBy("day", *[c.alias(n) for n, c in keys.items()]).agg(n_if(is_type("pageview")).alias("views"), n_if(is_type("click")).alias("clicks")).filter(F.col("views") >= least)
    return d.select("day", "creative_key", F.col("id").alias("creative_id"), F.col("title").alias("headline"), F.col("image").alias("image_id"), F.col("net").alias("network"), "views", "clicks")


def rolling_ctr(daily: DataFrame, as_of: dt.date = AS_OF, length: int = 7, least: int = 50) -> DataFrame:
    """CTR over the last `length` days of each calendar day with `least` (1 or more) views in them, whether or not the day itself has any. One pass: each day counts towards the days that look back on it."""
    last = F.lit(as_of - dt.timedelta(days=1))
    day = F.explode(F.sequence("day", F.least(F.date_add("day", length - 1), last), F.expr("interval 1 day")))
    r = daily.filter(F.col("day") <= last).select(*CREATIVE, day.alias("day"), "views", "clicks").groupBy(*CREATIVE, "day").agg(F.sum("views").alias("v"), F.sum("clicks").alias("c"))
    return r.filter(F.col("v") >= max(1, least)).select(*CREATIVE, "day", (F.lit(100.0) * F.col("c") / F.col("v")).alias("ctr"))


def creative_fatigue(e: DataFrame, as_of: dt.date = AS_OF, least_daily: int = 10, least_rolling: int = 50, n: int | None = 50) -> DataFrame:
    """Creatives whose rolling CTR falls, scored from the decline over three days, the distance to the peak and its age; the n first, or all in no order."""
    r = rolling_ctr(daily_creatives(e, as_of, least=least_daily), as_of, least=least_rolling)
    # one pass per creative: peak (earliest day that reaches it), yesterday's value and the value three days before
    yesterday, before = as_of - dt.timedelta(days=1), as_of - dt.timedelta(days=4)
    g = r.groupBy(*CREATIVE).agg(
        F.max("ctr").alias("peak"), F.min_by("day", F.struct(-F.col("ctr"), "day")).alias("peak_day"),
        F.max(F.when(F.col("day") == F.lit(yesterday), F.col("ctr"))).alias("now"), F.max(F.when(F.col("day") == F.lit(before), F.col("ctr"))).alias("prior"),
    ).filter("now is not null and prior is not null")
    g = g.withColumn("age", F.datediff(F.lit(as_of), F.col("peak_day")).cast("long"))
    drop = F.when(F.col("prior") > 0, (F.col("prior") - F.col("now")) / F.col("prior"))
    score = F.least(F.lit(1.0), F.least(F.lit(0.5), 1.25 * drop) + F.least(F.lit(0.3), 0.6 * (F.col("peak") - F.col("now")) / F.nullif(F.col("peak"), F.lit(0.0))) + F.least(F.lit(0.2), F.col("age") / F.lit(150.0)))
    g = g.withColumns({"decline": F.coalesce(100 * drop, F.lit(0.0)), "score": F.coalesce(F.when((F.col("prior") > 0) & (F.col("peak") > 0), score), F.lit(0.0))})
    levels = ((F.col("decline") > 20, 0, "URGENT: Rotate immediately"), (F.col("score") > 0.5, 7, "HIGH: Prepare replacement within 7 days"), (F.col("score") > 0.3, 14, "MEDIUM: Plan rotation within 14 days"), (F.col("score") > 0.15, 30, "LOW: Monitor closely"))
    rotation = F.coalesce(*[F.when(c, F.lit(as_of + dt.timedelta(days=d))) for c, d, _ in levels])
    action = F.coalesce(*[F.when(c, F.lit(a)) for c, _, a in levels], F.lit("NORMAL: No action needed"))
    two = lambda c: F.round(c, 2)
    out = g.select(
        "creative_id", "headline", "image_id", "network", two("now").alias("current_ctr_7d_pct"), two("prior").alias("prior_ctr_7d_pct"), two("peak").alias("peak_ctr_pct"), F.round("decline", 1).alias("decline_from_3d_ago_pct"),
        F.col("age").alias("days_since_peak"), two("score").alias("fatigue_score"), F.when(F.col("decline") > 20, "YES").otherwise("NO").alias("is_fatigued"), rotation.alias("recommended_rotation_date"), action.alias("action_recommendation"),
    )
    if n is None:
        return out
    return top(out, n, F.desc("fatigue_score"), F.desc("decline_from_3d_ago_pct"), *[F.asc(c) for c in ("creative_id", "headline", "image_id", "network")])


def fatigue_summary(fatigue: DataFrame) -> DataFrame:
    """How many creatives there are of each severity."""
    like = lambda word: n_if(F.col("action_recommendation").startswith(word))
    return fatigue.agg(
        F.count("*").alias("creatives"), n_if(F.col("is_fatigued") == "YES").alias("fatigued"), like("HIGH").alias("high"), like("MEDIUM").alias("medium"), like("LOW").alias("low"),
        F.round(F.avg("fatigue_score"), 2).alias("avg_fatigue_score"), F.round(F.avg("decline_from_3d_ago_pct"), 2).alias("avg_decline_pct"),
    )


def traffic_spikes(e: DataFrame, as_of: dt.date = AS_OF, n: int = 10) -> DataFrame:
    """Hours with more events than two deviations above the mean of the same hour on the seven days before."""
    h = since(e, 14, as_of).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("events"))
    w = W.partitionBy(F.hour("hour")).orderBy("hour").rowsBetween(-7, -1)
    h = h.withColumns({"m": F.avg("events").over(w), "s": F.stddev_samp("events").over(w)}).filter("m is not null and events > m + 2 * s")
    h = h.select("hour", "events", F.round("m", 2).alias("baseline_avg"), F.round("s", 2).alias("baseline_stddev"), F.round(100 * (F.col("events") - F.col("m")) / F.nullif(F.col("m"), F.lit(0.0)), 2).alias("deviation_pct"))
    return top(h, n, F.desc("hour"))


def silent_campaigns(e: DataFrame, as_of: dt.date = AS_OF, hours: int = 24) -> DataFrame:
    """Campaigns with events in the last week but none in the last hours."""
    now = dt.datetime.combine(as_of, dt.time())
    g = since(e, 7, as_of).groupBy(F.col("campaign_id").alias("campaign")).agg(F.max("ts").alias("last_event"), F.count("*").alias("total_events"))
    return g.filter(F.col("last_event") < at(e, now - dt.timedelta(hours=hours))).withColumn("days_since_last_event", days(F.col("last_event"), at(e, now)))
