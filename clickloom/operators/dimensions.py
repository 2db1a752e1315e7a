"""Keyed registries, network hierarchies, spend metrics and user trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .sessions import summed

CREATIVE_KEY, METRIC_KEY = ("network", "campaign_id", "creative_id"), ("network", "date", "campaign_id", "creative_id")


def registry_key(*columns: str):
    """Key text; a missing part of it (metrics of a whole campaign) is `aggregate`."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("aggregate")) for c in columns])


def upserted(known: DataFrame, new: DataFrame, keys: tuple[str, ...] = CREATIVE_KEY, at: str = "synced_at") -> DataFrame:
    """The latest row of each key of both tables; at equal times the new one. One aggregation, no join."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_new"]
    latest = both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*columns), F.struct(F.col(at), F.col("_new"))).alias("r"))
    return latest.select("r.*")


def selected(registry: DataFrame, network: str | None = None, campaign_id: str | None = None, start=None, end=None) -> DataFrame:
    """Registry rows of a network, a campaign, and an inclusive range of dates."""
    for column, value in (("network", network), ("campaign_id", campaign_id)):
        if value is not None:
            registry = registry.filter(F.col(column) == value)
    if start is not None:
        registry = registry.filter(F.col("date") >= F.lit(start))
    return registry if end is None else registry.filter(F.col("date") <= F.lit(end))


def with_rates(metrics: DataFrame) -> DataFrame:
    """Click rate in basis points, cost per click and per thousand in micros: whole numbers, cut off; null without a divisor."""
    rate = lambda a, factor, b: F.when(F.col(b) > 0, F.expr(f"({a} * {factor}) div {b}"))
    return metrics.withColumns({"ctr_bps": rate("clicks", 10_000, "impressions"), "cpc_micros": rate("spend_micros", 1, "clicks"), "cpm_micros": rate("spend_micros", 1000, "impressions")})


def spend(metrics: DataFrame) -> DataFrame:
    """Spend, clicks and impressions of each network and date."""
    return with_rates(metrics.groupBy("network", "date").agg(*[F.sum(c).alias(c) for c in ("impressions", "clicks", "spend_micros")]))


def hierarchy_campaigns(h: DataFrame) -> DataFrame:
    return h.select("network", "account_id", F.explode_outer("campaigns").alias("c")).select("network", "account_id", "c.campaign_id", "c.campaign_name", "c.status", "c.ad_groups", "c.creatives").filter("campaign_id is not null")


def hierarchy_ad_groups(h: DataFrame) -> DataFrame:
    g = hierarchy_campaigns(h).select("network", "account_id", "campaign_id", F.explode("ad_groups").alias("g"))
    return g.select("network", "account_id", "campaign_id", "g.ad_group_id", "g.ad_group_name", "g.status", "g.creatives")


def hierarchy_creatives(h: DataFrame) -> DataFrame:
    """All creatives, those of campaigns and those of their ad groups."""
    direct = hierarchy_campaigns(h).select("network", "account_id", "campaign_id", F.lit(None).cast("string").alias("ad_group_id"), F.explode("creatives").alias("x"))
    grouped = hierarchy_ad_groups(h).select("network", "account_id", "campaign_id", "ad_group_id", F.explode("creatives").alias("x"))
    return direct.unionByName(grouped).select("network", "account_id", "campaign_id", "ad_group_id", "x.*")


def minute_sessions(e: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions of each user (`seq` from 0) that a gap of more whole minutes than the limit ends."""
    w = W.partitionBy("user_id").orderBy("ts")
    starts = F.when(F.timestamp_diff("MINUTE", F.lag("ts").over(w), F.col("ts")) > minutes, 1).otherwise(0)
    return e.filter("user_id is not null").withColumn("_s", starts).withColumn("seq", F.sum("_s").over(w)).drop("_s")


def user_trees(e: DataFrame, goals: tuple[str, ...] = ("conversion",)) -> DataFrame:
    """Each user with the nested list of sessions, the acquisition (first event of a known network), and totals.

    A user's sessions are summed up before they are collected, so a list has one small entry for each session.
    """
    numbered = minute_sessions(e)
    s = summed(numbered, "user_id", "seq").withColumn("touch_position", F.col("seq") + 1).withColumn("session_id", F.concat_ws("_", "user_id", "seq"))
    known = F.col("network").isNotNull() & (F.col("network") != "unknown")
    u = numbered.groupBy("user_id").agg(
        F.min_by("network", F.when(known, F.col("ts"))).alias("acquired_by"), F.count("*").alias("events"), F.count_distinct(F.to_date("ts")).alias("active_days"), F.count_if(F.col("type").isin(*goals)).alias("conversions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    entry = F.struct("seq", "session_id", "touch_position", "session_start", "session_end", "event_count", "unique_pages", "duration_seconds", "landing_page", "source_network")
    trees = s.groupBy("user_id").agg(F.count("*").alias("session_count"), F.array_sort(F.collect_list(entry)).alias("sessions"))
    return u.join(trees, "user_id")


def converting_sessions(e: DataFrame, goals: tuple[str, ...] = ("conversion", "purchase")) -> DataFrame:
    """Each goal event with the session that holds it: equal user, and its time within the session's bounds.

    A user's sessions do not overlap and goals are events of them, so a goal's own session is the one that holds it: its bounds come from
    windows over (user, seq), which need no further shuffle, and no session meets a goal of another one. Goals without a time are in none.
    """
    w = W.partitionBy("user_id", "seq")
    s = minute_sessions(e.select("user_id", "ts", "type", "network")).withColumns({"session_start": F.min("ts").over(w), "session_end": F.max("ts").over(w), "source_network": F.min_by("network", "ts").over(w)})
    goal = s.filter(F.col("type").isin(*goals) & F.col("ts").isNotNull())
    return goal.select("user_id", F.col("ts").alias("goal_ts"), F.col("type").alias("goal"), "seq", "session_start", "session_end", "source_network")


def enriched(e: DataFrame, creatives: DataFrame) -> DataFrame:
    """Events with what the creative registry knows of them. The join may be split or sent by size as the optimiser finds it."""
    known = creatives.select(*CREATIVE_KEY, F.col("headline").alias("registry_headline"), "image_url", "landing_page_url")
    return e.join(known, list(CREATIVE_KEY), "left")
