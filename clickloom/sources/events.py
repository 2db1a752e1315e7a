"""The canonical event table from the driver's `events` table, and the window that reports look at."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import EVENTS, evolved

#: The day that look-back reports over the example tables count from; their events are of January 2024.
AS_OF = dt.date(2024, 1, 31)
NETWORKS = ("taboola", "outbrain", "mgid", "revcontent")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(events: DataFrame) -> DataFrame:
    """One row per event with the columns that reports use; all built-in expressions, so filters on ts reach the scan."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "event_type", "value", k.alias("k"))
    kind = (
        F.when(F.col("event_type") == "view", "pageview")
        .when(F.col("event_type") == "error", F.when(F.col("k") < 50, "scroll").otherwise("dwell"))
        .when(F.col("event_type") == "purchase", F.when(F.col("k") >= 50, "conversion").otherwise("purchase"))
        .otherwise(F.col("event_type"))
    )
    named = lambda letter, n: F.concat(F.lit(letter), (F.col("k") % n).cast("string"))
    network = F.element_at(F.array(*map(F.lit, (*NETWORKS, "unknown"))), F.col("k") % 5 + 1)
    page = F.col("k") % 12
    url = F.when(page == 0, "/pricing").when(page == 1, "/signup").when(page == 2, "/checkout").when(page == 3, "/thank-you").otherwise(F.concat(F.lit("/p/"), page.cast("string")))
    e = e.select(
        "event_id", "ts", F.to_date("ts").alias("day"), "user_id", kind.alias("type"), "k", "value",
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        network.alias("network"), named("c", 10).alias("campaign_id"), named("cr", 20).alias("creative_id"), named("h", 8).alias("headline"), named("i", 6).alias("image_id"),
        url.alias("url"), F.element_at(F.array(*map(F.lit, ("desktop", "mobile", "tablet"))), F.col("k") % 3 + 1).alias("device_type"),
    )
    paid, network = F.col("type").isin("purchase", "conversion"), F.col("network")
    return e.select(
        "*",
        F.when(paid, F.col("value").cast("decimal(18,2)")).alias("revenue"),
        F.when(F.col("type") == "dwell", F.round(F.col("value") * 1000).cast("long")).alias("dwell_time_ms"),
        F.when(F.col("type") == "dwell", F.col("k").cast("long")).alias("dwell_visible_pct"),
        F.when(F.col("type") == "scroll", (F.col("k") * 2).cast("long")).alias("scroll_depth_pct"),
        F.when(network != "unknown", network).alias("utm_source"),
        F.when(F.col("k") % 2 == 0, "cpc").alias("utm_medium"),
        F.when(network == "taboola", F.col("headline")).alias("tb_headline"),
        F.when(network == "taboola", F.col("image_id")).alias("tb_image"),
        F.when(network == "outbrain", F.col("image_id")).alias("ob_creative"),
        F.when(F.col("k") % 4 != 0, F.col("k") / F.lit(100.0)).alias("quality_score"),
        F.when(F.col("k") % 3 != 0, F.col("k") % 10 / F.lit(10.0)).alias("bot_probability"),
        F.when(F.col("k") % 5 != 0, F.col("k") % 7 / F.lit(10.0)).alias("fraud_score"),
        F.when(F.col("k") % 13 != 0, F.col("k") % 9 != 0).alias("is_valid"),
        F.when(F.col("k") % 17 != 0, F.col("k") % 11 != 0).alias("is_verified"),
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("https://www."), network, F.lit(".com/x"))).alias("referrer"),
        F.when(F.col("k") % 6 == 0, network).alias("referrer_network"),
        F.when(F.col("k") % 10 != 9, F.concat(F.lit("Campaign "), (F.col("k") % 10).cast("string"))).alias("campaign_name"),
        F.element_at(F.array(*map(F.lit, ("ios", "android", "windows", "linux"))), F.col("k") % 4 + 1).alias("device_os"),
        F.when(F.col("type") == "conversion", (F.col("k") % 5 + 1).cast("long")).alias("attribution_touches"),
        F.when(F.col("type") == "conversion", (F.col("k") % 9).cast("long")).alias("attribution_days_to_convert"),
    )


def with_params(e: DataFrame) -> DataFrame:
    """Add the open parameter map; null values have no key."""
    names = ("utm_source", "utm_medium", "network", "campaign_id", "creative_id", "tb_headline", "tb_image", "ob_creative", "revenue")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names], F.struct(F.lit("utm_campaign").alias("key"), F.col("campaign_id").alias("value")))
    return e.withColumn("params", F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())))


def lake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example table as events of a lake: report columns without a column in the event schema stand in the parameters."""
    e = with_params(events(spark, sf_dir)).withColumn("event_date", F.col("day"))
    return evolved(e).select(*EVENTS.fieldNames(), "event_date")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(read_table(spark, sf_dir, "events"))


def at(e: DataFrame, when: dt.datetime) -> Column:
    """A point in time in the type of the events' `ts`."""
    return F.lit(when).cast(e.schema["ts"].dataType)


def between(e: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """The half-open range of a report; without a start or an end it is open there. The same days are asked of `day`, which may be a partition."""
    if start is not None:
        e = e.filter((F.col("ts") >= at(e, start)) & (F.col("day") >= F.lit(start.date())))
    if end is not None:
        e = e.filter((F.col("ts") < at(e, end)) & (F.col("day") <= F.lit(end.date())))
    return e


def since(e: DataFrame, days: int, as_of: dt.date = AS_OF) -> DataFrame:
    """Events of the last days before a day (and of that day)."""
    return between(e, dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days))
