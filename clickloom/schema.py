"""The event table: its columns by schema version, defaults for old rows, and the vocabulary of event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
VERSIONS: dict[int, list[tuple[str, T.DataType]]] = {
    1: [("ts", _TS), ("ip", _S), ("ua", _S), ("url", _S), ("type", _S), ("session_id", _S), ("user_id", _S), ("cookie_id", _S), ("network", _S), ("campaign_id", _S), ("campaign_name", _S),
        ("creative_id", _S), ("headline", _S), ("image_id", _S), ("item_id", _S), ("params", T.MapType(_S, _S))],
    2: [("referrer", _S), ("referrer_network", _S), ("attribution_campaign_id", _S), ("attribution_creative_id", _S), ("attribution_touches", _L), ("attribution_days_to_convert", _L), ("device_type", _S), ("device_os", _S), ("device_browser", _S)],
    3: [("scroll_depth_pct", _L), ("scroll_time_ms", _L), ("dwell_time_ms", _L), ("dwell_visible_pct", _L), ("viewport_width", _L), ("viewport_height", _L)],
    4: [("quality_score", _D), ("bot_probability", _D), ("fraud_score", _D), ("is_valid", _B), ("is_verified", _B), ("validation_reason", _S), ("enriched_at", _TS), ("enrichment_version", _S)],
}
#: Further columns of the normaliser.
EXTRA = [("ad_id", _S), ("publisher_id", _S), ("placement_id", _S)]
REQUIRED = ("ts", "url", "type")
EVENTS = T.StructType([T.StructField(n, t, n not in REQUIRED) for v in sorted(VERSIONS) for n, t in VERSIONS[v]])
#: Other spellings of event types, fixed values.
TYPE_ALIASES = {"load": "pageview", "pv": "pageview", "heartbeat": "dwell"}
#: Defaults of columns that older rows lack.
DEFAULTS = {
    "referrer": "", "referrer_network": "unknown", "device_type": "unknown", "device_os": "unknown", "device_browser": "unknown", "attribution_touches": 0, "attribution_days_to_convert": 0,
    "quality_score": 1.0, "bot_probability": 0.0, "fraud_score": 0.0, "is_valid": True, "is_verified": True,
}
#: Ranges outside of which a value is not believed.
RANGES = {
    **dict.fromkeys(("attribution_touches", "attribution_days_to_convert", "scroll_time_ms", "dwell_time_ms"), (0, None)), **dict.fromkeys(("scroll_depth_pct", "dwell_visible_pct"), (0, 100)),
    **dict.fromkeys(("viewport_width", "viewport_height"), (1, None)), **dict.fromkeys(("quality_score", "bot_probability", "fraud_score"), (0.0, 1.0)),
}


def columns_of(version: int) -> list[tuple[str, T.DataType]]:
    return [c for v in sorted(VERSIONS) if v <= version for c in VERSIONS[v]]


def version_of(df: DataFrame) -> int:
    """The highest version whose columns are all there."""
    return max((v for v in VERSIONS if {n for n, _ in columns_of(v)} <= set(df.columns)), default=0)


def evolved(df: DataFrame, version: int = max(VERSIONS)) -> DataFrame:
    """The columns of a version in order; missing ones as nulls, further ones at the end. Nothing is dropped or renamed."""
    want = columns_of(version)
    have = set(df.columns)
    first = [F.col(n).cast(t) if n in have else F.lit(None).cast(t).alias(n) for n, t in want]
    return df.select(*first, *[c for c in df.columns if c not in {n for n, _ in want}])


def compatible(df: DataFrame) -> DataFrame:
    """All columns of the newest version, with defaults where older rows have nothing."""
    return evolved(df).fillna({k: v for k, v in DEFAULTS.items() if not isinstance(v, bool)}).withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items() if isinstance(v, bool)})


def sanitized(df: DataFrame) -> DataFrame:
    """Values out of range as null."""

    def kept(name: str, low, high) -> Column:
        c = F.col(name)
        return F.when((c >= low) & (c <= high) if high is not None else c >= low, c)

    return df.withColumns({n: kept(n, *r) for n, r in RANGES.items() if n in df.columns})


def event_type(raw: Column) -> Column:
    """Canonical event type: lower case, aliases folded; null as pageview."""
    low = F.lower(F.trim(raw))
    known = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), low, F.lit("pageview"))
