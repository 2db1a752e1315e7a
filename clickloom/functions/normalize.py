"""One set of ad fields from the parameters of different ad networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .maps import lower_keys

# How networks are known (utm_source values, key prefix, click ids), and the keys that may hold each field, in order.
NETWORKS: dict[str, tuple[tuple[str, ...], str | None, tuple[str, ...]]] = {
    "taboola": (("taboola", "tb"), "tb_", ()),
    "outbrain": (("outbrain", "ob"), "ob_", ()),
    "mgid": (("mgid",), "mg_", ()),
    "revcontent": (("revcontent", "rc"), "rc_", ()),
    "googleads": (("google", "googleads", "google-ads"), None, ("gclid", "gclsrc")),
    "meta": (("facebook", "instagram", "meta"), None, ("fbclid", "igshid")),
}
UNKNOWN = "unknown"
FIELDS: dict[str, dict[str, tuple[str, ...]]] = {
    "campaign_id": {
        "taboola": ("utm_campaign",),
        "outbrain": ("utm_campaign",),
        "mgid": ("utm_campaign",),
        "revcontent": ("utm_campaign",),
        "googleads": ("utm_campaign", "campaignid", "campaign_id"),
        "meta": ("utm_campaign", "campaignid", "campaign_id"),
        UNKNOWN: ("utm_campaign",),
    },
    "ad_id": {
        "taboola": ("tb_item",),
        "outbrain": ("ob_item",),
        "mgid": ("mg_id",),
        "revcontent": ("rc_id",),
        "googleads": ("adgroupid", "adgroup_id", "feeditemid", "feed_item_id"),
        "meta": ("ad_id", "adid"),
        UNKNOWN: ("ad_id", "adid", "item"),
    },
    "creative_id": {
        "taboola": ("tb_image",),
        "outbrain": ("ob_creative",),
        "mgid": ("mg_id",),
        "revcontent": ("rc_id",),
        "googleads": ("adgroupid", "adgroup_id", "feeditemid", "feed_item_id", "utm_content"),
        "meta": ("ad_id", "adid", "adset_id", "adsetid", "utm_content"),
        UNKNOWN: ("creative", "creative_id", "asset"),
    },
    "publisher_id": {
        "taboola": ("tb_publisher", "tb_site"),
        "outbrain": ("ob_publisher", "ob_site"),
        "mgid": ("mg_site", "mg_publisher"),
        "revcontent": ("rc_site", "rc_publisher"),
        "googleads": ("siteid", "site_id"),
        "meta": ("siteid", "site_id"),
        UNKNOWN: ("publisher", "pub", "site"),
    },
    "placement_id": {
        "taboola": ("tb_placement",),
        "outbrain": ("ob_placement",),
        "mgid": ("mg_placement",),
        "revcontent": ("rc_placement",),
        "googleads": ("targetid", "target_id", "placement"),
        "meta": ("placementid", "placement_id"),
        UNKNOWN: ("placement", "position"),
    },
    "headline": {
        "taboola": ("tb_headline",),
        "outbrain": (),
        "mgid": ("mg_title",),
        "revcontent": ("rc_title",),
        "googleads": ("headline", "keyword", "placement", "utm_term", "target"),
        "meta": ("headline", "ad_name", "adname", "utm_term"),
        UNKNOWN: ("headline", "title", "head"),
    },
    "image_id": {
        "taboola": ("tb_image",),
        "outbrain": ("ob_creative",),
        "mgid": ("mg_image",),
        "revcontent": ("rc_thumb",),
        "googleads": ("imageid", "image_id", "creative"),
        "meta": ("imageid", "image_id", "creative"),
        UNKNOWN: ("image", "img", "thumb", "thumbnail"),
    },
    "item_id": {
        "taboola": ("tb_item",),
        "outbrain": ("ob_item",),
        "mgid": ("mg_id",),
        "revcontent": ("rc_id",),
        "googleads": ("feeditemid", "feed_item_id", "adgroupid", "adgroup_id"),
        "meta": ("ad_id", "adid", "adset_id", "adsetid"),
        UNKNOWN: ("item", "asset"),
    },
}


def _starts(prefix: str):
    return lambda key: key.startswith(prefix)


def network_of(params: Column) -> Column:
    """The network of a parameter map: by utm_source, else by a click id, else by a key's prefix; ties by the order above."""
    source = F.lower(F.try_element_at(params, F.lit("utm_source")))
    keys = F.transform(F.map_keys(params), lambda k: F.lower(k))
    by_source = [F.when(source.isin(*values), name) for name, (values, _, _) in NETWORKS.items()]
    by_click = [F.when(F.arrays_overlap(keys, F.array(*map(F.lit, ids))), name) for name, (_, _, ids) in NETWORKS.items() if ids]
    by_prefix = [F.when(F.exists(keys, _starts(prefix)), name) for name, (_, prefix, _) in NETWORKS.items() if prefix]
    return F.coalesce(*by_source, *by_click, *by_prefix, F.lit(UNKNOWN))


def field_of(params: Column, network: Column, field: str) -> Column:
    """A field's value: the first of the network's candidate keys that is there (lower-case keys)."""
    lists = F.create_map(*[x for name, keys in FIELDS[field].items() for x in (F.lit(name), F.array(*map(F.lit, keys)).cast("array<string>"))])
    found = F.transform(F.try_element_at(lists, network), lambda k: F.try_element_at(params, k))
    return F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(1))


def normalized(events: DataFrame, params: str = "params") -> DataFrame:
    """Add or complete `network` and the ad fields; values that are there win, a known network wins over "unknown"."""
    have = set(events.columns)
    e = events.withColumns({"_network": network_of(F.col(params)), "_lower": lower_keys(F.col(params))})
    fields = {f: field_of(F.col("_lower"), F.col("_network"), f) for f in FIELDS}
    known = F.when(F.col("network") != UNKNOWN, F.col("network")) if "network" in have else F.lit(None).cast("string")
    e = e.withColumns({f: F.coalesce(f, c) if f in have else c for f, c in fields.items()} | {"network": F.coalesce(known, "_network")})
    return e.drop("_network", "_lower")
