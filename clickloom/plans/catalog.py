"""The report registry: every report with its category and how it runs over the driver's tables."""

from __future__ import annotations

import datetime as dt
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import attribution as at, engagement as en, fatigue as fa, funnels as fu, sessions as se, views as vi
from ..sources.events import between, events
from ..sources.lake import Source


@dataclass(frozen=True)
class Report:
    """A report over canonical events. `ranged` reports see start <= ts < end (all, if neither is given); the others take no range: they look back from `as_of` or read all."""

    name: str
    category: str
    run: Callable[..., DataFrame]
    ranged: bool = True
    params: dict = field(default_factory=dict)

    @property
    def description(self) -> str:
        """What it shows, in a line."""
        said = (inspect.getdoc(self.run) or "").split("\n")[0] if getattr(self.run, "__name__", "") != "<lambda>" else ""
        return said or self.name.partition("_")[2].replace("_", " ").capitalize() + "."

    @property
    def looks_back(self) -> bool:
        found = inspect.signature(self.run).parameters.values()
        return not self.ranged and any(p.name == "as_of" or p.kind is p.VAR_KEYWORD for p in found)

    def over(self, e: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None, **params) -> DataFrame:
        if not self.ranged and (start or end):
            raise ValueError(f"{self.name} takes no start or end" + ", but as_of" * self.looks_back)
        return self.run(between(e, start, end) if self.ranged else e, **{**self.params, **params})


def _reports() -> list[Report]:
    r, anchored = Report, {"ranged": False}
    return [
        r("r01_daily_summary", "daily", en.daily_summary),
        r("r02_ctr_by_campaign", "campaign", en.ctr_by_campaign),
        r("r03_campaign_funnel", "campaign", en.campaign_steps),
        r("r04_top_headlines", "creative", en.top_headlines),
        r("r05_top_images", "creative", en.top_images),
        r("r06_creative_combinations", "creative", en.creative_combinations, params={"least": 2}),
        r("r07_network_comparison", "network", en.network_comparison),
        r("r08_cross_network_creatives", "network", en.cross_network_creatives),
        r("r09_trending_campaigns", "campaign", en.trending_campaigns, params={"least": 4}, **anchored),
        r("r10a_creative_fatigue", "creative", fa.creative_fatigue, params={"least_daily": 1, "least_rolling": 5}, **anchored),
        r("r10b_fatigue_summary", "creative", lambda e, **k: fa.fatigue_summary(fa.creative_fatigue(e, **k)), params={"least_daily": 1, "least_rolling": 5, "n": None}, **anchored),
        r("r11_session_flow", "session", se.flow),
        r("r12_landing_page_performance", "session", se.landing_pages),
        r("r12b_landing_page_by_time", "session", se.landing_pages, params={"by": "time"}),
        r("r13_traffic_spike_detection", "alert", fa.traffic_spikes, **anchored),
        r("r14_zero_traffic_alert", "alert", fa.silent_campaigns, params={"as_of": dt.date(2024, 2, 1)}, **anchored),
        r("r15_hourly_traffic_pattern", "daily", en.hourly_pattern, **anchored),
        r("r16_attribution_first_touch", "attribution", at.first_touch),
        r("r17_attribution_last_touch", "attribution", at.last_touch),
        r("r18_attribution_linear", "attribution", at.linear),
        r("r18b_attribution_linear_normalized", "attribution", at.linear, params={"normalized": True}),
        r("r19_session_reconstruction", "session", se.reconstruct),
        r("r20_user_journey", "session", se.journeys),
        r("r20b_user_journey_of_one", "session", se.journeys, params={"user_id": "7", "timeout_minutes": 45.0}),
        r("r21_attribution_analysis", "attribution", at.multi_touch),
        r("r22_common_paths", "session", se.common_paths),
        r("r23_session_flow_matrix", "session", se.flow_matrix),
        r("r24_cohort_journey", "session", at.cohorts),
        r("r24b_cohort_by_day", "session", at.cohorts, params={"by": "day"}),
        r("r24c_cohort_by_campaign", "session", at.cohorts, params={"by": "campaign"}),
        r("r25_funnel_with_paths", "funnel", fu.step_funnel),
        r("r26_drop_off_analysis", "session", se.drop_off),
        r("r27_returning_user_analysis", "session", se.returning_users),
        r("c01_ctr_campaign", "campaign", en.ctr_campaign),
        r("c02_ctr_creative", "creative", en.ctr_creative),
        r("c03_ctr_network_daily", "network", en.ctr_network_daily),
        r("c04_ctr_matrix", "creative", en.ctr_matrix),
        r("c05_dwell_session", "dwell", en.dwell_by_session),
        r("c05b_dwell_session_max", "dwell", en.dwell_by_session, params={"agg": "max"}),
        r("c06_dwell_landing", "dwell", en.dwell_by_landing),
        r("c07_dwell_creative", "dwell", en.dwell_by_creative),
        r("c08_dwell_inferred", "dwell", en.dwell_inferred),
        r("c09_dwell_histogram", "dwell", en.dwell_histogram),
        r("c10_funnel_full", "funnel", fu.full_funnel),
        r("c11_funnel_creative", "funnel", fu.creative_funnel),
        r("c12_funnel_drop_off", "funnel", fu.drop_stages),
        r("c13_time_to_convert", "funnel", fu.time_to_convert),
        r("c14_funnel_daily", "funnel", fu.daily_funnel),
        r("v01_campaign_daily", "view", vi.campaign_daily, **anchored),
        r("v02_creative_performance", "view", vi.creative_performance, params={"least": 10}, **anchored),
        r("v03_network_daily", "view", vi.network_daily, **anchored),
        r("v04_daily_session_summary", "view", se.session_daily, **anchored),
        r("v05_session_funnels", "view", se.session_funnel, **anchored),
        r("v06_session_quality", "view", se.session_quality, **anchored),
        r("v07_asset_summary", "view", vi.asset_summary, **anchored),
        r("v08_top_headlines", "view", vi.asset_headlines, params={"least": 20}, **anchored),
        r("v09_asset_fatigue", "view", vi.asset_fatigue, **anchored),
        r("v10_cross_network_assets", "view", vi.cross_network_flat, params={"least": 20}, **anchored),
        r("v11_asset_trends", "view", vi.asset_trends, params={"least": 5}, **anchored),
        r("v12_compatible", "view", vi.compatible, **anchored),
        r("v13_quality_filtered", "view", vi.quality_filtered, **anchored),
        r("v14_engagement", "view", vi.engagement_events, **anchored),
        r("v15_attribution_daily", "view", vi.attribution_daily, **anchored),
        r("v16_column_presence", "view", vi.column_presence, **anchored),
        r("v20_network_performance", "view", vi.network_daily, **anchored),
        r("v21_top_creatives", "view", vi.top_creatives, params={"least": 2}, **anchored),
        r("v22_creative_ctr_change", "view", vi.ctr_change, params={"least": 1}, **anchored),
        r("v23_headline_fingerprints", "view", vi.headline_fingerprints, **anchored),
        r("v24_sessions", "view", se.session_rows, **anchored),
        r("v25_assets", "view", vi.assets, **anchored),
        r("q01_campaign_roi", "query", vi.campaign_roi, **anchored),
        r("q02_session_histogram", "query", vi.session_histogram, **anchored),
        r("q03_session_journeys", "query", vi.session_journeys, **anchored),
        r("q04_user_totals", "query", vi.user_totals, **anchored),
        r("q05_session_sources", "query", vi.session_sources, **anchored),
        r("q06_engagement_levels", "query", vi.engagement_levels, **anchored),
        r("q07_link_decoration", "query", vi.link_decoration, **anchored),
        r("q08_source_daily", "query", vi.source_daily, **anchored),
        r("q10_headline_ctr_change", "query", vi.ctr_change, params={"keys": ("tb_headline",), "known": "tb_headline", "least": 1, "n": 20}, **anchored),
    ]


REPORTS: dict[str, Report] = {r.name: r for r in _reports()}


def lake_report(spark: SparkSession, source: Source, name: str, **params) -> DataFrame:
    """Run a registered report over a lake."""
    return REPORTS[name].over(source.reports(spark), **params)


def run_report(spark: SparkSession, sf_dir: str, name: str, **params) -> DataFrame:
    """Run a registered report; an unknown name is a KeyError that lists the known ones."""
    if name not in REPORTS:
        raise KeyError(f"no report {name!r}; known: {', '.join(REPORTS)}")
    return REPORTS[name].over(events(spark, sf_dir), **params)


def plain(df: DataFrame) -> DataFrame:
    """Dates, lists and maps as text, so that results compare across engines."""
    text = {n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"} | {n: F.array_join(n, " > ") for n, t in df.dtypes if t.startswith("array<string")} | {n: F.to_json(n) for n, t in df.dtypes if t.startswith("map<")}
    return df.withColumns(text) if text else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: plain(run_report(spark, sf_dir, name))) for name in REPORTS}
