"""SQL with the results of the registered reports, written for another engine over the same tables."""

from __future__ import annotations

# the canonical events, as sources.events makes them
BASE = """WITH k0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
k1 AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS user_id, k, value,
  CASE WHEN event_type = 'view' THEN 'pageview' WHEN event_type = 'error' AND k < 50 THEN 'scroll' WHEN event_type = 'error' THEN 'dwell'
       WHEN event_type = 'purchase' AND k >= 50 THEN 'conversion' ELSE event_type END AS type,
  CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
  CASE k % 5 WHEN 0 THEN 'taboola' WHEN 1 THEN 'outbrain' WHEN 2 THEN 'mgid' WHEN 3 THEN 'revcontent' ELSE 'unknown' END AS network,
  'c' || (k % 10) AS campaign_id, 'cr' || (k % 20) AS creative_id, 'h' || (k % 8) AS headline, 'i' || (k % 6) AS image_id,
  CASE k % 12 WHEN 0 THEN '/pricing' WHEN 1 THEN '/signup' WHEN 2 THEN '/checkout' WHEN 3 THEN '/thank-you' ELSE '/p/' || (k % 12) END AS url,
  CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_type FROM k0),
ev AS (SELECT *, CASE WHEN type IN ('purchase', 'conversion') THEN CAST(value AS DECIMAL(18,2)) END AS revenue,
  CASE WHEN type = 'dwell' THEN CAST(round(value * 1000) AS BIGINT) END AS dwell_time_ms, CASE WHEN type = 'dwell' THEN CAST(k AS BIGINT) END AS dwell_visible_pct,
  CASE WHEN type = 'scroll' THEN CAST(2 * k AS BIGINT) END AS scroll_depth_pct, nullif(network, 'unknown') AS utm_source, CASE WHEN k % 2 = 0 THEN 'cpc' END AS utm_medium,
  CASE WHEN network = 'taboola' THEN headline END AS tb_headline, CASE WHEN network = 'taboola' THEN image_id END AS tb_image, CASE WHEN network = 'outbrain' THEN image_id END AS ob_creative,
  CASE WHEN k % 4 <> 0 THEN k / 100.0 END AS quality_score, CASE WHEN k % 3 <> 0 THEN (k % 10) / 10.0 END AS bot_probability, CASE WHEN k % 5 <> 0 THEN (k % 7) / 10.0 END AS fraud_score,
  CASE WHEN k % 13 <> 0 THEN k % 9 <> 0 END AS is_valid, CASE WHEN k % 17 <> 0 THEN k % 11 <> 0 END AS is_verified,
  CASE WHEN k % 6 = 0 THEN 'https://www.' || network || '.com/x' END AS referrer, CASE WHEN k % 6 = 0 THEN network END AS referrer_network,
  CASE WHEN k % 10 <> 9 THEN 'Campaign ' || (k % 10) END AS campaign_name, CASE k % 4 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' WHEN 2 THEN 'windows' ELSE 'linux' END AS device_os,
  CASE WHEN type = 'conversion' THEN CAST(k % 5 + 1 AS BIGINT) END AS attribution_touches, CASE WHEN type = 'conversion' THEN CAST(k % 9 AS BIGINT) END AS attribution_days_to_convert FROM k1),
e AS (SELECT * FROM ev)"""


def last(days: int) -> str:
    return f"ev.day >= DATE '2024-01-31' - {days}"


V, C = "count(*) FILTER (type = 'pageview')", "count(*) FILTER (type = 'click')"


def p(a: str, b: str, n: int = 2) -> str:
    return f"round(100.0::DOUBLE * ({a}) / nullif(({b}), 0), {n})"


def n(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


CTR = p(C, V)
DIMS = "utm_source, utm_medium, campaign_id, creative_id, network"
LABELS = "coalesce(utm_source, '(direct)') AS source, coalesce(utm_medium, '(none)') AS medium, campaign_id AS campaign, creative_id AS content, '(not set)' AS term, network AS ad_network"
BY_LABEL = "source, medium, campaign, content, term, ad_network"


def us(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a}))"


def case(x: str, edges: list[tuple[float, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN '{label}'" for e, label in edges) + f" ELSE '{other}' END"


def gap_sessions(key: str, minutes: int = 30, where: str = "true") -> str:
    return f"""g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR {us('lag(ts) OVER w', 'ts')} > {minutes * 60_000_000} THEN 1 ELSE 0 END AS st FROM e WHERE {where} WINDOW w AS (PARTITION BY {key} ORDER BY ts)),
s AS (SELECT *, CAST(sum(st) OVER (PARTITION BY {key} ORDER BY ts) AS BIGINT) AS seq FROM g)"""


FIRSTS = "arg_min(url, ts) AS landing_page, arg_min(network, ts) AS source_network, arg_min(campaign_id, ts) AS campaign"
COUNTS = f"min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count, count(DISTINCT url) AS unique_pages, CAST(round_even({us('min(ts)', 'max(ts)')} / 1e6, 0) AS BIGINT) AS duration_seconds"
STAGES = """st AS (SELECT session_id, min(network) AS network, min(campaign_id) AS campaign_id, min(creative_id) AS creative_id, min(headline) AS headline, min(ts) AS a, max(ts) AS b,
  count(*) FILTER (type = 'pageview') AS views, count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type = 'scroll') AS scrolls, count(*) FILTER (type = 'dwell') AS dwells, count(DISTINCT url) AS pages,
  count(*) FILTER (type = 'conversion') > 0 OR count(DISTINCT url) >= 3 AS conv FROM e GROUP BY session_id)"""
BOUNCED, WON = "count(*) FILTER (is_bounce)", "count(*) FILTER (converted)"


def sessions(where: str = "true") -> str:
    return f"""ses AS (SELECT session_id, user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count, {V} AS pageviews, {C} AS clicks, count(*) FILTER (type = 'scroll') AS scrolls, count(*) FILTER (type = 'dwell') AS dwells,
  count(*) FILTER (type = 'conversion') AS conversions, count(DISTINCT url) AS unique_pages, arg_min(url, ts) AS landing_page, arg_max(url, ts) AS exit_page, arg_min(network, ts) AS network, arg_min(campaign_id, ts) AS campaign_id,
  arg_min(creative_id, ts) AS creative_id, arg_min(device_type, ts) AS device_type, CAST(coalesce(sum(dwell_time_ms), 0) AS BIGINT) AS dwell_ms, max(scroll_depth_pct) AS max_scroll_pct,
  CAST(round_even({us('min(ts)', 'max(ts)')} / 1e6, 0) AS BIGINT) AS duration_seconds, count(*) = 1 AS is_bounce, count(*) FILTER (type = 'conversion') > 0 AS converted FROM ev WHERE {where} GROUP BY session_id, user_id)"""

#: All columns of the newest schema version; those that the tables lack are null or have their default.
COMPATIBLE = """c AS (SELECT ts, NULL::VARCHAR AS ip, NULL::VARCHAR AS ua, url, type, session_id, user_id, NULL::VARCHAR AS cookie_id, network, campaign_id, campaign_name, creative_id, headline, image_id, NULL::VARCHAR AS item_id, NULL::VARCHAR AS params,
  coalesce(referrer, '') AS referrer, coalesce(referrer_network, 'unknown') AS referrer_network, NULL::VARCHAR AS attribution_campaign_id, NULL::VARCHAR AS attribution_creative_id, coalesce(attribution_touches, 0) AS attribution_touches, coalesce(attribution_days_to_convert, 0) AS attribution_days_to_convert,
  coalesce(device_type, 'unknown') AS device_type, coalesce(device_os, 'unknown') AS device_os, 'unknown' AS device_browser, scroll_depth_pct, NULL::BIGINT AS scroll_time_ms, dwell_time_ms, dwell_visible_pct, NULL::BIGINT AS viewport_width, NULL::BIGINT AS viewport_height,
  CAST(coalesce(quality_score, 1) AS DOUBLE) AS quality_score, CAST(coalesce(bot_probability, 0) AS DOUBLE) AS bot_probability, CAST(coalesce(fraud_score, 0) AS DOUBLE) AS fraud_score, coalesce(is_valid, true) AS is_valid, coalesce(is_verified, true) AS is_verified,
  NULL::VARCHAR AS validation_reason, NULL::TIMESTAMP AS enriched_at, NULL::VARCHAR AS enrichment_version FROM ev)"""


def assets(source: str) -> str:
    one = "min(day) AS first_seen, max(day) AS last_seen, " + f"{V} AS total_views, {C} AS total_clicks, count(*) FILTER (type = 'conversion') AS total_conversions, count(DISTINCT session_id) AS total_sessions, count(DISTINCT campaign_id) AS campaign_count, round(avg(quality_score), 6) AS avg_quality_score"
    return f"""ast AS (SELECT *, network || ':' || kind || ':' || content AS asset_id FROM (
  SELECT network, 'headline' AS kind, headline AS content, {one} FROM {source} GROUP BY network, headline UNION ALL SELECT network, 'image', image_id, {one} FROM {source} GROUP BY network, image_id))"""


def session_counts(days: int = 7) -> str:
    return f"""sc AS (SELECT session_id, {V} AS pageviews, {C} AS clicks, count(*) FILTER (type = 'scroll') AS scrolls, count(*) FILTER (type = 'dwell') AS dwells, {us('min(ts)', 'max(ts)')} / 60000000.0 AS minutes,
  count(*) AS events, count(DISTINCT url) AS urls FROM ev WHERE {last(days)} GROUP BY session_id)"""


def ratio(a: str, b: str, digits: int) -> str:
    return f"sign({a}) * ((2 * {10**digits} * abs({a}) + ({b})) // (2 * ({b}))) / {10**digits}.0::DOUBLE"


def ctr_change(keys: str, filters: str, limit: int) -> str:
    return f"""d AS (SELECT day, {keys}, CAST(round({CTR} * 100) AS BIGINT) AS h, {V} AS v FROM ev WHERE {last(30)} AND {filters} GROUP BY day, {keys}),
m AS (SELECT {keys}, CAST(sum(h) FILTER (day >= DATE '2024-01-24') AS BIGINT) AS r, nullif(count(h) FILTER (day >= DATE '2024-01-24'), 0) AS rn,
  CAST(sum(h) FILTER (day < DATE '2024-01-24' AND day >= DATE '2024-01-10') AS BIGINT) AS q, count(h) FILTER (day < DATE '2024-01-24' AND day >= DATE '2024-01-10') AS qn FROM d WHERE v >= 1 GROUP BY {keys})
SELECT {keys}, {ratio('r', '100 * rn', 4)} AS recent_ctr, {ratio('q', '100 * qn', 4)} AS prior_ctr, {ratio('(100 * (r * qn - q * rn))', 'q * rn', 2)} AS fatigue_change_pct FROM m WHERE q > 0 ORDER BY fatigue_change_pct NULLS LAST, {keys} LIMIT {limit}"""


FATIGUE = """d AS (SELECT day, creative_id, headline, image_id, network, count(*) FILTER (type = 'pageview') AS v, count(*) FILTER (type = 'click') AS c FROM ev WHERE day >= DATE '2023-12-02' GROUP BY ALL HAVING v >= 1),
spans AS (SELECT creative_id, headline, image_id, network, min(day) AS a FROM d GROUP BY ALL),
cal AS (SELECT creative_id, headline, image_id, network, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
roll AS (SELECT cal.creative_id, cal.headline, cal.image_id, cal.network, cal.day, sum(d.v) AS v, sum(d.c) AS c FROM cal JOIN d ON d.creative_id = cal.creative_id AND d.headline = cal.headline AND d.image_id = cal.image_id AND d.network = cal.network
  AND d.day BETWEEN cal.day - 6 AND cal.day GROUP BY ALL),
r AS (SELECT *, 100.0::DOUBLE * c / v AS ctr FROM roll WHERE v >= 5),
peaks AS (SELECT creative_id, headline, image_id, network, max(ctr) AS peak FROM r GROUP BY ALL),
f AS (SELECT r.creative_id, r.headline, r.image_id, r.network, r.ctr AS now, b.ctr AS prior, peak, (SELECT min(x.day) FROM r x WHERE x.creative_id = r.creative_id AND x.headline = r.headline AND x.image_id = r.image_id AND x.network = r.network AND x.ctr = peaks.peak) AS pd
  FROM r JOIN peaks USING (creative_id, headline, image_id, network) JOIN r b ON b.creative_id = r.creative_id AND b.headline = r.headline AND b.image_id = r.image_id AND b.network = r.network AND b.day = DATE '2024-01-27' WHERE r.day = DATE '2024-01-30'),
q AS (SELECT *, DATE '2024-01-31' - pd AS age, CASE WHEN prior > 0 THEN 100 * ((prior - now) / prior) ELSE 0 END AS decline,
  CASE WHEN prior > 0 AND peak > 0 THEN least(1.0, least(0.5, 1.25 * ((prior - now) / prior)) + least(0.3, 0.6 * (peak - now) / peak) + least(0.2, (DATE '2024-01-31' - pd) / 150.0::DOUBLE)) ELSE 0 END AS score FROM f),
fat AS (SELECT creative_id, headline, image_id, network, round(now, 2) AS current_ctr_7d_pct, round(prior, 2) AS prior_ctr_7d_pct, round(peak, 2) AS peak_ctr_pct, round(decline, 1) AS decline_from_3d_ago_pct, CAST(age AS BIGINT) AS days_since_peak, round(score, 2) AS fatigue_score,
  CASE WHEN decline > 20 THEN 'YES' ELSE 'NO' END AS is_fatigued,
  CASE WHEN decline > 20 THEN DATE '2024-01-31' WHEN score > 0.5 THEN DATE '2024-02-07' WHEN score > 0.3 THEN DATE '2024-02-14' WHEN score > 0.15 THEN DATE '2024-03-01' END AS recommended_rotation_date,
  CASE WHEN decline > 20 THEN 'URGENT: Rotate immediately' WHEN score > 0.5 THEN 'HIGH: Prepare replacement within 7 days' WHEN score > 0.3 THEN 'MEDIUM: Plan rotation within 14 days' WHEN score > 0.15 THEN 'LOW: Monitor closely' ELSE 'NORMAL: No action needed' END AS action_recommendation FROM q)"""

COHORT = """, s AS (SELECT user_id, session_id, min(ts) AS a, count(*) AS c, count(DISTINCT url) AS u FROM e GROUP BY ALL), f AS (SELECT user_id, {what} AS cohort, min(ts) AS came FROM e GROUP BY user_id)
SELECT cohort, CAST(floor({gap} / 86400000000.0) AS BIGINT) AS day_number, count(DISTINCT user_id) AS active_users, count(*) AS sessions, round(avg(c), 4) AS avg_events_per_session, round(avg(u), 4) AS avg_pages_per_session
FROM s JOIN f USING (user_id) GROUP BY 1, 2"""


def cohort(what: str) -> str:
    return COHORT.format(what=what, gap=us("came", "a"))


def linear(divisor: str) -> str:
    return f""", won AS (SELECT session_id, count(*) FILTER (type = 'conversion') AS c, CAST(coalesce(sum(revenue) FILTER (type = 'conversion'), 0) AS DOUBLE) AS r, count(*) AS n FROM e GROUP BY 1 HAVING c > 0),
d AS (SELECT DISTINCT session_id, {DIMS}, c, r, n FROM e JOIN won USING (session_id)), d2 AS (SELECT *, {divisor} AS m FROM d),
a AS (SELECT {DIMS}, sum(c / m) AS ac, sum(r / m) AS ar, count(DISTINCT session_id) AS touched_sessions FROM d2 GROUP BY {DIMS})
SELECT {LABELS}, touched_sessions, round(ac, 6) AS attributed_conversions, round(ar, 6) AS attributed_revenue, {p('ac', '(SELECT sum(ac) FROM a)')} AS attribution_pct FROM a ORDER BY attributed_revenue DESC, {BY_LABEL} LIMIT 50"""


def landing(what: str) -> str:
    one = "count(*) FILTER (v = 1)"
    return f""", s AS (SELECT session_id, {what} AS landing_url, {V} AS v FROM e GROUP BY 1) SELECT landing_url, count(*) AS sessions, {one} AS bounced, {p(one, 'count(*)')} AS bounce_rate_pct FROM s GROUP BY 1 ORDER BY sessions DESC, landing_url LIMIT 20"""


def dwell_session(agg: str) -> str:
    edges = [(5000, "< 5s (bounce)"), (15000, "5-15s (skim)"), (30000, "15-30s (reading)"), (60000, "30-60s (engaged)")]
    keys = "session_id, url, network, campaign_id, creative_id"
    return f""", d AS (SELECT {keys}, CAST({agg}(dwell_time_ms) AS BIGINT) AS ms, count(*) AS dwell_ping_count, avg(dwell_visible_pct) AS v, min(ts) AS first_dwell_ts, max(ts) AS last_dwell_ts FROM e WHERE type = 'dwell' GROUP BY ALL ORDER BY ms DESC, {keys} LIMIT 1000)
SELECT {keys}, round(ms / 1000.0::DOUBLE, 1) AS dwell_time_seconds, dwell_ping_count, round(v, 1) AS avg_visible_pct, first_dwell_ts, last_dwell_ts, {case('ms', edges, '60s+ (deep)')} AS dwell_category FROM d"""


def clicks_by(source: str, keys: str, more: str = "", having: str = "true", tail: str = "") -> str:
    return f" SELECT {keys}, {V} AS views, {C} AS clicks, {CTR} AS ctr_pct{more} FROM {source} GROUP BY ALL HAVING {having} {tail}"


def sec(x: str) -> str:
    return f"round({x} / 1000.0::DOUBLE, 1)"


_NETWORK_DAILY = clicks_by(f"(SELECT * FROM ev WHERE {last(30)})", "day AS date, network", ", count(DISTINCT campaign_id) AS campaigns, count(DISTINCT creative_id) AS creatives")

TEXTS: dict[str, str] = {
    "r01_daily_summary": " SELECT day AS date, utm_source AS source, type, count(*) AS events, count(DISTINCT session_id) AS unique_sessions FROM e GROUP BY ALL",
    "r02_ctr_by_campaign": clicks_by("e", "campaign_id AS campaign, utm_source AS source", tail="ORDER BY clicks DESC, campaign, source NULLS LAST LIMIT 50"),
    "r03_campaign_funnel": f""", f AS (SELECT campaign_id AS campaign, {V} AS pageviews, {C} AS clicks, count(*) FILTER (type = 'scroll') AS scrolls, count(*) FILTER (type = 'dwell') AS dwells FROM e GROUP BY 1)
SELECT *, {p('clicks', 'pageviews')} AS click_through_pct, {p('scrolls', 'clicks')} AS scroll_after_click_pct, {p('dwells', 'scrolls')} AS dwell_after_scroll_pct FROM f ORDER BY pageviews DESC, campaign LIMIT 20""",
    "r04_top_headlines": f" SELECT tb_headline AS headline, utm_source AS source, {C} AS clicks, count(DISTINCT campaign_id) AS num_campaigns, min(ts) AS first_seen, max(ts) AS last_seen FROM e WHERE tb_headline IS NOT NULL GROUP BY 1, 2 ORDER BY clicks DESC, 1, 2 LIMIT 50",
    "r05_top_images": f" SELECT tb_image AS image_id, utm_source AS source, {C} AS clicks, count(DISTINCT campaign_id) AS num_campaigns, count(DISTINCT tb_headline) AS num_headlines FROM e WHERE tb_image IS NOT NULL GROUP BY 1, 2 ORDER BY clicks DESC, 1, 2 LIMIT 50",
    "r06_creative_combinations": f" SELECT tb_headline AS headline, tb_image AS image, {C} AS clicks, {CTR} AS ctr FROM e WHERE tb_headline IS NOT NULL GROUP BY 1, 2 HAVING clicks >= 2 ORDER BY clicks DESC, 1, 2 LIMIT 20",
    "r07_network_comparison": f" SELECT utm_source AS network, {V} AS views, {C} AS clicks, {CTR} AS ctr, count(DISTINCT campaign_id) AS num_campaigns, count(DISTINCT tb_headline) AS num_headlines FROM e GROUP BY utm_source",
    "r08_cross_network_creatives": " SELECT image_id AS creative_id, count(DISTINCT network) AS num_networks, list_sort(list(DISTINCT network)) AS networks FROM e WHERE network IN ('taboola', 'outbrain') GROUP BY 1 HAVING num_networks > 1",
    "r09_trending_campaigns": f""", d AS (SELECT day, campaign_id AS campaign, {C} AS c FROM ev WHERE {last(14)} GROUP BY 1, 2), t AS (SELECT campaign, avg(c) FILTER (day >= DATE '2024-01-24') AS r, avg(c) FILTER (day < DATE '2024-01-24') AS q FROM d GROUP BY 1)
SELECT campaign, round(r, 2) AS recent_clicks, round(q, 2) AS prior_clicks, {p('r - q', 'q')} AS momentum_pct FROM t WHERE q > 4 ORDER BY momentum_pct DESC NULLS LAST, campaign LIMIT 20""",
    "r10a_creative_fatigue": f", {FATIGUE} SELECT * FROM fat ORDER BY fatigue_score DESC, decline_from_3d_ago_pct DESC, creative_id, headline, image_id, network LIMIT 50",
    "r10b_fatigue_summary": f""", {FATIGUE} SELECT count(*) AS creatives, count(*) FILTER (is_fatigued = 'YES') AS fatigued, count(*) FILTER (action_recommendation LIKE 'HIGH%') AS high, count(*) FILTER (action_recommendation LIKE 'MEDIUM%') AS medium,
count(*) FILTER (action_recommendation LIKE 'LOW%') AS low, round(avg(fatigue_score), 2) AS avg_fatigue_score, round(avg(decline_from_3d_ago_pct), 2) AS avg_decline_pct FROM fat""",
    "r11_session_flow": ", s AS (SELECT session_id, type, lag(type) OVER (PARTITION BY session_id ORDER BY ts) AS prev_type FROM e) SELECT prev_type, type, count(*) AS flow_count, count(DISTINCT session_id) AS unique_sessions FROM s WHERE prev_type IS NOT NULL GROUP BY 1, 2 ORDER BY flow_count DESC, 1, 2 LIMIT 20",
    "r12_landing_page_performance": landing("min(url)"),
    "r12b_landing_page_by_time": landing("arg_min(url, ts)"),
    "r13_traffic_spike_detection": f""", h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS events FROM ev WHERE {last(14)} GROUP BY 1), b AS (SELECT *, avg(events) OVER w AS m, stddev_samp(events) OVER w AS s FROM h WINDOW w AS (PARTITION BY extract(hour FROM hour) ORDER BY hour ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT hour, events, round(m, 2) AS baseline_avg, round(s, 2) AS baseline_stddev, round(100 * (events - m) / nullif(m, 0), 2) AS deviation_pct FROM b WHERE events > m + 2 * s ORDER BY hour DESC LIMIT 10""",
    "r14_zero_traffic_alert": f" SELECT campaign_id AS campaign, max(ts) AS last_event, count(*) AS total_events, CAST(floor({us('max(ts)', chr(39) + '2024-02-01' + chr(39) + '::TIMESTAMP')} / 86400000000.0) AS BIGINT) AS days_since_last_event FROM ev WHERE day >= DATE '2024-01-25' GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31'",
    "r15_hourly_traffic_pattern": f" SELECT CAST(extract(hour FROM ts) AS BIGINT) AS hour_of_day, type, count(*) AS events FROM ev WHERE {last(7)} GROUP BY 1, 2",
    "r16_attribution_first_touch": f""", s AS (SELECT session_id, arg_min(utm_source, event_id) AS x, min(ts) AS t, count(*) FILTER (type = 'conversion') AS c, coalesce(sum(revenue) FILTER (type = 'conversion'), 0) AS r FROM e GROUP BY 1),
j AS (SELECT e.session_id, {DIMS}, c, r FROM s JOIN e ON e.session_id = s.session_id AND e.ts = s.t), g AS (SELECT {DIMS}, sum(c) AS conversions, sum(r) AS r, count(*) AS attributed_sessions FROM j GROUP BY {DIMS} HAVING sum(c) > 0 OR sum(r) > 0)
SELECT {LABELS}, attributed_sessions, CAST(conversions AS BIGINT) AS conversions, round(CAST(r AS DOUBLE), 2) AS attributed_revenue, {p('conversions', '(SELECT sum(conversions) FROM g)')} AS attribution_pct FROM g ORDER BY attributed_revenue DESC, {BY_LABEL} LIMIT 50""",
    "r17_attribution_last_touch": f""", s AS (SELECT *, lead(type) OVER w AS nx, lag(type) OVER w AS pv FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC) AS rn FROM s WHERE nx = 'conversion' OR (type = 'conversion' AND pv IS NOT NULL)),
g AS (SELECT {DIMS}, count(*) AS conversions, coalesce(sum(revenue), 0) AS r, count(DISTINCT session_id) AS attributed_sessions FROM t WHERE rn = 1 GROUP BY {DIMS})
SELECT {LABELS}, attributed_sessions, conversions, round(CAST(r AS DOUBLE), 2) AS attributed_revenue, {p('conversions', '(SELECT sum(conversions) FROM g)')} AS attribution_pct FROM g ORDER BY attributed_revenue DESC, {BY_LABEL} LIMIT 50""",
    "r18_attribution_linear": linear("n"),
    "r18b_attribution_linear_normalized": linear("count(*) OVER (PARTITION BY session_id)"),
    "r19_session_reconstruction": f""", {gap_sessions('session_id')} SELECT session_id || '_' || seq AS session_id, user_id, {COUNTS}, {FIRSTS}, arg_min(device_type, ts) AS device_type, count(*) = 1 AS is_bounce FROM s GROUP BY s.session_id, seq, user_id HAVING duration_seconds <= 14400 ORDER BY session_start DESC, 1 LIMIT 1000""",
    "r20_user_journey": f", {gap_sessions('user_id')} SELECT user_id, seq AS session_seq, {COUNTS}, {FIRSTS}, list_sort(list(DISTINCT type)) AS event_types FROM s GROUP BY user_id, seq",
    "r20b_user_journey_of_one": f", {gap_sessions('user_id', 45, 'user_id = ' + chr(39) + '7' + chr(39))} SELECT user_id, seq AS session_seq, {COUNTS}, {FIRSTS}, list_sort(list(DISTINCT type)) AS event_types FROM s GROUP BY user_id, seq",
    "r21_attribution_analysis": f""", t AS (SELECT user_id, session_id, arg_min(network, ts) AS network, arg_min(campaign_id, ts) AS campaign_id, arg_min(creative_id, ts) AS creative_id, arg_min(url, ts) AS url, arg_min(type, ts) AS event_type, min(ts) AS session_ts FROM e GROUP BY 1, 2),
c AS (SELECT user_id, session_id AS sid, type AS conversion_type, min(ts) AS conversion_ts FROM e WHERE type IN ('conversion', 'purchase', 'signup') GROUP BY 1, 2, 3),
j AS (SELECT t.*, conversion_ts, conversion_type, row_number() OVER (PARTITION BY user_id ORDER BY session_ts, conversion_ts, conversion_type) AS touch_position, count(*) OVER (PARTITION BY user_id) AS total_touches,
  CAST(floor({us('session_ts', 'conversion_ts')} / 86400000000.0) AS BIGINT) AS days_to_conversion FROM t JOIN c USING (user_id) WHERE session_ts <= conversion_ts)
SELECT *, CASE WHEN touch_position = 1 THEN 'first_touch' END AS attribution_model_first, CASE WHEN touch_position = total_touches THEN 'last_touch' END AS attribution_model_last FROM j""",
    "r22_common_paths": f", s AS (SELECT session_id, list(url ORDER BY ts) AS path, count(*) AS steps FROM e WHERE type = 'pageview' GROUP BY 1 HAVING steps <= 10), f AS (SELECT path, steps, count(*) AS frequency FROM s GROUP BY 1, 2) SELECT path, steps, frequency, {p('frequency', '(SELECT sum(frequency) FROM f)')} AS percentage FROM f ORDER BY frequency DESC, path LIMIT 50",
    "r23_session_flow_matrix": ", s AS (SELECT session_id, url AS from_page, lead(url) OVER (PARTITION BY session_id ORDER BY ts) AS to_page FROM e WHERE type = 'pageview') SELECT from_page, to_page, count(*) AS transition_count, count(DISTINCT session_id) AS unique_sessions FROM s WHERE to_page IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100",
    "r24_cohort_journey": cohort("arg_min(network, ts)"),
    "r24b_cohort_by_day": cohort("CAST(CAST(min(ts) AS DATE) AS VARCHAR)"),
    "r24c_cohort_by_campaign": cohort("arg_min(campaign_id, ts)"),
    "r25_funnel_with_paths": f""", s AS (SELECT user_id, CASE WHEN url = '/pricing' THEN 1 WHEN url = '/signup' OR type = 'signup' THEN 2 WHEN url = '/checkout' OR type = 'purchase' THEN 3 WHEN url = '/thank-you' OR type = 'conversion' THEN 4 END AS step_number FROM e),
g AS (SELECT step_number, count(DISTINCT user_id) AS users_reached_step FROM s WHERE step_number IS NOT NULL GROUP BY 1), l AS (SELECT *, lag(users_reached_step) OVER (ORDER BY step_number) AS prev_step_users FROM g)
SELECT step_number, ['Pricing View', 'Signup', 'Checkout', 'Conversion'][step_number] AS step_name, users_reached_step, prev_step_users, CASE WHEN prev_step_users > 0 THEN {p('users_reached_step', 'prev_step_users')} ELSE 100.0::DOUBLE END AS conversion_rate_pct FROM l""",
    "r26_drop_off_analysis": """, s AS (SELECT session_id, user_id, list(type ORDER BY ts) AS t, list(url ORDER BY ts) AS u FROM e GROUP BY 1, 2)
SELECT t[len(t)] AS last_event_type, u[len(u)] AS last_url, CASE WHEN len(u) > 1 THEN u[len(u) - 1] END AS second_to_last_url, count(*) AS sessions, count(DISTINCT user_id) AS unique_users, round(avg(len(t)), 4) AS avg_events_before_dropoff
FROM s GROUP BY 1, 2, 3 ORDER BY sessions DESC, 1, 2, 3 NULLS LAST LIMIT 50""",
    "r27_returning_user_analysis": f""", u AS (SELECT user_id, count(DISTINCT session_id) AS s, count(*) AS c, count(DISTINCT url) AS q, count(DISTINCT day) AS d FROM e GROUP BY 1)
SELECT {case('s', [(2, 'new'), (3, 'returning_2'), (6, 'returning_3_5'), (11, 'returning_6_10')], 'returning_11_plus')} AS user_segment, count(*) AS user_count, {n('s')} AS total_sessions, {n('c')} AS total_events,
round(avg(s), 4) AS avg_sessions_per_user, round(avg(d), 4) AS avg_active_days, round(avg(q), 4) AS avg_unique_pages FROM u GROUP BY 1""",
    "c01_ctr_campaign": clicks_by("e", "network, campaign_id, campaign_name", ", count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users, min(ts) AS first_seen, max(ts) AS last_seen", "views >= 10", "ORDER BY clicks DESC, network, campaign_id, campaign_name NULLS LAST LIMIT 100"),
    "c02_ctr_creative": clicks_by("e", "network, creative_id, headline, image_id", ", count(DISTINCT campaign_id) AS num_campaigns, count(DISTINCT session_id) AS unique_sessions", "views >= 20", "ORDER BY ctr_pct DESC NULLS LAST, clicks DESC, network, creative_id, headline, image_id LIMIT 50"),
    "c03_ctr_network_daily": clicks_by("e", "day AS date, network", ", count(DISTINCT campaign_id) AS active_campaigns, count(DISTINCT creative_id) AS active_creatives"),
    "c04_ctr_matrix": f""", d AS (SELECT campaign_id, creative_id, headline, day AS date, {V} AS views, {C} AS clicks, {CTR} AS ctr_pct FROM e GROUP BY 1, 2, 3, 4 HAVING views >= 5)
SELECT *, CAST(sum(views) OVER (PARTITION BY campaign_id, creative_id ORDER BY date, headline ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_views FROM d""",
    "c05_dwell_session": dwell_session("sum"),
    "c05b_dwell_session_max": dwell_session("max"),
    "c06_dwell_landing": f""" SELECT url, network, campaign_id, count(DISTINCT session_id) AS sessions, {sec('avg(dwell_time_ms)')} AS avg_dwell_seconds, {sec('min(dwell_time_ms)')} AS min_dwell_seconds, {sec('max(dwell_time_ms)')} AS max_dwell_seconds,
{sec('quantile_cont(dwell_time_ms, 0.5)')} AS median_dwell_seconds, {sec('quantile_cont(dwell_time_ms, 0.9)')} AS p90_dwell_seconds, round(avg(dwell_visible_pct), 1) AS avg_visible_pct
FROM e WHERE type = 'dwell' GROUP BY 1, 2, 3 HAVING sessions >= 5 ORDER BY avg_dwell_seconds DESC, 1, 2, 3 LIMIT 50""",
    "c07_dwell_creative": f""", s AS (SELECT campaign_id, creative_id, headline, network, session_id, CAST(sum(dwell_time_ms) AS BIGINT) AS ms FROM e WHERE type = 'dwell' GROUP BY ALL)
SELECT campaign_id, creative_id, headline, network, count(*) AS sessions_with_dwell, {sec('avg(ms)')} AS avg_dwell_seconds, {sec('quantile_cont(ms, 0.5)')} AS median_dwell_seconds, count(*) FILTER (ms < 5000) AS bounce_count, count(*) FILTER (ms >= 30000) AS engaged_count,
{p('count(*) FILTER (ms >= 30000)', 'count(*)', 1)} AS engagement_rate_pct FROM s GROUP BY 1, 2, 3, 4 HAVING sessions_with_dwell >= 10 ORDER BY avg_dwell_seconds DESC, 1, 2, 3, 4 LIMIT 50""",
    "c08_dwell_inferred": f""", q AS (SELECT session_id, url, ts, lead(url) OVER w AS nu, (coalesce(epoch_us(lead(ts) OVER w), epoch_us(ts) + 1800000000) - epoch_us(ts)) // 1000 AS ms FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts))
SELECT session_id, url, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS event_count, {sec('max(ms)')} AS max_dwell_seconds, {sec('avg(ms)')} AS avg_dwell_seconds, max(CASE WHEN nu IS NULL THEN 'exited' ELSE 'continued' END) AS exit_type
FROM q WHERE ms <= 1800000 GROUP BY 1, 2 ORDER BY max(ms) DESC, 1, 2 LIMIT 100""",
    "c09_dwell_histogram": f""", b AS (SELECT {case('dwell_time_ms', [(5000, '0-5s'), (10000, '5-10s'), (20000, '10-20s'), (30000, '20-30s'), (60000, '30-60s'), (120000, '1-2m'), (300000, '2-5m')], '5m+')} AS dwell_bucket, count(*) AS dwell_events, count(DISTINCT session_id) AS unique_sessions FROM e WHERE type = 'dwell' GROUP BY 1)
SELECT *, {p('unique_sessions', '(SELECT sum(unique_sessions) FROM b)', 1)} AS session_pct FROM b""",
    "c10_funnel_full": f""", {STAGES}, g AS (SELECT campaign_id, network, count(*) AS landing_sessions, count(*) FILTER (clicks > 0) AS click_sessions, count(*) FILTER (scrolls > 0) AS scroll_sessions, count(*) FILTER (pages >= 2 OR dwells > 0) AS engaged_sessions, count(*) FILTER (conv) AS converted_sessions FROM st GROUP BY 1, 2 HAVING landing_sessions >= 10)
SELECT *, {p('click_sessions', 'landing_sessions')} AS landing_to_click_pct, {p('scroll_sessions', 'click_sessions')} AS click_to_scroll_pct, {p('engaged_sessions', 'scroll_sessions')} AS scroll_to_engage_pct, {p('converted_sessions', 'engaged_sessions')} AS engage_to_convert_pct,
{p('converted_sessions', 'landing_sessions')} AS overall_conversion_pct FROM g ORDER BY converted_sessions DESC, campaign_id, network LIMIT 50""",
    "c11_funnel_creative": f""", s AS (SELECT session_id, creative_id, headline, network, {us('min(ts)', 'max(ts)')} / 1e6 AS sec, {C} AS clicks, count(*) FILTER (type = 'scroll') AS scrolls, count(DISTINCT url) AS pages, count(*) FILTER (type = 'conversion') > 0 OR count(DISTINCT url) >= 3 AS conv FROM e GROUP BY 1, 2, 3, 4)
SELECT creative_id, headline, network, count(*) AS sessions, count(*) FILTER (clicks > 0) AS clicked, count(*) FILTER (scrolls > 0) AS scrolled, count(*) FILTER (pages >= 2) AS multi_page, count(*) FILTER (conv) AS conversions,
  {p('count(*) FILTER (conv)', 'count(*)')} AS conversion_rate_pct, {p('count(*) FILTER (clicks > 0)', 'count(*)')} AS click_rate_pct, round(avg(sec), 1) AS avg_duration_seconds
FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 10 ORDER BY conversion_rate_pct DESC, sessions DESC, creative_id, headline, network LIMIT 50""",
    "c12_funnel_drop_off": f""", s AS (SELECT session_id, network, campaign_id, list(type ORDER BY ts) AS t, count(*) AS c, count(DISTINCT url) AS u, count(*) FILTER (type = 'conversion') > 0 AS v FROM e GROUP BY 1, 2, 3),
d AS (SELECT campaign_id, network, v, CASE WHEN c = 1 THEN 'no_engagement' WHEN t[1] = 'pageview' AND NOT list_contains(t, 'click') AND NOT list_contains(t, 'scroll') THEN 'view_only' WHEN list_contains(t, 'click') AND NOT list_contains(t, 'scroll') THEN 'clicked_no_scroll'
  WHEN list_contains(t, 'scroll') AND u < 2 THEN 'single_page' WHEN u >= 2 AND NOT v THEN 'multi_page_no_convert' WHEN v THEN 'converted' ELSE 'other' END AS drop_stage, count(*) AS sessions, round(avg(c), 1) AS avg_events, round(avg(u), 1) AS avg_pages FROM s GROUP BY 1, 2, 3, 4 HAVING sessions >= 5)
SELECT campaign_id, network, drop_stage, sessions, {p('sessions', 'sum(sessions) OVER (PARTITION BY campaign_id, network)', 1)} AS stage_pct, avg_events, avg_pages FROM d""",
    "c13_time_to_convert": f""", s AS (SELECT session_id, network, campaign_id, {us('min(ts)', 'max(ts)')} / 1e6 AS x, {V} AS v, count(DISTINCT url) AS u FROM e GROUP BY 1, 2, 3 HAVING count(*) FILTER (type = 'conversion') > 0 OR count(DISTINCT url) >= 3)
SELECT campaign_id, network, count(*) AS conversions, round(avg(x), 1) AS avg_session_seconds, round(quantile_cont(x, 0.5), 1) AS median_session_seconds, round(avg(v), 1) AS avg_pageviews, round(avg(u), 1) AS avg_unique_pages, count(*) FILTER (x < 30) AS under_30s,
count(*) FILTER (x BETWEEN 30 AND 120) AS between_30s_2m, count(*) FILTER (x > 120) AS over_2m FROM s GROUP BY 1, 2 HAVING conversions >= 3 ORDER BY conversions DESC, 1, 2 LIMIT 50""",
    "c14_funnel_daily": f""", {STAGES} SELECT e.day AS date, e.network, count(DISTINCT e.session_id) AS total_sessions, count(DISTINCT e.session_id) FILTER (clicks > 0) AS sessions_with_click, count(DISTINCT e.session_id) FILTER (scrolls > 0) AS sessions_with_scroll, count(DISTINCT e.session_id) FILTER (conv) AS conversions,
{p('count(DISTINCT e.session_id) FILTER (conv)', 'count(DISTINCT e.session_id)')} AS daily_conversion_rate FROM e JOIN st USING (session_id) GROUP BY 1, 2""",
    "v01_campaign_daily": f" SELECT day AS date, network, campaign_id, {V} AS views, {C} AS clicks, count(*) FILTER (type = 'scroll') AS scrolls, count(*) FILTER (type = 'dwell') AS dwells, count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users, {CTR} AS ctr_pct, {p('count(*) FILTER (type = ' + chr(39) + 'scroll' + chr(39) + ')', V)} AS scroll_rate_pct FROM ev WHERE {last(90)} GROUP BY ALL",
    "v02_creative_performance": clicks_by(f"(SELECT * FROM ev WHERE {last(30)})", "network, creative_id, headline", ", count(DISTINCT campaign_id) AS num_campaigns, min(ts) AS first_seen, max(ts) AS last_seen", "views >= 10"),
    "v03_network_daily": _NETWORK_DAILY,
    "v04_daily_session_summary": f", {sessions()} SELECT CAST(session_start AS DATE) AS date, network, count(*) AS sessions, {n('pageviews')} AS total_pageviews, {n('clicks')} AS total_clicks, {n('scrolls')} AS total_scroll_events, {n('dwells')} AS total_dwell_events, {WON} AS converted_sessions, {p(WON, 'count(*)')} AS conversion_rate_pct, round(avg(duration_seconds), 4) AS avg_duration_seconds, {BOUNCED} AS bounces, {p(BOUNCED, 'count(*)')} AS bounce_rate_pct, round(avg(unique_pages), 4) AS avg_depth FROM ses WHERE session_start >= DATE '2024-01-31' - 90 GROUP BY 1, 2",
    "v05_session_funnels": f""", {sessions()}, f AS (SELECT CAST(session_start AS DATE) AS date, network, campaign_id, count(*) FILTER (pageviews >= 1) AS landing_sessions, count(*) FILTER (clicks >= 1) AS engaged_sessions, count(*) FILTER (unique_pages >= 3) AS browsing_sessions, {WON} AS converted_sessions FROM ses WHERE session_start >= DATE '2024-01-31' - 30 GROUP BY 1, 2, 3)
SELECT *, {p('engaged_sessions', 'landing_sessions')} AS landing_to_engagement_pct, {p('browsing_sessions', 'engaged_sessions')} AS engagement_to_browsing_pct, {p('converted_sessions', 'browsing_sessions')} AS browsing_to_conversion_pct FROM f""",
    "v06_session_quality": f", {sessions()} SELECT network, campaign_id, {case('duration_seconds', [(10, '0-10s'), (30, '10-30s'), (60, '30-60s'), (180, '1-3m'), (300, '3-5m')], '5m+')} AS duration_bucket, count(*) AS sessions, {WON} AS conversions, {p(WON, 'count(*)')} AS conversion_rate_pct, round(avg(unique_pages), 4) AS avg_depth, {BOUNCED} AS bounces, {p(BOUNCED, 'count(*)')} AS bounce_rate_pct FROM ses WHERE session_start >= DATE '2024-01-31' - 30 GROUP BY 1, 2, 3",
    "v07_asset_summary": f""", {assets('ev')} SELECT network, kind, count(*) AS total_assets, {n('total_views')} AS views, {n('total_clicks')} AS clicks, {p('sum(total_clicks)', 'sum(total_views)')} AS overall_ctr, {n('total_conversions')} AS conversions, {p('sum(total_conversions)', 'sum(total_sessions)')} AS overall_conversion_rate,
round(avg(avg_quality_score), 4) AS quality, count(*) FILTER (first_seen >= DATE '2024-01-24') AS new_assets_7d, count(*) FILTER (last_seen >= DATE '2024-01-24') AS active_assets_7d FROM ast WHERE first_seen >= DATE '2023-11-02' GROUP BY 1, 2""",
    "v08_top_headlines": f", {assets('ev')} SELECT network, asset_id, content AS headline, total_views, total_clicks, {p('total_clicks', 'total_views')} AS ctr, total_conversions, campaign_count, avg_quality_score, first_seen, last_seen FROM ast WHERE kind = 'headline' AND last_seen >= DATE '2024-01-01' AND total_views >= 20",
    "v09_asset_fatigue": f""", {assets('ev')}, d AS (SELECT day, headline, network, {V} AS v, {C} AS c FROM ev WHERE {last(30)} GROUP BY 1, 2, 3), m AS (SELECT headline, network, avg(100.0::DOUBLE * c / nullif(v, 0)) AS mean, stddev_samp(100.0::DOUBLE * c / nullif(v, 0)) AS dev, count(*) AS days_active FROM d GROUP BY 1, 2)
SELECT m.headline, m.network, total_views, total_clicks, {p('total_clicks', 'total_views')} AS overall_ctr, round(mean, 2) AS avg_daily_ctr, round(dev, 2) AS ctr_volatility, days_active,
CASE WHEN dev > 0.5 * mean THEN 'HIGH_VOLATILITY' WHEN avg_quality_score < 0.5 THEN 'LOW_QUALITY' WHEN days_active > 14 THEN 'POTENTIALLY_FATIGUED' ELSE 'HEALTHY' END AS fatigue_status FROM ast JOIN m ON m.headline = ast.content AND m.network = ast.network WHERE kind = 'headline' AND last_seen >= DATE '2024-01-24'""",
    "v10_cross_network_assets": f""", {assets('ev')}, b AS (SELECT *, lower(trim(content)) AS content_group FROM ast WHERE total_views >= 20), g AS (SELECT content_group, kind, array_to_string(list_sort(list(DISTINCT network)), ', ') AS networks, count(DISTINCT network) AS network_count, {n('total_views')} AS views, {n('total_clicks')} AS clicks,
  {p('sum(total_clicks)', 'sum(total_views)')} AS overall_ctr, {n('total_conversions')} AS conversions FROM b GROUP BY 1, 2 HAVING network_count >= 2)
SELECT g.*, b.network AS one_network, {p('total_clicks', 'total_views')} AS one_ctr FROM g JOIN b USING (content_group, kind)""",
    "v11_asset_trends": f""", g AS (SELECT headline, network, {C} AS clicks_total, {V} AS views_total, count(*) FILTER (type = 'click' AND day >= DATE '2024-01-24') AS clicks_7d, count(*) FILTER (type = 'pageview' AND day >= DATE '2024-01-24') AS views_7d,
  count(*) FILTER (type = 'click' AND day >= DATE '2024-01-17' AND day < DATE '2024-01-24') AS clicks_7d_prev, count(*) FILTER (type = 'pageview' AND day >= DATE '2024-01-17' AND day < DATE '2024-01-24') AS views_7d_prev FROM ev WHERE {last(30)} GROUP BY 1, 2 HAVING views_7d >= 5)
SELECT *, {p('clicks_7d', 'views_7d')} AS ctr_7d, {p('clicks_7d_prev', 'views_7d_prev')} AS ctr_7d_prev, CASE WHEN views_7d_prev > 0 THEN round(100.0::DOUBLE * (CAST(clicks_7d AS DOUBLE) / views_7d) / nullif(CAST(clicks_7d_prev AS DOUBLE) / views_7d_prev, 0) - 100, 2) END AS ctr_trend_pct, {p('clicks_total', 'views_total')} AS ctr_overall FROM g""",
    "v12_compatible": f", {COMPATIBLE} SELECT * FROM c",
    "v13_quality_filtered": f", {COMPATIBLE} SELECT ts, ip, ua, url, type, session_id, user_id, cookie_id, network, campaign_id, campaign_name, creative_id, headline, image_id, item_id, params, referrer, device_type FROM c WHERE is_valid AND is_verified AND quality_score >= 0.5 AND bot_probability < 0.5 AND fraud_score < 0.5",
    "v14_engagement": " SELECT ts, network, campaign_id, creative_id, headline, type, device_type, device_os, scroll_depth_pct, CAST(NULL AS BIGINT) AS scroll_time_ms, dwell_time_ms, dwell_visible_pct, CAST(NULL AS BIGINT) AS viewport_width, CAST(NULL AS BIGINT) AS viewport_height, CAST(coalesce(quality_score, 1) AS DOUBLE) AS quality_score, attribution_touches, attribution_days_to_convert FROM ev WHERE type IN ('scroll', 'dwell', 'pageview')",
    "v15_attribution_daily": f" SELECT day AS date, network, campaign_id, campaign_name, creative_id, headline, {V} AS views, {C} AS clicks, count(*) FILTER (type = 'scroll') AS scrolls, count(*) FILTER (type = 'dwell') AS dwells, round(avg(attribution_touches), 6) AS avg_touches_to_convert, round(avg(attribution_days_to_convert), 6) AS avg_days_to_convert, count(DISTINCT device_type) AS device_types, count(DISTINCT device_os) AS os_types, round(avg(CAST(coalesce(quality_score, 1) AS DOUBLE)), 6) AS avg_quality_score, count(*) FILTER (coalesce(bot_probability, 0) > 0.5) AS bot_count, min(ts) AS first_event, max(ts) AS last_event FROM ev WHERE {last(90)} GROUP BY day, network, campaign_id, campaign_name, creative_id, headline",
    "v16_column_presence": f""", t AS (SELECT count(referrer) > 0 AS a, count(scroll_depth_pct) > 0 AS b, count(quality_score) > 0 AS c FROM ev WHERE {last(1)}),
u(schema_level, has, yes, no) AS (SELECT 'V001 (base)', a, 'YES - Compatible', 'YES - Native' FROM t UNION ALL SELECT 'V002 (referrer/attribution)', a, 'YES - Native', 'NO - Missing columns' FROM t UNION ALL SELECT 'V003 (engagement)', b, 'YES - Native', 'NO - Missing columns' FROM t
UNION ALL SELECT 'V004 (quality)', c, 'YES - Native', 'NO - Missing columns' FROM t) SELECT schema_level, CASE WHEN has THEN yes ELSE no END AS status FROM u""",
    "v20_network_performance": _NETWORK_DAILY,
    "v21_top_creatives": f" SELECT network, headline, creative_id, {C} AS clicks, {V} AS views, {CTR} AS ctr_pct, count(DISTINCT campaign_id) AS campaigns_used, min(ts) AS first_seen, max(ts) AS last_seen FROM ev WHERE {last(7)} GROUP BY 1, 2, 3 HAVING clicks >= 2 ORDER BY clicks DESC, network, headline, creative_id LIMIT 100",
    "v22_creative_ctr_change": ", " + ctr_change("network, creative_id, headline", "true", 50),
    "v23_headline_fingerprints": f" SELECT regexp_replace(lower(headline), '[^a-z0-9\\s]', '', 'g') AS normalized_headline, count(DISTINCT network) AS num_networks, array_to_string(list_sort(list(DISTINCT network)), ',') AS networks, {C} AS total_clicks, {V} AS total_views, {CTR} AS overall_ctr FROM ev WHERE {last(14)} GROUP BY 1 HAVING num_networks > 1 AND total_clicks >= 20 ORDER BY total_clicks DESC, 1 LIMIT 50",
    "v24_sessions": f", {sessions(last(7))} SELECT * FROM ses",
    "v25_assets": f", {assets('ev')} SELECT * FROM ast",
    "q01_campaign_roi": f", g AS (SELECT campaign_id AS campaign, utm_source AS source, utm_medium AS medium, {V} AS views, {C} AS clicks, count(*) FILTER (type = 'conversion') AS conversions, CAST(coalesce(sum(revenue) FILTER (type = 'conversion'), 0) AS DOUBLE) AS revenue FROM ev WHERE {last(30)} GROUP BY 1, 2, 3) SELECT *, round(revenue / nullif(clicks, 0), 2) AS revenue_per_click FROM g ORDER BY revenue DESC, campaign, source NULLS LAST, medium NULLS LAST LIMIT 20",
    "q02_session_histogram": f", {session_counts()} SELECT pageviews, clicks, scrolls, dwells, round(avg(minutes), 2) AS avg_duration_minutes, count(*) AS num_sessions FROM sc GROUP BY 1, 2, 3, 4 ORDER BY num_sessions DESC, 1, 2, 3, 4 LIMIT 20",
    "q03_session_journeys": f" SELECT session_id, user_id, string_agg(url, ' -> ' ORDER BY ts) AS journey, count(*) AS events, min(ts) AS session_start, max(ts) AS session_end FROM ev WHERE {last(7)} GROUP BY 1, 2 HAVING events >= 2 ORDER BY events DESC, session_id LIMIT 50",
    "q04_user_totals": f" SELECT user_id, count(DISTINCT session_id) AS num_sessions, {V} AS total_pageviews, {C} AS total_clicks, min(ts) AS first_seen, max(ts) AS last_seen, CAST(floor({us('min(ts)', 'max(ts)')} / 86400000000.0) AS BIGINT) + 1 AS days_active FROM ev WHERE {last(30)} GROUP BY 1 ORDER BY num_sessions DESC, user_id LIMIT 50",
    "q05_session_sources": f", s AS (SELECT session_id, utm_source AS source, campaign_id AS campaign, utm_medium AS medium, min(day) AS d FROM ev WHERE {last(7)} GROUP BY 1, 2, 3, 4) SELECT source, campaign, medium, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id) FILTER (d >= DATE '2024-01-30') AS sessions_last_day FROM s GROUP BY 1, 2, 3 ORDER BY sessions DESC, 1 NULLS LAST, 2, 3 NULLS LAST LIMIT 20",
    "q06_engagement_levels": f", {session_counts()}, g AS (SELECT CASE WHEN pageviews >= 5 AND minutes >= 5 THEN 'high' WHEN pageviews >= 3 OR minutes >= 2 THEN 'medium' WHEN pageviews >= 2 THEN 'low' ELSE 'bounce' END AS engagement_level, count(*) AS num_sessions, round(avg(pageviews), 2) AS avg_pageviews, round(avg(clicks), 2) AS avg_clicks, round(avg(minutes), 2) AS avg_duration_minutes FROM sc GROUP BY 1) SELECT *, {p('num_sessions', '(SELECT sum(num_sessions) FROM g)')} AS pct_sessions FROM g",
    "q07_link_decoration": f", {session_counts()} SELECT {case('urls', [(2, 'single_page'), (4, 'multi_page_low')], 'multi_page_high')} AS session_type, count(*) AS num_sessions, round(avg(events), 2) AS avg_events_per_session FROM sc GROUP BY 1",
    "q08_source_daily": f", d AS (SELECT day AS date, utm_source AS source, campaign_id, {V} AS v, {C} AS c, count(DISTINCT session_id) AS s FROM ev GROUP BY 1, 2, 3) SELECT date, source, count(DISTINCT campaign_id) AS active_campaigns, {n('v')} AS total_views, {n('c')} AS total_clicks, {p('sum(c)', 'sum(v)')} AS overall_ctr, {n('s')} AS total_sessions FROM d GROUP BY 1, 2",
    "q10_headline_ctr_change": ", " + ctr_change("tb_headline", "tb_headline IS NOT NULL", 20),
}


#: Columns that hold dates or lists: the registered queries give them as text.
DATES: dict[str, str] = {
    **dict.fromkeys("r01_daily_summary c03_ctr_network_daily c04_ctr_matrix c14_funnel_daily v01_campaign_daily v03_network_daily v04_daily_session_summary v05_session_funnels v15_attribution_daily v20_network_performance q08_source_daily".split(), "date"),
    "r10a_creative_fatigue": "recommended_rotation_date",
    "v08_top_headlines": "first_seen last_seen",
    "v25_assets": "first_seen last_seen",
}
LISTS: dict[str, str] = {"r08_cross_network_creatives": "networks", "r20_user_journey": "event_types", "r20b_user_journey_of_one": "event_types", "r22_common_paths": "path"}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, text in TEXTS.items():
        plain = [f"CAST({c} AS VARCHAR) AS {c}" for c in DATES.get(name, "").split()] + [f"array_to_string({c}, ' > ') AS {c}" for c in LISTS.get(name, "").split()]
        found[name] = f"SELECT * REPLACE ({', '.join(plain)}) FROM ({BASE}{text})" if plain else BASE + text
    return found
