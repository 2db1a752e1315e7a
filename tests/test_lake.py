"""Parsing, normalising, streaming, registries, compaction and migrations."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.__main__ import main
from clickloom.functions.maps import lower_keys, query_map, query_string
from clickloom.functions.normalize import network_of, normalized
from clickloom.operators import dimensions as di, sessions as se
from clickloom.plans import migrations as mi
from clickloom.sources import lake, raw_logs, sinks
from clickloom.sources.events import events, with_params
from clickloom.streaming import ingest as st

SF = "/root/testdata/sf0.001"


def line(body=None, query="", method="POST", ts="2024-01-05T10:00:00Z", ip=None, referer=None, xff=None):
    headers = {"user_agent": "ua", "referer": referer, "x_forwarded_for": xff}
    return json.dumps({"ts": ts, "method": method, "path": "/p", "headers": headers, "query_params": query, "body": body if body is None or isinstance(body, str) else json.dumps(body), "client_ip": ip})


def parsed(spark, *lines):
    return raw_logs.parse(spark.createDataFrame([(x, "raw-20240105-10.jsonl.ready") for x in lines], "value string, file string"))


def test_parse(spark):
    rows = parsed(
        spark,
        line({"type": "pageview", "sid": "s", "uid": "u", "url": "https://e.com", "title": "T"}, referer="https://google.com/x", ip="1.2.3.4"),
        line({"type": "HeartBeat", "session_id": "s2", "dwell": 30000, "f": 1.5, "n": None, "o": {"a": 1}, "l": [1], "params": {"tb_image": "i", "dwell": 1, "deep": {"x": 1}}}, xff=" 10.0.0.1, 1.2.3.4"),
        line({"type": "click", "outbound": True, "utm_source": "TB"}, referer="https://fb.com/"),
        line(method="GET", query="url=https%3A%2F%2Fe.com&type=load&sid=x&a=1&a=2&flag&p=a+b%20c&bad=%zz"),
        "no json", line({}, ts="invalid"), line("{not"), line(ts=None),
    ).collect()
    a, b, c, d = rows[:4]
    assert (a["type"], a["session_id"], a["user_id"], a["url"], a["ip"], a["referrer_network"], a["params"]["title"]) == ("pageview", "s", "u", "https://e.com", "1.2.3.4", "google", "T")
    assert (b["type"], b["ip"], b["dwell_time_ms"], b["network"], b["image_id"]) == ("dwell", "10.0.0.1", 30000, "taboola", "i")
    assert b["params"] == {"dwell": "30000", "f": "1.5", "tb_image": "i"} and a["arrival_date"] == "20240105" and a["event_date"] == dt.date(2024, 1, 5)
    assert (c["params"]["outbound"], c["network"], c["referrer_network"], c["url"]) == ("true", "taboola", "facebook", "/p")
    assert (d["type"], d["url"], d["session_id"]) == ("pageview", "https://e.com", "x") and d["params"] == {"url": "https://e.com", "a": "2", "p": "a+b c", "bad": "%zz"}
    good, bad = raw_logs.split(parsed(spark, *[r["value"] for r in rows]))
    assert good.count() == 4 and sorted(r["error"] for r in bad.collect()) == ["bad body", "bad timestamp", "not a request", "not a request"]


def test_maps(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(query_map(F.lit(None).cast("string"))) == {} and one(query_map(F.lit("a=1&b&=&a=2=3"))) == {"a": "2=3", "": ""}
    assert one(query_string(F.create_map(F.lit("b c"), F.lit("~*é"), F.lit("a"), F.lit("1+")))) == "a=1%2B&b%20c=~%2A%C3%A9"
    assert one(lower_keys(F.create_map(F.lit("A"), F.lit("1"), F.lit("a"), F.lit("2")))) == {"a": "1"}


@pytest.mark.parametrize(
    "params, network, fields",
    [
        ({"utm_source": "Taboola"}, "taboola", {}),
        ({"UTM_SOURCE": "ob", "TB_IMAGE": "x", "TB_HEADLINE": "h"}, "taboola", {"image_id": "x", "creative_id": "x", "headline": "h"}),
        ({"rc_id": "1"}, "revcontent", {"ad_id": "1", "item_id": "1"}),
        ({"gclid": "g", "tb_x": "1", "adgroup_id": "a", "utm_content": "u", "keyword": "k"}, "googleads", {"ad_id": "a", "creative_id": "a", "headline": "k"}),
        ({"fbclid": "f", "ad_id": "7", "campaignid": "c"}, "meta", {"ad_id": "7", "campaign_id": "c"}),
        ({"utm_campaign": "c", "item": "i"}, "unknown", {"campaign_id": "c", "ad_id": "i", "item_id": "i"}),
        ({}, "unknown", {}),
    ],
)
def test_normalize(spark, params, network, fields):
    row = normalized(spark.createDataFrame([(params,)], "params map<string,string>")).first()
    assert row["network"] == network and fields.items() <= row.asDict().items()
    assert fields or not any(v for k, v in row.asDict().items() if k not in ("params", "network"))
    kept = normalized(spark.createDataFrame([(params, "mine", "mgid")], "params map<string,string>, campaign_id string, network string")).first()
    assert kept["campaign_id"] == "mine" and kept["network"] == "mgid"


def test_network_of_report_params(spark):
    rows = with_params(events(spark, SF)).select("network", network_of(F.col("params")).alias("found")).filter("network != found").count()
    assert rows == 0


def test_body_values(spark):
    body = {"h": "[Video] 5 tips", "g": "{x}", "o": {"a": 1}, "l": [1], "n": None, "i": 7, "b": False, "params": {"q": "[1]", "deep": []}}
    twice = '{"a": 1, "a": 2, "o": {}, "s": "x"}'
    rows = parsed(spark, line(body), line(twice), line("[1]"), line({})).collect()
    assert rows[0]["params"] == {"h": "[Video] 5 tips", "g": "{x}", "i": "7", "b": "false", "q": "[1]"}
    assert rows[1]["params"]["s"] == "x" and "o" not in rows[1]["params"]
    assert rows[2]["params"] in ({}, None) and rows[3]["params"] == {}


@pytest.mark.parametrize("ts", ["2024-01-05", "2024-01-05T10:00:00", "2024-01-05 10", "10:00:00Z", "2024-01-05T10:00Z", "2024-13-05T10:00:00Z"])
def test_timestamps_need_all_parts(spark, ts):
    assert parsed(spark, line({}, ts=ts)).first()["error"] == "bad timestamp"


def test_timestamps_with_offsets(spark):
    found = parsed(spark, line({}, ts="2024-01-05T10:00:00.25+02:00"), line({}, ts="2024-01-05T08:00:00.25Z")).select("ts", "error").distinct().collect()
    assert len(found) == 1 and found[0]["error"] is None


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/raw-20240105-10.jsonl.ready").write_text("\n".join([line({"type": "click", "sid": "s", "scroll": 1}), "bad", line({"type": "pv"}, ts="2024-01-04T23:59:00Z")]))
    (tmp_path / "in/raw-20240105-11.jsonl").write_text(line({"type": "click"}))  # not finished
    run = lambda: st.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    run()  # nothing is read twice
    back = lake.Source(path=str(tmp_path / "out")).events(spark)
    assert sorted((r["type"], str(r["event_date"])) for r in back.select("type", "event_date").collect()) == [("click", "2024-01-05"), ("pageview", "2024-01-04")]
    assert spark.read.json(str(tmp_path / "out/rejects")).count() == 1
    (tmp_path / "in/raw-20240105-12.jsonl.ready").write_text(line({"type": "click"}))
    run()
    assert lake.Source(path=str(tmp_path / "out")).events(spark).count() == 3


def test_live_sessions_and_traffic(spark):
    e = events(spark, SF)
    assert se.live_sessions(e).count() == se.gap_sessions(e).select("user_id", "seq").distinct().count()
    assert st.live_traffic(e).agg(F.sum("events")).first()[0] == e.count()


def test_schema(spark):
    old = spark.createDataFrame([("u", "x", 5)], "url string, type string, more int")
    new = schema.compatible(old)
    assert new.columns[: len(schema.EVENTS)] == schema.EVENTS.fieldNames() and new.columns[-1] == "more" and new.first()["quality_score"] == 1.0 and new.first()["is_valid"] is True
    assert len(schema.EVENTS) == 39 and schema.version_of(new) == 4 and schema.version_of(old) == 0
    bad = spark.createDataFrame([(101, -1, 0, 1.5), (100, 0, 1, 1.0)], "scroll_depth_pct long, dwell_time_ms long, viewport_width long, quality_score double")
    assert [tuple(r) for r in schema.sanitized(bad).collect()] == [(None, None, None, None), (100, 0, 1, 1.0)]


def test_registry(spark):
    cols = "network string, campaign_id string, creative_id string, headline string, synced_at int"
    old = spark.createDataFrame([("n", "c", "1", "old", 1), ("n", "c", "2", "kept", 5), ("n", "c", None, "x", 1)], cols)
    new = spark.createDataFrame([("n", "c", "1", "new", 1), ("n", "c", "2", "late", 4), ("n", "d", "3", "added", 1)], cols)
    assert sorted(r["headline"] for r in di.upserted(old, new).collect()) == ["added", "kept", "new", "x"]
    m = di.with_rates(spark.createDataFrame([(1000, 50, 1_000_000), (0, 0, 5)], "impressions long, clicks long, spend_micros long")).collect()
    assert [tuple(r)[3:] for r in m] == [(500, 20_000, 1_000_000), (None, None, None)]


def test_hierarchy(spark):
    creative = "array<struct<creative_id:string,headline:string>>"
    h = spark.createDataFrame(
        [("n", "a", [("c1", "C", "on", [("g1", "G", "on", [("x", "1"), ("y", "2")])], [("z", "3")]), ("c2", "D", "off", None, None)])],
        f"network string, account_id string, campaigns array<struct<campaign_id:string,campaign_name:string,status:string,ad_groups:array<struct<ad_group_id:string,ad_group_name:string,status:string,creatives:{creative}>>,creatives:{creative}>>",
    )
    assert di.hierarchy_campaigns(h).count() == 2 and di.hierarchy_ad_groups(h).count() == 1
    assert sorted((r["creative_id"], r["ad_group_id"]) for r in di.hierarchy_creatives(h).collect()) == [("x", "g1"), ("y", "g1"), ("z", None)]


def test_user_trees(spark):
    t = lambda m, s=0: dt.datetime(2024, 1, 1, m // 60, m % 60, s)
    e = spark.createDataFrame([("u", t(0), "pageview", "unknown"), ("u", t(30, 59), "click", "mgid"), ("u", t(62), "conversion", "meta"), (None, t(0), "click", "x")], "user_id string, ts timestamp_ntz, type string, network string")
    e = e.withColumns({c: F.lit("v") for c in ("url", "campaign_id", "device_type")})
    row = di.user_trees(e).first()
    assert (row["session_count"], row["acquired_by"], row["conversions"], [s["event_count"] for s in row["sessions"]]) == (2, "mgid", 1, [2, 1])
    assert di.converting_sessions(e).first()["seq"] == 1


def test_converting_sessions_meet_only_their_own_goals(spark):
    """A user with very many sessions and goals: as the join by bounds, with one shuffle and no join in the plan."""
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    rows = [("bot", at(40 * i + j), ("click", "conversion", "purchase")[j % 3], f"n{i % 3}") for i in range(60) for j in range(4)]
    rows += [("u", at(0), "click", "x"), ("u", at(30), "conversion", "y"), ("u", None, "conversion", "z"), (None, at(5), "conversion", "x"), ("v", at(3), "purchase", None)]
    e = spark.createDataFrame(rows, "user_id string, ts timestamp_ntz, type string, network string")
    got = di.converting_sessions(e)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    numbered = di.minute_sessions(e)
    s = numbered.groupBy("user_id", "seq").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.min_by("network", "ts").alias("source_network"))
    c = e.filter("type in ('conversion', 'purchase')").select("user_id", F.col("ts").alias("goal_ts"), F.col("type").alias("goal"))
    want = c.join(s, "user_id").filter("goal_ts between session_start and session_end").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 60 * 2 + 2


def test_migrations(spark, tmp_path):
    known = [mi.Migration.from_file(f"V00{i}__step_{i}.sql", f"SELECT {i}", f"SELECT -{i}") for i in (1, 2, 3)]
    m = mi.Migrations(spark, str(tmp_path / "ledger"), known)
    with pytest.raises(ValueError):
        m.apply(2)
    assert m.apply(1) and not m.apply(1) and m.apply_all() == [2, 3] and m.current() == 3
    m.roll_back(3)
    assert m.current() == 2 and [x.version for x in m.pending()] == [3] and m.apply(3)
    assert [(r["version"], r["gap"], r["is_current"]) for r in m.history().orderBy("version").collect()] == [(1, 1, False), (2, 1, False), (3, None, True)]
    with pytest.raises(ValueError):
        m.roll_back(9)


def test_cli_and_sinks(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "r02_ctr_by_campaign" in capsys.readouterr().out
    assert main(["--tables", SF, "run", "r08_cross_network_creatives", "--format", "both", "--output", str(tmp_path)], spark) == 0
    paths = capsys.readouterr().out.split()
    assert spark.read.json(paths[0]).count() == spark.read.option("header", True).csv(paths[1]).count() > 0
    with pytest.raises(SystemExit):
        main(["--tables", SF, "run", "r01_daily_summary", "--format", "both"], spark)
    with pytest.raises(SystemExit):
        main(["--tables", SF, "run", "v22_creative_ctr_change", "--end", "2024-01-20"], spark)
    assert main(["--tables", SF, "run", "v22_creative_ctr_change", "--as-of", "2024-01-20", "--output", str(tmp_path / "day")], spark) == 0
    m = spark.createDataFrame([(20240105, 1), (20240106, 2)], "date int, x int")
    sinks.write_metrics(m, str(tmp_path / "m"))
    sinks.write_metrics(m.filter("x = 2").withColumn("x", F.lit(9)), str(tmp_path / "m"))
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "m/metrics")).collect()) == [1, 9]
