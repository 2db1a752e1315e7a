"""Registries in files, named views, migration commands, the report archive, maps as keys, the command line."""

import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clickloom import __main__ as cli
from clickloom.__main__ import main
from clickloom.plans import migrations as mi, named_views
from clickloom.plans.catalog import REPORTS
from clickloom.schema import columns_of
from clickloom.sources import published, registry, sinks
from clickloom.sources.events import lake_events
from clickloom.sources.lake import Source

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 5)


# --- registries ------------------------------------------------------------------------------------------------------


def test_metrics_by_days(spark, tmp_path):
    days = [DAY + dt.timedelta(days=i) for i in range(4)]
    path = str(tmp_path)
    empty, missing = registry.read_metrics(spark, path, days)
    assert empty.count() == 0 and missing == days
    sinks.write_metrics(spark.createDataFrame([(days[0], "n", 1), (days[2], "n", 2), (DAY - dt.timedelta(days=9), "n", 3)], "date date, network string, clicks long"), path)
    sinks.write_metrics(spark.createDataFrame([(days[2], "n", 5, "more")], "date date, network string, clicks long, note string"), path)
    rows, missing = registry.read_metrics(spark, path, [*days, days[0]])
    assert sorted((r["date"], r["clicks"], r["note"]) for r in rows.collect()) == [(days[0], 1, None), (days[2], 5, "more")] and missing == [days[1], days[3]]
    every = registry.with_missing_days(spark, rows, missing)
    assert sorted((r["date"], r["clicks"], r["is_missing"]) for r in every.collect()) == [(days[0], 1, False), (days[1], None, True), (days[2], 5, False), (days[3], None, True)]
    assert registry.read_metrics(spark, path, [])[0].columns == ["network", "clicks", "note", "date"] or registry.read_metrics(spark, path, [])[1] == []


CREATIVES = "network string, campaign_id string, creative_id string, headline string, synced_at int"


def files_of(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_creatives_are_merged_by_key(spark, tmp_path):
    path = str(tmp_path)
    merge = lambda *rows: registry.merge_creatives(spark, path, spark.createDataFrame(list(rows), CREATIVES))
    first = [("n", "c", "1", "old", 1), ("n", "c", "1", "older", 0), ("n", "c", "2", "kept", 5), ("m", "c", "1", "x", 1)]
    assert merge(*first) == ["m", "n"]
    before = files_of(tmp_path)
    assert merge(*first) == [] and files_of(tmp_path) == before  # nothing is written again
    assert merge(("n", "c", "1", "new", 2), ("n", "c", "2", "late", 4), ("m", "c", "1", "x", 1)) == ["n"]
    rows = registry.read_creatives(spark, path)
    assert sorted(tuple(r[c] for c in ("network", "campaign_id", "creative_id", "headline", "synced_at")) for r in rows.collect()) == [("m", "c", "1", "x", 1), ("n", "c", "1", "new", 2), ("n", "c", "2", "kept", 5)]
    assert rows.groupBy("network", "campaign_id", "creative_id").count().filter("count > 1").count() == 0
    assert merge(("o", "c", None, "whole", 1)) == ["o"] and merge(("o", "c", None, "whole", 1)) == []
    with_more = spark.createDataFrame([("o", "c", "7", "h", 3, "active")], CREATIVES + ", status string")
    assert registry.merge_creatives(spark, path, with_more) == ["o"] and registry.read_creatives(spark, path).filter("status = 'active'").count() == 1
    published.vacuum(spark, f"{path}/creatives", 0, registry.ROWS)
    assert registry.read_creatives(spark, path).count() == 5


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    new = spark.createDataFrame([("n", "c", "1", "a", 1)], CREATIVES)
    registry.merge_creatives(spark, path, new)
    monkeypatch.setattr(published, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        registry.merge_creatives(spark, path, new.withColumn("synced_at", F.lit(2)).withColumn("headline", F.lit("b")))
    monkeypatch.undo()
    assert [r["headline"] for r in registry.read_creatives(spark, path).collect()] == ["a"]


TREE = "network string, account_id string, campaigns array<struct<campaign_id:string,status:string>>"


def test_hierarchies_by_file_name(spark, tmp_path):
    path = str(tmp_path)
    h = spark.createDataFrame([("mgid", "acc-1", [("c1", "on"), ("c2", None)]), ("meta", "7", None)], TREE)
    assert registry.write_hierarchies(spark, path, h) == ["meta-7.json", "mgid-acc-1.json"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "hierarchies").glob("*.json")}
    assert registry.write_hierarchies(spark, path, h) == [] and {p: p.stat().st_mtime_ns for p in before} == before
    assert registry.write_hierarchies(spark, path, h.withColumn("campaigns", F.when(F.col("network") == "mgid", F.col("campaigns")).otherwise(F.array()))) == ["meta-7.json"]
    assert "\n" in (tmp_path / "hierarchies/mgid-acc-1.json").read_text()
    for schema in (None, TREE):
        rows = {r["network"]: r for r in registry.read_hierarchies(spark, path, schema).collect()}
        assert rows["mgid"]["account_id"] == "acc-1" and [c["campaign_id"] for c in rows["mgid"]["campaigns"]] == ["c1", "c2"] and rows["meta"]["account_id"] == "7"


# --- views -----------------------------------------------------------------------------------------------------------


def test_views_are_built_again_after_a_schema_change(spark, tmp_path):
    path = str(tmp_path)
    e = lake_events(spark, SF)
    old = e.select(*[n for n, _ in columns_of(1)], "event_date")
    old.filter("day(ts) < 15").hint("rebalance", "event_date").write.partitionBy("event_date").parquet(f"{path}/events/part=v1")
    published.publish(spark, path, "v1", published.leaves(spark, path, "v1"))
    views = named_views.over(spark, Source(path=path))
    built = views.rebuild()
    names = [r.name for r in REPORTS.values() if r.category == "view"]
    assert set(names) < set(built) and built.index("raw_events") < built.index("events") < min(map(built.index, names))
    count = lambda name: spark.sql(f"SELECT count(*) AS n FROM {name}").first()["n"]
    assert count("raw_events") == count("events") > 0 and "quality_score" not in spark.table("raw_events").columns
    first = count("events")
    e.filter("day(ts) >= 15").hint("rebalance", "event_date").write.partitionBy("event_date").parquet(f"{path}/events/part=v4")
    published.publish(spark, path, "v4", published.leaves(spark, path, "v4"))
    assert views.rebuild({"raw_events"}) == built
    assert count("events") == e.count() > first and "quality_score" in spark.table("raw_events").columns
    for name in [*names, "campaigns", "creatives"]:
        assert spark.table(name).columns and count(name) >= 0
    assert count("v25_assets") > 0 and views.above({"v25_assets"}) == ["v25_assets"]
    views.drop()
    assert not spark.catalog.tableExists("v25_assets")


def test_order_of_views(spark):
    v = named_views.View
    build = lambda *d: spark.range(1) if not d else d[0]
    some = named_views.Views(spark, [v("c", ("b", "a"), build), v("b", ("a",), build), v("a", (), build), v("z", (), build)])
    order = some.order()
    assert order.index("a") < order.index("b") < order.index("c") and some.above({"b"}) == ["b", "c"] and some.rebuild({"a"}) == ["a", "b", "c"]
    some.drop()
    with pytest.raises(ValueError):
        named_views.Views(spark, [v("a", ("b",), build), v("b", ("a",), build)]).order()


# --- migrations ------------------------------------------------------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "files"
    f.mkdir()
    for i in (1, 2, 3, 4):
        (f / f"V00{i}__step_{i}.sql").write_text(f"CREATE OR REPLACE TEMP VIEW mig_{i} AS SELECT {i} AS x")
        if i != 2:
            (f / f"V00{i}__step_{i}.rollback.sql").write_text(f"DROP VIEW IF EXISTS mig_{i}")
    (f / "README.md").write_text("no migration")
    return f


def test_migration_commands(spark, tmp_path, folder, capsys):
    def call(*action):
        code = main(["migrate", "--files", str(folder), "--ledger", str(tmp_path / "ledger"), *action], spark)
        return code, capsys.readouterr().out.splitlines()

    code, said = call("status")
    assert code == 0 and said[0] == "at V000" and [x.split()[:2] for x in said[1:]] == [["pending", f"V00{i}"] for i in (1, 2, 3, 4)]
    assert call("dry-run", "2") == (0, ["would apply V001 step 1", "would apply V002 step 2"]) and call("status")[1][0] == "at V000"
    assert call("apply", "1") == (0, ["apply V001: done"]) and spark.table("mig_1").first()["x"] == 1
    assert call("apply", "1")[0] == 1 and call("apply", "9")[0] == 1 and call("rollback", "3")[0] == 1
    assert call("apply-all") == (0, [f"apply V00{i}: done" for i in (2, 3, 4)]) and call("apply-all") == (0, [])
    assert call("dry-run", "2") == (0, ["would roll back V004 step 4", "would roll back V003 step 3"])
    assert call("rollback", "2") == (0, ["roll back V004: done", "roll back V003: done"]) and not spark.catalog.tableExists("mig_4")
    code, said = call("rollback", "0")
    assert code == 1 and "no way back from [2]" in said[0] and call("status")[1][0] == "at V002"
    (folder / "V001__step_1.sql").write_text("SELECT 1")
    assert "its file has changed" in call("status")[1][1] and call("apply-all")[0] == 1
    (folder / "V005__five.sql").write_text("SELECT 5")
    (folder / "V003__step_3.sql").unlink()
    m = mi.Migrations(spark, str(tmp_path / "other"), mi.from_folder(spark, str(folder)))
    with pytest.raises(ValueError, match="missing"):
        m.plan()
    (folder / "V005__twice.sql").write_text("SELECT 5")
    with pytest.raises(ValueError, match="one version"):
        mi.from_folder(spark, str(folder))


def test_a_migration_that_fails_leaves_a_known_version(spark, tmp_path, folder):
    (folder / "V003__step_3.sql").write_text("SELECT * FROM no_such_table")
    m = mi.Migrations(spark, str(tmp_path / "ledger"), mi.from_folder(spark, str(folder)))
    with pytest.raises(Exception, match="no_such_table"):
        m.go()
    assert m.current() == 2 and [x.version for x in m.pending()] == [3, 4]


# --- reports ---------------------------------------------------------------------------------------------------------


def test_archive(spark, tmp_path, capsys):
    folder = str(tmp_path / "reports")
    assert sinks.archived_reports(spark, folder).count() == 0
    report = spark.createDataFrame([(1, "a")], "n int, s string")
    runs = [dt.datetime(2024, 1, 5, 2), dt.datetime(2024, 1, 5, 9, 30), dt.datetime(2024, 1, 6, 2)]
    for at in runs:
        sinks.write_report(report, folder, "r01_daily_summary", at.date(), ("json", "csv"), at)
    sinks.write_report(report, folder, "other", DAY, ("json",), runs[0])
    (tmp_path / "reports/odd/x").mkdir(parents=True)
    (tmp_path / "reports/odd/x/file.txt").write_text("x")
    every = sinks.archived_reports(spark, folder)
    assert every.count() == 7 and sinks.archived_reports(spark, folder, "other").count() == 1
    latest = sinks.archived_reports(spark, folder, "r01_daily_summary", latest=True).orderBy("date", "kind").collect()
    assert [(str(r["date"]), r["run"], r["kind"]) for r in latest] == [("2024-01-05", "2024-01-05T09:30:00", "csv"), ("2024-01-05", "2024-01-05T09:30:00", "json"), ("2024-01-06", "2024-01-06T02:00:00", "csv"), ("2024-01-06", "2024-01-06T02:00:00", "json")]
    assert spark.read.json(latest[1]["path"]).first()["s"] == "a" and all(r["files"] > 0 and r["bytes"] > 0 for r in latest)
    assert main(["archive", folder, "--latest"], spark) == 0 and "20240105T093000Z" in capsys.readouterr().out


def test_command_line_dates_and_sources(spark, tmp_path, capsys, monkeypatch):
    for wrong in (["run", "r01_daily_summary"], ["--tables", SF, "--lake", "x", "run", "r01_daily_summary"], ["--tables", SF, "run", "nothing"], ["--tables", SF, "daily", "--archive"]):
        with pytest.raises(SystemExit):
            main(wrong, spark)
    assert main(["list"]) == 0
    said = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert len(said) == len(REPORTS) and all(len(x) == 3 and x[2] for x in said)
    e = lake_events(spark, SF)
    sinks.write_events(e.coalesce(1), str(tmp_path / "lake"), layout=("event_date",))
    monkeypatch.setattr(cli, "REPORTS", {n: REPORTS[n] for n in ("r01_daily_summary", "v02_creative_performance")})
    assert main(["--lake", str(tmp_path / "lake"), "daily", "--output", str(tmp_path / "out")], spark) == 0
    today = dt.datetime.now(dt.timezone.utc).date().isoformat()
    paths = capsys.readouterr().out.split()
    assert all(today in p for p in paths) and spark.read.json(paths[0]).count() > 0
    assert spark.read.schema("views long").json(paths[1]).count() == 0  # today is long after the events
    assert main(["--lake", str(tmp_path / "lake"), "query", "SELECT count(*) AS found FROM v03_network_daily JOIN campaigns USING (network)"], spark) == 0 and "found" in capsys.readouterr().out
    naps = []
    monkeypatch.setattr(cli, "time", SimpleNamespace(sleep=naps.append))
    assert main(["--lake", str(tmp_path / "lake"), "schedule", "--at", "02:00", "--runs", "2", "--output", str(tmp_path / "runs"), "--archive"], spark) == 0
    assert len(naps) == 2 and all(0 < x <= 86_400 for x in naps) and sinks.archived_reports(spark, str(tmp_path / "runs")).select("name").distinct().count() == 2


def test_next_run():
    at = dt.time(2)
    assert cli.next_run(dt.datetime(2024, 1, 5, 1, 59), at) == dt.datetime(2024, 1, 5, 2) and cli.next_run(dt.datetime(2024, 1, 5, 2), at) == dt.datetime(2024, 1, 6, 2)
    assert cli.next_run(dt.datetime(2024, 12, 31, 23), at) == dt.datetime(2025, 1, 1, 2) and json.dumps(str(at))
