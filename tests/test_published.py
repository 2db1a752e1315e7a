"""Lakes with a log of published parts: reports over them, ingest that can run again, compaction beside readers."""

import datetime as dt
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from clickloom.plans import compaction
from clickloom.plans.catalog import REPORTS, lake_report, run_report
from clickloom.sources import published, raw_logs, sinks
from clickloom.sources.events import between, lake_events
from clickloom.sources.lake import Source
from clickloom.streaming import ingest as st

from .test_lake import line

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The example events as a lake of two published parts, and an unpublished one that must not count."""
    path = str(tmp_path_factory.mktemp("lake"))
    e = lake_events(spark, SF)
    for part, some in (("a", "day(ts) < 12"), ("b", "day(ts) >= 12"), ("c", "true")):
        sinks.write_events(e.filter(some), path, part=part, layout=("event_date",))
        if part != "c":
            assert published.publish(spark, path, part, published.leaves(spark, path, part))
    return Source(path=path)


def plain_rows(df):
    def of(x):
        return round(x, 6) if isinstance(x, float) else str(x)

    columns = [c for c in sorted(df.columns) if c != "params"]  # the example table has no map
    return sorted((tuple(of(r[c]) for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", REPORTS)
def test_reports_over_a_lake(spark, source, name):
    """Each report equals the one over the example table, which is compared with SQL elsewhere."""
    assert plain_rows(lake_report(spark, source, name)) == plain_rows(run_report(spark, SF, name))


def test_ranges_reach_partitions_and_files(spark, source):
    report = lake_report(spark, source, "r02_ctr_by_campaign", start=dt.datetime(2024, 1, 5, 12), end=dt.datetime(2024, 1, 8))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2024-01-05" in plan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(ts" in plan
    assert "dwell_time_ms" not in plan.split("ReadSchema")[1].split("\n")[0]
    back = REPORTS["v02_creative_performance"].over(source.reports(spark), as_of=dt.date(2024, 1, 31))
    assert "event_date" in back._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_registered_reports_see_all_events(spark):
    e = REPORTS["r01_daily_summary"].over(lake_events(spark, SF).withColumns({"day": F.col("event_date"), "utm_source": F.col("network")}))
    assert e.agg(F.sum("events")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


# --- ingest ----------------------------------------------------------------------------------------------------------


def write_logs(folder, **files):
    folder.mkdir(exist_ok=True)
    for hour, lines in files.items():
        (folder / f"raw-20240105-{hour[1:]}.jsonl.ready").write_text("\n".join(lines))


def a_run(spark, tmp_path, **options):
    st.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), pause=0.0, **options).awaitTermination()


def all_ids(spark, tmp_path):
    return sorted(r["session_id"] for r in Source(path=str(tmp_path / "out")).events(spark).collect())


@pytest.mark.parametrize("broken", ["write_events", "write_rejects", "publish"])
def test_a_batch_that_dies_and_runs_again(spark, tmp_path, monkeypatch, broken):
    write_logs(tmp_path / "in", h10=[line({"type": "click", "sid": "a"}), "bad"], h11=[line({"type": "pv", "sid": "b"}, ts="2024-01-01T00:00:00Z"), line({"type": "pv", "sid": "c"})])
    place, whole = (published, published.publish) if broken == "publish" else (st, getattr(st, broken))

    def dies(*args, **options):
        if broken != "publish":
            whole(*args, **options)  # what is written before the end must not count twice
        raise OSError("killed")

    monkeypatch.setattr(place, broken, dies)
    with pytest.raises(Exception, match="killed"):
        a_run(spark, tmp_path, archive=str(tmp_path / "old"))
    assert len(list((tmp_path / "in").iterdir())) == 2 and published.current(spark, str(tmp_path / "out")) is None
    monkeypatch.setattr(place, broken, whole)
    for _ in range(2):
        a_run(spark, tmp_path, archive=str(tmp_path / "old"))
    assert all_ids(spark, tmp_path) == ["a", "b", "c"] and spark.read.json(str(tmp_path / "out/rejects")).count() == 1
    assert not list((tmp_path / "in").glob("*.ready")) and len(list((tmp_path / "old").glob("*.ready"))) == 2


def test_a_part_is_published_once(spark, tmp_path):
    write_logs(tmp_path / "in", h10=[line({"type": "click", "sid": "a"})])
    files = [str(p) for p in (tmp_path / "in").iterdir()]
    for _ in range(2):
        assert st.store_files(spark, files, str(tmp_path / "out"), "x") == []
    assert all_ids(spark, tmp_path) == ["a"] and not published.publish(spark, str(tmp_path / "out"), "x", ["y"])


def poisoned(lines):
    """A parser that fails on some lines."""
    return raw_logs.parse(lines.withColumn("value", F.when(F.col("value").contains("POISON"), F.raise_error(F.lit("poison"))).otherwise(F.col("value"))))


def test_files_that_fail_are_set_aside(spark, tmp_path):
    write_logs(tmp_path / "in", **{f"h{h}": [line({"type": "click", "sid": "POISON" if h in (12, 17) else str(h)})] for h in range(10, 18)})
    a_run(spark, tmp_path, parser=poisoned, archive=str(tmp_path / "old"), attempts=2)
    assert all_ids(spark, tmp_path) == ["10", "11", "13", "14", "15", "16"]
    assert sorted(p.name for p in (tmp_path / "out/quarantine").glob("*.ready")) == ["raw-20240105-12.jsonl.ready", "raw-20240105-17.jsonl.ready"]
    assert len(list((tmp_path / "old").glob("*.ready"))) == 6 and not list((tmp_path / "in").glob("*.ready"))
    (tmp_path / "in2").mkdir()
    write_logs(tmp_path / "in2", h10=[line({"sid": "POISON"})])  # nothing but a bad file: an empty part
    st.ingest(spark, str(tmp_path / "in2"), str(tmp_path / "out2"), str(tmp_path / "check2"), parser=poisoned, attempts=1, pause=0.0).awaitTermination()
    assert published.current(spark, str(tmp_path / "out2")) == [] and Source(path=str(tmp_path / "out2")).events(spark).count() == 0


def test_a_fault_that_is_not_the_files_is_raised(spark, tmp_path, monkeypatch):
    write_logs(tmp_path / "in", h10=[line({"type": "click"})])
    monkeypatch.setattr(st, "write_events", lambda *a, **k: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(Exception, match="disk full"):
        a_run(spark, tmp_path)
    assert not (tmp_path / "out/quarantine").exists()


def test_halving():
    seen = []

    def works(files):
        seen.append(len(files))
        if {3, 9} & set(files):
            raise ValueError

    assert st.failing(works, list(range(16)), attempts=2, pause=0.0) == [3, 9]
    assert max(seen) == 16 and len(seen) < 2 * 16
    tries = iter([1, 0])

    def once(files):
        if next(tries):
            raise ValueError

    assert st.failing(once, [1], attempts=2, pause=0.0) == []


def test_a_file_leaves_the_inbox_after_its_events_can_be_read(spark, tmp_path, monkeypatch):
    write_logs(tmp_path / "in", h10=[line({"type": "click", "sid": "a"})])
    whole = published.move

    def checked(session, path, target):
        assert Source(path=str(tmp_path / "out")).events(session).filter("session_id = 'a'").count() == 1
        return whole(session, path, target)

    monkeypatch.setattr(published, "move", checked)
    a_run(spark, tmp_path, archive=str(tmp_path / "old"))
    assert [p.name for p in (tmp_path / "old").glob("*.ready")] == ["raw-20240105-10.jsonl.ready"]
    write_logs(tmp_path / "in", h11=[line({"type": "click", "sid": "b"})])
    monkeypatch.setattr(st, "clear_inbox", lambda *a: None)  # a crash before the inbox is cleared
    a_run(spark, tmp_path, archive=str(tmp_path / "old"))
    monkeypatch.undo()
    write_logs(tmp_path / "in", h12=[line({"type": "click", "sid": "c"})])
    a_run(spark, tmp_path, clear=True)
    assert not list((tmp_path / "in").glob("*.ready")) and all_ids(spark, tmp_path) == ["a", "b", "c"]


def test_both_triggers(spark, tmp_path):
    write_logs(tmp_path / "in", **{f"h{h}": [line({"type": "click", "sid": str(h)})] * 5 for h in (10, 11, 12)})
    a_run(spark, tmp_path, most_bytes="1000")  # each file is larger
    assert [e["name"] for e in published.entries(spark, str(tmp_path / "out"))] == [f"batch-{i:08d}" for i in range(3)]
    query = st.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), once=False, interval="1 second", most_bytes="100000000")
    try:
        write_logs(tmp_path / "in", h13=[line({"type": "click", "sid": "13"})])
        until = time.time() + 60
        while len(all_ids(spark, tmp_path)) < 16 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert all_ids(spark, tmp_path).count("13") == 1 and len(all_ids(spark, tmp_path)) == 16


def test_arrival_layout(spark, tmp_path):
    write_logs(tmp_path / "in", h10=[line({"type": "click", "sid": "a"}, ts="2024-01-05T10:10:00Z"), line({"type": "click", "sid": "late"}, ts="2024-01-02T23:00:00Z")], h11=[line({"type": "click", "sid": "b"}, ts="2024-01-05T11:00:00Z")])
    a_run(spark, tmp_path, layout=sinks.BY_ARRIVAL)
    e = Source(path=str(tmp_path / "out")).events(spark)
    hour = e.filter("arrival_date = '20240105' and arrival_hour = 10")
    day = e.filter("event_date = date'2024-01-02'")
    assert sorted(r["session_id"] for r in hour.collect()) == ["a", "late"] and [r["session_id"] for r in day.collect()] == ["late"]
    for found, column in ((hour, "arrival_hour"), (day, "event_date")):
        filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert column in filters
    reports = Source(path=str(tmp_path / "out")).reports(spark)
    assert between(reports, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)).count() == 1


# --- compaction ------------------------------------------------------------------------------------------------------


def small_files(spark, path, parts=3, files=6):
    for i in range(parts):
        e = spark.range(30 * i, 30 * i + 30).repartition(files).selectExpr("timestamp'2024-01-04 10:00:00' as ts", "cast(id as string) as session_id", "'/' as url", "'click' as type", "date'2024-01-04' as event_date")
        e.write.partitionBy("event_date", "type").mode("overwrite").parquet(f"{path}/events/part=p{i}")
        published.publish(spark, path, f"p{i}", published.leaves(spark, path, f"p{i}"))


def test_readers_never_fail_during_compaction(spark, tmp_path):
    path = str(tmp_path)
    small_files(spark, path)
    faults, counts, over = [], [], threading.Event()

    def reads():
        while not over.is_set():
            try:
                counts.append(Source(path=path).events(spark).count())
            except Exception as error:  # noqa: BLE001
                faults.append(error)

    reader = threading.Thread(target=reads)
    reader.start()
    try:
        for _ in range(2):
            done = compaction.compact_days(spark, path, dt.date(2024, 1, 5), compaction.Policy(most_files=7, least_files=2))
            assert list(done) == ["event_date=2024-01-04/type=click"]
    finally:
        over.set()
        reader.join()
    assert not faults and set(counts) == {90}
    kept = published.current(spark, path)
    assert len(kept) == 1 and kept[0].startswith("part=compact-")
    assert published.vacuum(spark, path) == [] and len(published.vacuum(spark, path, 0)) == 4
    assert Source(path=path).events(spark).select("session_id").distinct().count() == 90


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_crash_leaves_the_old_or_the_new(spark, tmp_path, monkeypatch, when):
    path = str(tmp_path)
    small_files(spark, path)
    whole = published.publish

    def dies(*args, **more):
        if when == "after":
            whole(*args, **more)
        raise OSError("killed")

    monkeypatch.setattr(published, "publish", dies)
    assert list(compaction.compact_days(spark, path, dt.date(2024, 1, 5)).values()) == ["killed"]
    monkeypatch.undo()
    assert Source(path=path).events(spark).count() == 90
    assert len(published.current(spark, path)) == (1 if when == "after" else 3)
    if when == "before":
        assert compaction.compact(spark, path, "event_date=2024-01-04/type=click") and len(published.current(spark, path)) == 1
    assert not compaction.compact(spark, path, "event_date=2024-01-04/type=click")


def test_a_copy_with_other_rows_is_not_taken(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    small_files(spark, path)
    monkeypatch.setattr(compaction.uuid, "uuid4", lambda: type("U", (), {"hex": "0"}))
    spark.range(1).selectExpr("'x' as session_id").write.parquet(f"{path}/events/part=compact-0/event_date=2024-01-04/type=click")
    done = compaction.compact_days(spark, path, dt.date(2024, 1, 5))
    assert "other rows" in next(iter(done.values())) and Source(path=path).events(spark).count() == 90


def test_a_lake_without_a_log(spark, tmp_path):
    path = str(tmp_path)
    e = lake_events(spark, SF).filter("day(ts) = 4")
    for _ in range(3):
        sinks.write_events(e, path)
    count = Source(path=path).events(spark).count()
    done = compaction.compact_days(spark, path, dt.date(2024, 1, 5), compaction.Policy(least_files=2))
    assert set(done.values()) == {True} and Source(path=path).events(spark).count() == count == 3 * e.count()
    log = published.entries(spark, path)
    assert log[0]["name"] == "adopted" and json.dumps(log)
