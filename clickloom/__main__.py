"""python -m clickloom list | run NAME | daily | schedule | query SQL | archive FOLDER | migrate ...: reports over a lake or over the tables of a folder."""

from __future__ import annotations

import argparse
import datetime as dt
import time

from pyspark.sql import SparkSession

from .plans.catalog import REPORTS
from .plans.migrations import Migrations, from_folder
from .plans.named_views import over
from .sources.events import events
from .sources.lake import Source
from .sources.sinks import archived_reports, write_report


def _dates(name: str) -> set[str]:
    """The dates that a report takes."""
    return {"start", "end"} if REPORTS[name].ranged else {"as_of"} if REPORTS[name].looks_back else set()


def next_run(now: dt.datetime, at: dt.time) -> dt.datetime:
    """The next time of day `at` after now."""
    today = dt.datetime.combine(now.date(), at)
    return today if today > now else today + dt.timedelta(days=1)


def parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="clickloom")
    where = parser.add_argument_group("where the events are; one of them for all commands that read events")
    where.add_argument("--tables", help="folder of example tables")
    where.add_argument("--lake", help="folder of a lake")
    where.add_argument("--catalog", help="catalog and schema of a table of events (with --warehouse)")
    where.add_argument("--warehouse")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="all reports with category and description")
    run = commands.add_parser("run", help="one report")
    run.add_argument("name")
    daily = commands.add_parser("daily", help="all reports for a day, today if none is given")
    schedule = commands.add_parser("schedule", help="`daily` at a time of each day")
    schedule.add_argument("--at", type=dt.time.fromisoformat, default=dt.time(2), help="UTC")
    schedule.add_argument("--runs", type=int, help="end after so many")
    for command in (run, daily, schedule):
        command.add_argument("--format", choices=("json", "csv", "both"), default="json")
        command.add_argument("--output")
        command.add_argument("--archive", action="store_true", help="keep each run by name, date and time below --output")
        if command is not schedule:
            command.add_argument("--start", type=dt.datetime.fromisoformat)
            command.add_argument("--end", type=dt.datetime.fromisoformat, help="of reports over a range")
            command.add_argument("--as-of", type=dt.date.fromisoformat, help="the day that all other reports look back from")
    query = commands.add_parser("query", help="SQL over the events, the dimensions and all views by name")
    query.add_argument("sql")
    archive = commands.add_parser("archive", help="what an archive of reports holds")
    archive.add_argument("folder")
    archive.add_argument("--latest", action="store_true", help="the last run of each day")
    migrate = commands.add_parser("migrate", help="schema migrations of a folder")
    migrate.add_argument("--files", required=True, help="folder of V001__name.sql and V001__name.rollback.sql")
    migrate.add_argument("--ledger", required=True)
    actions = migrate.add_subparsers(dest="action", required=True)
    for name in ("status", "apply-all"):
        actions.add_parser(name)
    dry = actions.add_parser("dry-run")
    dry.add_argument("version", type=int, nargs="?")
    for name in ("apply", "rollback"):
        actions.add_parser(name).add_argument("version", type=int, help="the version to be at afterwards" if name == "rollback" else None)
    return parser


def migrate(spark: SparkSession, a: argparse.Namespace) -> int:
    m = Migrations(spark, a.ledger, from_folder(spark, a.files))
    try:
        if a.action == "status":
            print(f"at V{m.current():03d}")
            for r in m.ledger().orderBy("version").collect():
                print(f"applied V{r['version']:03d} {r['description']} {r['checksum']}" + " (its file has changed)" * (r["version"] in m.changed()))
            for x in m.pending():
                print(f"pending V{x.version:03d} {x.description} {x.checksum}")
        elif a.action == "dry-run":
            for step, x in m.plan(a.version):
                print(f"would {step} V{x.version:03d} {x.description}")
        else:
            if a.action == "apply" and a.version <= m.current() or a.action == "rollback" and a.version >= m.current():
                raise ValueError(f"V{m.current():03d} is applied already" if a.action == "apply" else f"V{m.current():03d} is not above V{a.version:03d}")
            for step, version in m.go(getattr(a, "version", None)):
                print(f"{step} V{version:03d}: done")
    except ValueError as error:
        print(f"error: {error}")
        return 1
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    if a.command == "list":
        for name, report in REPORTS.items():
            print(f"{name}\t{report.category}\t{report.description}")
        return 0
    if a.command in ("run", "daily", "schedule") and (a.format == "both" or a.archive) and not a.output:
        p.error("both formats and an archive need --output")
    reads = a.command in ("run", "daily", "schedule", "query")
    if reads and sum(map(bool, (a.tables, a.lake, a.catalog and a.warehouse))) != 1:
        p.error("one of --tables, --lake, or --catalog with --warehouse is needed")
    if a.command == "run" and a.name not in REPORTS:
        p.error(f"no report {a.name!r}; see list")
    given = {k: v for k in ("start", "end", "as_of") if (v := getattr(a, k, None))}
    if a.command == "run" and (wrong := set(given) - _dates(a.name)):
        p.error(f"{a.name} does not take {', '.join(sorted(wrong))}")
    spark = spark or SparkSession.builder.appName("clickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "migrate":
        return migrate(spark, a)
    if a.command == "archive":
        archived_reports(spark, a.folder, latest=a.latest).orderBy("name", "run", "kind").show(1000, truncate=False)
        return 0
    source = Source(path=a.lake, catalog=a.catalog, warehouse=a.warehouse)
    if a.command == "query":
        if a.tables:
            events(spark, a.tables).createOrReplaceTempView("events")
        else:
            over(spark, source).rebuild()
        spark.sql(a.sql).show(1000, truncate=False)
        return 0

    def report(names: list[str], given: dict) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        day = given.get("as_of") or now.date()
        e = events(spark, a.tables) if a.tables else source.reports(spark)
        for name in names:
            dates = {k: v for k, v in {"as_of": day, **given}.items() if k in _dates(name)}
            found = REPORTS[name].over(e, **dates)
            if a.output:
                kinds = ("json", "csv") if a.format == "both" else (a.format,)
                print(*write_report(found, a.output, name, day, kinds, at=now if a.archive else None), sep="\n", flush=True)
            else:
                found.show(1000, truncate=False)

    if a.command != "schedule":
        report([a.name] if a.command == "run" else list(REPORTS), given)
        return 0
    runs = 0
    while a.runs is None or runs < a.runs:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        time.sleep((next_run(now, a.at) - now).total_seconds())
        report(list(REPORTS), {})
        runs += 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
