"""Writers for events, rejected lines, reports and registries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import evolved, sanitized
from .published import files_below


#: Partitions by what happened, and by when its log arrived with the event date beside it.
BY_EVENT = ("event_date", "type")
BY_ARRIVAL = ("arrival_date", "arrival_hour", "event_date")


def write_events(events: DataFrame, path: str, mode: str = "append", part: str | None = None, layout: tuple[str, ...] = BY_EVENT) -> None:
    """Events as zstd Parquet below `path`/events, partitioned by `layout`; values out of range as null.

    With a `part`, they replace that part of the lake and count when it is published. Rows are brought together by partition first, so that a task writes few files; adaptive execution splits large dates.
    """
    e = sanitized(evolved(events))
    if "event_date" not in e.columns:
        e = e.withColumn("event_date", F.to_date("ts"))
    target = f"{path}/events/part={part}" if part else f"{path}/events"
    e.hint("rebalance", *layout).write.mode("overwrite" if part else mode).option("compression", "zstd").partitionBy(*layout).parquet(target)


def write_rejects(rejects: DataFrame, path: str, part: str | None = None) -> None:
    """Rejected lines as JSON; with a `part`, a folder of its own that is written anew if the part is."""
    rejects.withColumn("rejected_at", F.current_timestamp()).write.mode("overwrite" if part else "append").json(f"{path}/rejects/part={part}" if part else f"{path}/rejects")


def report_path(folder: str, name: str, kind: str, day: dt.date) -> str:
    return f"{folder.rstrip('/')}/{day.isoformat()}_{name}.{kind}"


def archive_path(folder: str, name: str, kind: str, at: dt.datetime) -> str:
    """A run of a report by name, date and time: NAME/2024-01-31/20240131T020000Z.json."""
    return f"{folder.rstrip('/')}/{name}/{at.date().isoformat()}/{at:%Y%m%dT%H%M%SZ}.{kind}"


def archived_reports(spark: SparkSession, folder: str, name: str | None = None, latest: bool = False) -> DataFrame:
    """What an archive holds, by its folders alone: name, date, run, kind, path, files and bytes; with `latest`, the last run of each day and kind."""
    found: dict[str, list[int]] = {}
    for path, size in files_below(spark, folder):
        parts = path.split("/")
        if len(parts) >= 3 and "." in parts[2] and name in (None, parts[0]):
            found.setdefault("/".join(parts[:3]), []).append(size)
    rows = []
    for path, sizes in found.items():
        report, date, run = path.split("/")
        try:
            at = dt.datetime.strptime(run.partition(".")[0], "%Y%m%dT%H%M%SZ")
            rows.append((report, dt.date.fromisoformat(date), at.isoformat(), run.partition(".")[2], f"{folder.rstrip('/')}/{path}", len(sizes), sum(sizes)))
        except ValueError:  # not a report
            continue
    table = spark.createDataFrame(rows, "name string, date date, run string, kind string, path string, files long, bytes long")
    if latest:
        columns = table.columns
        table = table.groupBy("name", "date", "kind").agg(F.max_by(F.struct(*columns), "run").alias("r")).select("r.*")
    return table


def write_report(report: DataFrame, folder: str, name: str, day: dt.date, kinds: tuple[str, ...] = ("json",), at: dt.datetime | None = None) -> list[str]:
    """A report as JSON rows or as CSV with a header and NULL for nulls; values keep their types. With `at`, it goes into the archive of that time."""
    paths = []
    for kind in kinds:
        path = archive_path(folder, name, kind, at) if at else report_path(folder, name, kind, day)
        if kind == "json":
            report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        elif kind == "csv":
            flat = report.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in report.dtypes])
            flat.write.mode("overwrite").options(header=True, quote='"', escape='"', nullValue="NULL").csv(path)
        else:
            raise ValueError(f"no such format: {kind}")
        paths.append(path)
    return paths


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The metric registry: one partition for each date, of which only those in the table are replaced."""
    day = F.to_date(F.col("date").cast("string"), "yyyyMMdd") if dict(metrics.dtypes)["date"] == "int" else F.col("date")
    metrics.withColumn("date", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{path}/metrics")
