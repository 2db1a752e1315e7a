"""Streams: raw logs into the event lake, and live counts and sessions."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.metrics import is_type, n_if
from ..sources import published
from ..sources.raw_logs import of_files, parse, read_lines, split
from ..sources.sinks import BY_EVENT, write_events, write_rejects


def failing(works: Callable[[list[str]], None], files: list[str], attempts: int = 3, pause: float = 1.0) -> list[str]:
    """The files that cannot be processed, found by halving; one that fails alone is tried again before it counts."""
    for attempt in range(attempts if len(files) == 1 else 1):
        try:
            works(files)
            return []
        except Exception:  # noqa: BLE001  any failure counts
            if len(files) == 1 and attempt + 1 < attempts:
                time.sleep(pause * 2**attempt)
    if len(files) == 1:
        return files
    half = len(files) // 2
    return failing(works, files[:half], attempts, pause) + failing(works, files[half:], attempts, pause)


def store_files(spark: SparkSession, files: list[str], target: str, name: str, parser: Callable[[DataFrame], DataFrame] = parse, layout: tuple[str, ...] = BY_EVENT, attempts: int = 3, pause: float = 1.0) -> list[str]:
    """Events and rejects of some log files as part `name` of a lake, published at once and only once; the files that were set aside.

    If the part is published already, nothing is written. Files that cannot be processed move to `target`/quarantine; if all files can be, the fault is not theirs and is raised.
    """
    if published.is_published(spark, target, name):
        return []

    def works(some: list[str]) -> None:
        parser(of_files(spark, some)).write.format("noop").mode("overwrite").save()

    def store(some: list[str]) -> None:
        good, bad = split(parser(of_files(spark, some)))
        write_events(good, target, part=name, layout=layout)
        write_rejects(bad, target, part=name)

    aside: list[str] = []
    try:
        store(files)
    except Exception:
        aside = failing(works, files, attempts, pause)
        if not aside:
            raise
        rest = [f for f in files if f not in aside]
        published.delete(spark, f"{target}/{published.EVENTS}/part={name}")
        if rest:
            store(rest)
    published.publish(spark, target, name, published.leaves(spark, target, name), files=files, aside=aside)
    return aside


def clear_inbox(spark: SparkSession, target: str, archive: str | None, names: list[str] | None = None) -> list[str]:
    """Move the log files of published parts out of the inbox: those set aside to quarantine, the others to the archive (or delete them)."""
    moved = []
    for e in published.entries(spark, target):
        if names is None or e["name"] in names:
            for f in e.get("files", ()):
                stem = f.rpartition("/")[2]
                if f in e.get("aside", ()):
                    done = published.move(spark, f, f"{target}/quarantine/{stem}")
                elif archive:
                    done = published.move(spark, f, f"{archive}/{stem}")
                else:
                    done = published.is_there(spark, f)
                    published.delete(spark, f)
                if done:
                    moved.append(f)
    return moved


def ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True, interval: str = "300 seconds", per_batch: int = 1000, most_bytes: str | None = None, most_age: str | None = None,
    archive: str | None = None, clear: bool = False, parser: Callable[[DataFrame], DataFrame] = parse, layout: tuple[str, ...] = BY_EVENT, attempts: int = 3, pause: float = 1.0,
) -> StreamingQuery:
    """Parse finished log files into a lake; each file is read once (the checkpoint knows them), late events go to their own date.

    A batch begins when `interval` has passed, and takes at most `per_batch` files, or `most_bytes` if given (one file at least); what is over goes into
    the next batch at once. Files older than `most_age` beside the newest one are not picked up any more. Each batch is a part of its own
    that is published when all of it is there, so a batch that runs again changes nothing. With `archive` (or `clear`), log files
    leave the inbox after their part is published; those that a crash left there go with the first batch of the next run. Files without a line stay.
    """

    first: list[int] = []  # the first batch of this run sweeps up after those before

    def store(batch: DataFrame, number: int) -> None:
        first.append(number)
        name = f"batch-{number:08d}"
        files = sorted(unquote(r["path"]) for r in batch.select("path").distinct().collect())  # at most those of a batch
        if files:
            store_files(spark, files, target, name, parser, layout, attempts, pause)
        if archive or clear:
            clear_inbox(spark, target, archive, None if number in (0, first[0]) else [name])

    stream = read_lines(spark, source, streaming=True, per_batch=per_batch, most_bytes=most_bytes, most_age=most_age).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=interval)).start()


def live_traffic(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, clicks and views of each window and type of network, behind a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", window).alias("w"), "network").agg(F.count("*").alias("events"), n_if(is_type("pageview")).alias("views"), n_if(is_type("click")).alias("clicks"))
    return g.select(F.col("w.start").alias("start"), "network", "events", "views", "clicks")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
