"""Small files of a partition into few large ones, without a moment in which readers miss anything."""

from __future__ import annotations

import datetime as dt
import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..sources import published


@dataclass(frozen=True)
class Policy:
    target_bytes: int = 512 << 20
    small_bytes: int = 64 << 20
    least_files: int = 10
    most_files: int = 1000  # that one job reads
    most_rows: int = 1_000_000  # of a file
    lookback_days: int = 7


def partition_of(leaf: str) -> str:
    """A leaf folder without the part that wrote it: event_date=.../type=..."""
    return "/".join(x for x in leaf.split("/") if not x.startswith("part="))


def compact(spark: SparkSession, root: str, partition: str, policy: Policy = Policy()) -> bool:
    """Rewrite a partition (event_date=.../type=...) if it has enough small files.

    The files are read in jobs of at most `most_files` and written into a folder of their own, with whatever columns they have. The rows of both are
    counted; then one log entry adds the new folder and removes the old ones. A crash before leaves the old ones, a crash after it the new one;
    the old files go with `vacuum`.
    """
    published.adopt(spark, root)
    base = f"{root}/{published.EVENTS}"
    old = [x for x in published.current(spark, root) if partition_of(x) == partition]
    files = [(f"{base}/{leaf}/{name}", size) for leaf in old for name, size in published.files_below(spark, f"{base}/{leaf}") if "/" not in name]
    if sum(size < policy.small_bytes for _, size in files) < policy.least_files:
        return False
    part = f"compact-{uuid.uuid4().hex}"
    new = f"part={part}/{partition}"
    read = lambda paths: spark.read.option("mergeSchema", "true").parquet(*paths)
    for a in range(0, len(files), policy.most_files):
        job = files[a : a + policy.most_files]
        rows = read([path for path, _ in job]).repartition(max(1, -(-sum(size for _, size in job) // policy.target_bytes)))
        rows.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", policy.most_rows).parquet(f"{base}/{new}")
    before = sum(read([path for path, _ in files[a : a + policy.most_files]]).count() for a in range(0, len(files), policy.most_files))
    if read([f"{base}/{new}"]).count() != before:
        published.delete(spark, f"{base}/part={part}")
        raise RuntimeError(f"the compacted copy of {partition} has other rows")
    return published.publish(spark, root, part, [new], old)


def compact_days(spark: SparkSession, root: str, as_of: dt.date, policy: Policy = Policy()) -> dict[str, bool | str]:
    """Compact the partitions of the last days; one that fails does not stop the others."""
    published.adopt(spark, root)
    days = {f"event_date={as_of - dt.timedelta(days=back + 1)}" for back in range(policy.lookback_days)}
    of_day: dict[str, list[str]] = defaultdict(list)
    for leaf in published.current(spark, root):
        if days & set(leaf.split("/")):
            of_day[partition_of(leaf)].append(leaf)
    done: dict[str, bool | str] = {}
    for partition in sorted(of_day):
        try:
            done[partition] = compact(spark, root, partition, policy)
        except Exception as error:  # noqa: BLE001  reported to the caller
            done[partition] = str(error)
    return done
