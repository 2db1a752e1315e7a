"""Keyed registries in files: creatives, daily metrics, and account hierarchies."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.dimensions import CREATIVE_KEY, upserted
from . import published
from .lake import hierarchy_names

ROWS = "rows"


def read_metrics(spark: SparkSession, path: str, days: list[dt.date]) -> tuple[DataFrame, list[dt.date]]:
    """The metric registry's rows of some days, and the days that it has nothing of. Only the folders of those days are listed and read."""
    of = lambda day: f"{path}/metrics/date={day.isoformat()}"
    found = [day for day in sorted(set(days)) if published.is_there(spark, of(day))]
    missing = sorted(set(days) - set(found))
    if found:
        return spark.read.option("basePath", f"{path}/metrics").option("mergeSchema", "true").parquet(*map(of, found)), missing
    whole = published.is_there(spark, f"{path}/metrics") and published.files_below(spark, f"{path}/metrics")
    return (spark.read.parquet(f"{path}/metrics").limit(0) if whole else spark.createDataFrame([], T.StructType([T.StructField("date", T.DateType())]))), missing


def with_missing_days(spark: SparkSession, metrics: DataFrame, missing: list[dt.date]) -> DataFrame:
    """The rows with `is_missing`, and a row of nulls for each day without any."""
    days = spark.createDataFrame([(d,) for d in missing], "date date").withColumn("is_missing", F.lit(True))
    return metrics.withColumn("is_missing", F.lit(False)).unionByName(days, allowMissingColumns=True)


def read_creatives(spark: SparkSession, path: str) -> DataFrame | None:
    """The creative registry; None if there is none yet."""
    root = f"{path}/creatives"
    folders = published.current(spark, root)
    if not folders:
        return None
    return spark.read.option("basePath", f"{root}/{ROWS}").option("mergeSchema", "true").parquet(*[f"{root}/{ROWS}/{x}" for x in folders]).drop("part")


def merge_creatives(spark: SparkSession, path: str, new: DataFrame, keys: tuple[str, ...] = CREATIVE_KEY, at: str = "synced_at") -> list[str]:
    """Take rows into the creative registry: the latest row of each key stays. The networks whose files were written.

    The registry is kept by network (the first key). A network without a changed row is not written; the others get a
    new folder that replaces the old one in one log entry, so readers see all of a merge or nothing.
    """
    root, network = f"{path}/creatives", keys[0]
    known = read_creatives(spark, path)
    latest = upserted(new.limit(0), new, keys, at)
    if known is None:
        changed, merged = None, latest
    else:
        merged = upserted(known, new, keys, at)
        columns = [c for c in merged.columns if c != network]
        digest = lambda df: df.select(network, F.xxhash64(*[F.col(c) if c in df.columns else F.lit(None) for c in columns]).alias("h"))
        beside = digest(merged).withColumn("n", F.lit(1)).unionByName(digest(known).withColumn("n", F.lit(-1)))
        changes = beside.groupBy(network, "h").agg(F.sum("n").alias("n")).filter("n <> 0").select(network).distinct()
        changed = [r[0] for r in changes.collect()]  # networks: as many as there are partitions
        if not changed:
            return []
        merged = merged.filter(F.col(network).isin([c for c in changed if c is not None]) | (F.col(network).isNull() if None in changed else F.lit(False)))
    part = f"merge-{uuid.uuid4().hex}"
    merged.hint("rebalance", network).write.mode("overwrite").partitionBy(network).parquet(f"{root}/{ROWS}/part={part}")
    added = published.leaves(spark, root, part, ROWS)
    own = {x.split("/", 1)[1] for x in added}
    removed = [x for x in published.current(spark, root) or [] if x.split("/", 1)[1] in own]
    published.publish(spark, root, part, added, removed)
    return sorted(x.split("=", 1)[1] for x in own)


def write_hierarchies(spark: SparkSession, path: str, hierarchies: DataFrame) -> list[str]:
    """One JSON file for each network and account, network-account.json, the last row of each; the names of those that changed. One account's tree at a time passes the driver."""
    rows = hierarchies.select("network", "account_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("tree")).dropDuplicates(["network", "account_id"])
    written = []
    for r in rows.orderBy("network", "account_id").toLocalIterator():
        name = f"{r['network']}-{r['account_id']}.json"
        target, text = f"{path}/hierarchies/{name}", json.dumps(json.loads(r["tree"]), indent=2, sort_keys=True)
        if not published.is_there(spark, target) or published.read_text(spark, target) != text:
            published.write_text(spark, target, text)
            written.append(name)
    return written


def read_hierarchies(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """All account hierarchies (JSON over several lines) with network and account from the files' names."""
    reader = spark.read.option("multiLine", "true").option("pathGlobFilter", "*-*.json")
    trees = (reader.schema(schema) if schema else reader).json(f"{path}/hierarchies").withColumn("file", F.col("_metadata.file_name"))
    return hierarchy_names(trees.drop("network", "account_id"))
