"""Where events are read from: partitioned Parquet, a compacted copy, enriched JSON lines, or a catalog table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from ..schema import EVENTS, EXTRA, compatible, evolved
from . import published


@dataclass(frozen=True)
class Source:
    """A catalog table, if both catalog and warehouse are set, else Parquet below a folder."""

    path: str | None = None
    catalog: str | None = None
    warehouse: str | None = None
    table: str = "ad_events"

    def events(self, spark: SparkSession) -> DataFrame:
        """All events with today's columns; files of older versions are read along with newer ones."""
        return compatible(self.raw(spark))

    def raw(self, spark: SparkSession) -> DataFrame:
        """The events with the columns that the files have."""
        if self.catalog and self.warehouse:
            return spark.table(f"{self.catalog}.{self.table}")
        return _files(spark, self.path, spark.read.option("mergeSchema", "true"))

    def dimension(self, spark: SparkSession, name: str, e: DataFrame | None = None) -> DataFrame:
        """`campaigns` or `creatives`: the catalog's table, or what the events show."""
        if self.catalog and self.warehouse and spark.catalog.tableExists(f"{self.catalog}.{name}"):
            return spark.table(f"{self.catalog}.{name}")
        return {"campaigns": campaigns, "creatives": creatives}[name](self.events(spark) if e is None else e)

    def reports(self, spark: SparkSession) -> DataFrame:
        """The events with the columns that reports use. The schema is given, so that no file is opened to find it; values stay null where files lack them."""
        if self.catalog and self.warehouse:
            return report_view(evolved(spark.table(f"{self.catalog}.{self.table}")))
        return report_view(_files(spark, self.path, spark.read.schema(LAKE)))

    def register(self, spark: SparkSession, name: str = "events") -> DataFrame:
        """The events as a temporary view for SQL, too."""
        e = self.events(spark)
        e.createOrReplaceTempView(name)
        return e


LAKE = T.StructType([*EVENTS.fields, *[T.StructField(n, t) for n, t in EXTRA], T.StructField("type_raw", T.StringType()), T.StructField("event_date", T.DateType())])


def _files(spark: SparkSession, path: str, reader: DataFrameReader) -> DataFrame:
    """The published folders of a lake; one without a log is read as it lies."""
    folders = published.current(spark, path)
    if folders is None:
        return reader.parquet(f"{path}/events")
    if not folders:
        return spark.createDataFrame([], LAKE)
    return reader.option("basePath", f"{path}/events").parquet(*[f"{path}/events/{x}" for x in folders]).drop("part")


#: Report columns that stand in the open parameters, and their types.
FROM_PARAMS = {
    **dict.fromkeys(("utm_source", "utm_medium", "tb_headline", "tb_image", "ob_creative"), "string"),
    "revenue": "decimal(18,2)",
}


def report_view(lake: DataFrame) -> DataFrame:
    """The report columns over lake events: `day`, and what stands in the parameters. A range of days reaches the partitions, and one of `ts` the files."""
    have = set(lake.columns)
    day = F.col("event_date") if "event_date" in have else F.to_date("ts")
    more = [F.try_element_at("params", F.lit(n)).try_cast(t).alias(n) for n, t in FROM_PARAMS.items() if n not in have]
    return lake.select("*", day.alias("day"), *more)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped JSON lines of structured events; lines that do not parse are kept in `_corrupt_record`."""
    schema = T.StructType([*EVENTS.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("pathGlobFilter", "events-*.jsonl.gz").json(path)


def campaigns(e: DataFrame) -> DataFrame:
    """The campaign dimension as the events show it."""
    return e.select("campaign_id", "campaign_name", "network").filter("campaign_id is not null").distinct()


def creatives(e: DataFrame) -> DataFrame:
    """The creative dimension as the events show it."""
    return e.select("creative_id", "headline", "image_id", "network").filter("creative_id is not null").distinct()


def hierarchy_names(files: DataFrame, column: str = "file") -> DataFrame:
    """Network and account from names like network-account.json, split at the first dash."""
    stem = F.regexp_replace(F.element_at(F.split(column, "/"), -1), r"\.json$", "")
    return files.withColumns({"network": F.split(stem, "-", 2)[0], "account_id": F.try_element_at(F.split(stem, "-", 2), F.lit(2))})
