"""Raw request logs: one JSON object a line, parsed into events, with what cannot be parsed set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.maps import query_map, scalars
from ..functions.normalize import normalized
from ..schema import event_type

LINE = "ts string, method string, path string, headers struct<user_agent:string,referer:string,x_forwarded_for:string,x_real_ip:string>, query_params string, body string, client_ip string"
#: Hosts (parts of) and their referrer networks, in order of precedence; fixed values.
REFERRERS = (("google", "google"), ("facebook", "facebook"), ("fb.com", "facebook"), ("twitter", "twitter"), ("x.com", "twitter"), ("linkedin", "linkedin"), ("taboola", "taboola"), ("outbrain", "outbrain"), ("mgid", "mgid"), ("revcontent", "revcontent"))
IDS = {"session_id": ("sid", "session_id"), "user_id": ("uid", "user_id"), "cookie_id": ("cid", "cookie_id")}


def read_lines(spark: SparkSession, path: str, streaming: bool = False, per_batch: int = 1000, most_bytes: str | None = None, most_age: str | None = None) -> DataFrame:
    """Lines of finished log files with the file they come from. A stream's batches are bounded by bytes, if given, else by files."""
    reader = spark.read
    if streaming:
        reader = spark.readStream.option("maxBytesPerTrigger", most_bytes) if most_bytes else spark.readStream.option("maxFilesPerTrigger", per_batch)
        reader = reader.option("maxFileAge", most_age) if most_age else reader
    return reader.format("text").option("pathGlobFilter", "raw-*.jsonl.ready").load(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))


def of_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines of some log files with the file they come from."""
    return spark.read.text(files).select("value", F.col("_metadata.file_name").alias("file"))


def referrer_network(referrer: Column) -> Column:
    host = F.lower(F.try_parse_url(referrer, F.lit("HOST")))
    return F.coalesce(*[F.when(host.contains(part), name) for part, name in REFERRERS])


def client_ip(line: Column) -> Column:
    first_hop = lambda c: F.nullif(F.trim(F.split(c, ",")[0]), F.lit(""))
    return F.coalesce(F.nullif(F.trim(line["client_ip"]), F.lit("")), first_hop(line["headers"]["x_forwarded_for"]), first_hop(line["headers"]["x_real_ip"]))


#: A full date and time with an offset.
RFC_3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse(lines: DataFrame) -> DataFrame:
    """Events from lines (value, file), with `error` for those that are rejected.

    The body (POST) or the query (GET) gives the parameters; nested `params` of a body are taken in one level deep. The
    arrival hour comes from the file's name, the event date from its timestamp.
    """
    line = F.col("line")
    e = lines.withColumn("line", F.from_json("value", LINE, {"mode": "PERMISSIVE"}))
    e = e.withColumns({"ts": F.when(line["ts"].rlike(RFC_3339), F.try_to_timestamp(line["ts"])), "post": F.upper(line["method"]) == "POST"})
    body = F.when(F.col("post"), line["body"])
    e = e.withColumns({"query": query_map(line["query_params"]), "own": scalars(body), "nested": scalars(F.get_json_object(body, "$.params"))})
    error = F.when(line.isNull() | line["ts"].isNull(), "not a request").when(F.col("ts").isNull(), "bad timestamp").when(F.col("post") & F.from_json(line["body"], "map<string,string>").isNull(), "bad body")
    # the outer object wins over nested params
    names = F.map_keys(F.col("own"))
    both = F.map_concat("own", F.map_filter("nested", lambda k, v: ~F.array_contains(names, k)))
    e = e.withColumn("params", F.when(F.col("post"), both).otherwise(F.col("query"))).withColumn("error", error)
    p = lambda *keys: F.coalesce(*[F.try_element_at("params", F.lit(k)) for k in keys])
    referrer = line["headers"]["referer"]
    e = e.select(
        "value", "file", "error", "ts", client_ip(line).alias("ip"), line["headers"]["user_agent"].alias("ua"), F.coalesce(p("url"), F.split(line["path"], r"\?")[0], F.lit("")).alias("url"),
        event_type(p("type")).alias("type"), p("type").alias("type_raw"), *[p(*keys).alias(n) for n, keys in IDS.items()], referrer.alias("referrer"), referrer_network(referrer).alias("referrer_network"),
        p("dwell", "dwell_time").try_cast("bigint").alias("dwell_time_ms"), F.map_filter("params", lambda k, v: ~k.isin("type", *[x for keys in IDS.values() for x in keys])).alias("params"),
        F.to_date("ts").alias("event_date"), F.regexp_extract("file", r"raw-(\d{8})-(\d{2})", 1).alias("arrival_date"), F.regexp_extract("file", r"raw-(\d{8})-(\d{2})", 2).alias("arrival_hour"),
    )
    return normalized(e)


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and rejected lines (value, file, error)."""
    return parsed.filter("error is null").drop("value", "error"), parsed.filter("error is not null").select("value", "file", "error")
