"""Queries that write files to the shared checkpoint folder with Spark and read them back: sources by extension, and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import render as R
from checks import sanitize_sql as Q
from checks.queries import RANKED, TRACED, _all, _records, _secret_lines, query
from emberlog.operators.records import records_from_files
from emberlog.plans.sanitize import sanitize
from emberlog.session import configure, ensure_checkpoint_dir
from emberlog.sources.sinks import read_texts, write_analysis, write_sanitized, write_texts
from emberlog.sources.text import file_lines


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _trace_files(spark: SparkSession, sf_dir: str) -> str:
    """Every event's lines as log files, a folder for each event type, beside files whose extension is none of a log."""
    path = _folder(spark, "logs")
    text = F.array_join(R.traced_lines(), "\n")
    events = R.events(spark, sf_dir).select("event_type", text.alias("value"))
    events.write.partitionBy("event_type").text(f"{path}/logs")
    events.select("value").write.csv(f"{path}/other")
    return path


@query(
    "files_records",
    f"SELECT raw, event_type, CASE event_type WHEN 'error' THEN 4 ELSE 1 END AS n_lines, count(*) AS n FROM ({TRACED}) GROUP BY ALL",
)
def files_records(spark, sf_dir):
    """Log files by extension, cut into records; the folder a file stands in is its event type."""
    configure(spark)
    records = records_from_files(file_lines(spark, _trace_files(spark, sf_dir)))
    kind = F.regexp_extract("scope", "event_type=([^/]+)/", 1)
    return records.groupBy("raw", kind.alias("event_type"), "n_lines").agg(F.count("*").alias("n"))


@query("files_analysis", f"SELECT rank, pattern, n, level, service, source_type, classification, least(n, 3) AS n_examples FROM ({RANKED}) WHERE rank <= 50")
def files_analysis(spark, sf_dir):
    """The written analysis, read back."""
    path = _folder(spark, "analysis")
    write_analysis(_records(spark, sf_dir), path, max_groups=50)
    groups = spark.read.parquet(f"{path}/groups")
    return groups.select("rank", "pattern", F.col("count").alias("n"), "level", "service", "source_type", "classification", F.size("examples").cast("long").alias("n_examples"))


@query("files_sanitized", f"SELECT sanitized AS line, count(*) AS n FROM ({Q.expected_line('text', 'hash')}) GROUP BY 1")
def files_sanitized(spark, sf_dir):
    """The written safe text, read back as log files."""
    path = _folder(spark, "safe")
    write_sanitized(sanitize(_secret_lines(spark, sf_dir, "text"), "hash"), f"{path}/text", report=f"{path}/report")
    return file_lines(spark, f"{path}/text").groupBy("line").agg(F.count("*").alias("n"))


@query(
    "files_report",
    f"SELECT category, n, (SELECT total_matches FROM ({Q.SUMMARY}))::BIGINT AS total_matches, "
    f"(SELECT count(*) FROM ({Q.EXAMPLES}) e WHERE e.category = c.category) AS n_examples FROM ({Q.CATEGORIES}) c",
)
def files_report(spark, sf_dir):
    """The written report of a sanitising run: counts, totals and examples."""
    path = _folder(spark, "safe")
    write_sanitized(sanitize(_secret_lines(spark, sf_dir, "logfmt"), "mask", False), f"{path}/text", report=f"{path}/report")
    examples = spark.read.parquet(f"{path}/report/examples").groupBy("category").agg(F.count("*").alias("n_examples"))
    totals = spark.read.parquet(f"{path}/report/summary").select("scope", "total_matches")
    return spark.read.parquet(f"{path}/report/categories").join(totals, "scope").join(examples, "category").drop("scope")


@query(
    "files_texts",
    f"SELECT sanitized AS line, (sum(octet_length(encode(sanitized)) + 1) OVER (ORDER BY event_id) - octet_length(encode(sanitized)) - 1)::BIGINT AS at "
    f"FROM ({Q.expected_line('text', 'mask')})",
)
def files_texts(spark, sf_dir):
    """One text of the whole table, written as parts: every line and the byte of the text it begins at."""
    path = _folder(spark, "texts")
    write_texts(sanitize(_secret_lines(spark, sf_dir, "text"), "mask", False).lines, path, part_chars=50_000)
    lines = read_texts(spark, path).select("part", "offset", F.posexplode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("k", "line"))
    through = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("part").orderBy("k"))
    return lines.select("line", (F.col("offset") + through - F.octet_length("line") - 1).alias("at"))


def _long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line of a list for each thousand events."""
    e = F.expr
    item = F.concat(F.lit('{"ip":"'), e(Q.IP), F.lit('","note":["'), e(Q.EMAIL), F.lit('",'), e(Q.EVENT), F.lit("]}"))
    events = R.events(spark, sf_dir).withColumn("pos", F.floor(F.col("event_id") / 1000))
    # A line takes as long as its events: as many tasks as hold the events, whatever the bytes.
    lists = events.repartition(events.rdd.getNumPartitions(), "pos").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("items"))
    line = F.concat(F.lit('{"email":['), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]}"))
    return lists.select(_all().alias("scope"), "pos", line.alias("line"))


@query(
    "sanitize_long_lines",
    f"SELECT event_id // 1000 AS pos, '{{\"email\":[' || string_agg('{{\"ip\":\"<IP_ADDRESS>\",\"note\":[\"<EMAIL>\",' || {Q.EVENT} || ']}}', ',' ORDER BY event_id) "
    "|| ']}' AS sanitized, 2 * count(*) AS n_matches FROM events GROUP BY 1",
)
def sanitize_long_lines(spark, sf_dir):
    """Lists of a thousand objects on one line."""
    return sanitize(_long_lines(spark, sf_dir), "mask", False).lines.select("pos", "sanitized", F.col("n_matches").cast("long").alias("n_matches"))
