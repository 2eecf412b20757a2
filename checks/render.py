"""Log lines rendered from the ``events`` table, in Spark; and what they should parse to, in SQL.

The messages and times are one set of SQL expressions that both engines read. The line shapes exist in Spark only: the
expected values are computed from the table's columns, never by parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.text import spread

# SQL that Spark and DuckDB both understand.
DAY = "substr(CAST(ts AS STRING), 1, 10)"
CLOCK = "substr(CAST(ts AS STRING), 12, 8)"
ISO = f"({DAY} || 'T' || {CLOCK} || 'Z')"
SPACED = f"({DAY} || ' ' || {CLOCK})"
SLASHED = f"(substr({DAY}, 1, 4) || '/' || substr({DAY}, 6, 2) || '/' || substr({DAY}, 9, 2) || ' ' || {CLOCK})"
DD = f"substr({DAY}, 9, 2)"
SEVERITY = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' ELSE 'info' END"
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END"
STATUS = "CASE event_type WHEN 'error' THEN '502' WHEN 'purchase' THEN '429' ELSE '200' END"
SERVICE = "('svc-' || CAST(user_id % 7 AS STRING))"
ID = "CAST(event_id AS STRING)"
USER = "CAST(user_id AS STRING)"
MESSAGE = f"""CASE
  WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'Connection refused to upstream 10.0.' || {USER} || '.7:8080'
  WHEN event_type = 'error' AND event_id % 5 = 1 THEN 'lookup db-' || {USER} || '.example.com no such host'
  WHEN event_type = 'error' AND event_id % 5 = 2 THEN 'Read timed out after ' || {ID} || 'ms'
  WHEN event_type = 'error' AND event_id % 5 = 3 THEN 'deadlock detected on order-' || {ID} || ' for trace_id=t' || {ID}
  WHEN event_type = 'error' THEN 'Unexpected payment state 77' || {ID} || ' at /pay/55' || {USER}
  WHEN event_type = 'purchase' THEN 'rate limit exceeded for user_id=' || {USER} || ' status=429'
  ELSE 'request completed in ' || {ID} || 'ms' END"""
PATTERN = """CASE
  WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'Connection refused to upstream <IP>:<PORT>'
  WHEN event_type = 'error' AND event_id % 5 = 1 THEN 'lookup <HOST> no such host'
  WHEN event_type = 'error' AND event_id % 5 = 2 THEN 'Read timed out after <DURATION>'
  WHEN event_type = 'error' AND event_id % 5 = 3 THEN 'deadlock detected on <ID> for trace_id=<ID>'
  WHEN event_type = 'error' AND event_id < 10 THEN 'Unexpected payment state 77' || CAST(event_id AS STRING) || ' at /pay/<NUMBER>'
  WHEN event_type = 'error' THEN 'Unexpected payment state <NUMBER> at /pay/<NUMBER>'
  WHEN event_type = 'purchase' THEN 'rate limit exceeded for user_id=<ID> status=429'
  ELSE 'request completed in <DURATION>' END"""
CLASS = """CASE
  WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'NETWORK_ERROR'
  WHEN event_type = 'error' AND event_id % 5 = 1 THEN 'DNS_ERROR'
  WHEN event_type = 'error' AND event_id % 5 = 2 THEN 'TIMEOUT'
  WHEN event_type = 'error' AND event_id % 5 = 3 THEN 'DATABASE_ERROR'
  WHEN event_type = 'error' THEN 'UNKNOWN'
  WHEN event_type = 'purchase' THEN 'RATE_LIMIT'
  ELSE 'UNKNOWN' END"""
# Level inferred from the message alone: only some messages hold a failure word.
INFERRED = "CASE WHEN event_type = 'error' AND event_id % 5 IN (0, 3) THEN 'ERROR' ELSE 'INFO' END"
# Message with an error word, which makes an event of a record of any level.
ERROR_WORDED = "(event_type = 'error' AND event_id % 5 IN (0, 2, 3))"
TRACE = ("    at com.example.Shop.place(Shop.java:42)", "    at com.example.Main.run(Main.java:7)", "Caused by: java.lang.IllegalStateException: no stock")

SHAPES = (
    "json", "logfmt", "web_access", "nginx_error", "syslog_3164", "syslog_5424", "postgres", "mysql", "redis",
    "spring", "java", "python", "plain", "iso_level", "docker_json", "cri",
)
# Expected columns of each shape, in SQL.
EXPECTED = {
    "json": ("json", LEVEL, SERVICE, ISO, MESSAGE),
    "logfmt": ("logfmt", LEVEL, SERVICE, ISO, MESSAGE),
    "web_access": ("web_access", LEVEL, "'web'", f"({DD} || '/Jan/2024:' || {CLOCK} || ' +0000')", f"('HTTP ' || {STATUS} || ' POST /v2/settle/' || {ID})"),
    "nginx_error": ("nginx_error", LEVEL, "'nginx'", SLASHED, MESSAGE),
    "syslog_3164": ("syslog", INFERRED, SERVICE, f"('Jan ' || {DD} || ' ' || {CLOCK})", MESSAGE),
    "syslog_5424": ("syslog", LEVEL, SERVICE, ISO, MESSAGE),
    "postgres": ("postgres", LEVEL, "'postgres'", f"({SPACED} || ' UTC')", MESSAGE),
    "mysql": ("mysql", LEVEL, "'mysql'", ISO, MESSAGE),
    "redis": ("redis", "CASE WHEN event_type IN ('error', 'purchase') THEN 'WARNING' ELSE 'INFO' END", "'redis'", f"({DD} || ' Jan 2024 ' || {CLOCK} || '.123')", MESSAGE),
    "spring": ("java", LEVEL, "'c.e.Shop'", ISO, MESSAGE),
    "java": ("java", LEVEL, SERVICE, f"({SPACED} || ',123')", MESSAGE),
    "python": ("python", LEVEL, "'shop.api'", f"({SPACED} || ',123')", MESSAGE),
    # Two key=value pairs make the purchase line a logfmt line without a service.
    "plain": ("CASE event_type WHEN 'purchase' THEN 'logfmt' ELSE 'plain' END", LEVEL, f"CASE WHEN event_type <> 'purchase' THEN {SERVICE} END", "CAST(NULL AS STRING)", f"('[' || {SERVICE} || '] ' || upper({SEVERITY}) || ' ' || {MESSAGE})"),
    "iso_level": ("plain", LEVEL, "CAST(NULL AS STRING)", ISO, MESSAGE),
    "docker_json": ("docker_json", LEVEL, SERVICE, ISO, MESSAGE),
    "cri": ("cri", "CASE event_type WHEN 'purchase' THEN 'WARNING' ELSE 'ERROR' END", SERVICE, ISO, MESSAGE),
}


def shape_line(shape: str) -> Column:
    """The event as one line of a shape."""
    iso, spaced, clock, dd = F.expr(ISO), F.expr(SPACED), F.expr(CLOCK), F.expr(DD)
    sev, service, message, event = F.expr(SEVERITY), F.expr(SERVICE), F.expr(MESSAGE), F.expr(ID)
    upper, long_level = F.upper(sev), F.expr(LEVEL)
    lit = F.lit
    parts = {
        "json": [lit('{"@timestamp":"'), iso, lit('","log":{"level":"'), sev, lit('","logger":"x"},"service":{"name":"'), service, lit('"},"message":"'), message, lit('"}')],
        "logfmt": [lit("ts="), iso, lit(" level="), sev, lit(" app="), service, lit(' msg="'), message, lit('"')],
        "web_access": [lit("10.0.0.9 - - ["), dd, lit("/Jan/2024:"), clock, lit(' +0000] "POST /v2/settle/'), event, lit(' HTTP/1.1" '), F.expr(STATUS), lit(' 180 "-" "curl/8.1"')],
        "nginx_error": [F.expr(SLASHED), lit(" ["), sev, lit("] 12#34: "), message],
        "syslog_3164": [lit("Jan "), dd, lit(" "), clock, lit(" host-1 "), service, lit("[12]: "), message],
        "syslog_5424": [lit("<"), F.expr("CASE event_type WHEN 'error' THEN '131' WHEN 'purchase' THEN '132' ELSE '134' END"), lit(">1 "), iso, lit(" host-1 "), service, lit(" 12 ID - "), message],
        "postgres": [spaced, lit(" UTC [12] "), long_level, lit(":  "), message],
        "mysql": [iso, lit(" 0 ["), F.initcap(sev), lit("] [MY-1] [Server] "), message],
        "redis": [lit("12:M "), dd, lit(" Jan 2024 "), clock, lit(".123 "), F.expr("CASE WHEN event_type IN ('error', 'purchase') THEN '#' ELSE '*' END"), lit(" "), message],
        "spring": [iso, lit(" "), upper, lit(" 12 --- [main] c.e.Shop : "), message],
        "java": [spaced, lit(",123 "), upper, lit(" ["), service, lit("] c.e.Shop - "), message],
        "python": [spaced, lit(",123 shop.api "), upper, lit(" "), message],
        "plain": [lit("["), service, lit("] "), upper, lit(" "), message],
        "iso_level": [iso, lit(" "), upper, lit(" "), message],
        "docker_json": [lit('{"log":"{\\"level\\":\\"'), sev, lit('\\",\\"service\\":\\"'), service, lit('\\",\\"message\\":\\"'), message, lit('\\"}\\n","stream":"stdout","time":"'), iso, lit('"}')],
        "cri": [iso, lit(" stderr F level="), sev, lit(" app="), service, lit(' msg="'), message, lit('"')],
    }
    return F.concat(*parts[shape])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet"))


def mixed_line() -> Column:
    """The event as one line, the shape chosen by its id."""
    kind = F.col("event_id") % len(SHAPES)
    case = F
    for number, shape in enumerate(SHAPES):
        case = case.when(kind == number, shape_line(shape))
    return case


def traced_lines() -> Column:
    """The event as a Java line, with the three lines of a stack trace and a blank line when it is an error."""
    line = shape_line("java")
    trace = F.array(line, *[F.lit(t) for t in (TRACE[0], "", *TRACE[1:])])
    return F.when(F.col("event_type") == "error", trace).otherwise(F.array(line))


def _label(source: str) -> str:
    return source if source.startswith("CASE") else f"'{source}'"


def expected(shape: str) -> str:
    source, level, service, time, message = EXPECTED[shape]
    return (
        f"{_label(source)} AS source_type, {level} AS level, {service} AS service, "
        f"{time} AS time_text, {message} AS message"
    )


def by_shape(index: int) -> str:
    """CASE over the shapes for one of the expected columns: 0 source type, 1 level, 2 service, 3 time, 4 message."""
    whens = []
    for number, shape in enumerate(SHAPES):
        value = EXPECTED[shape][index]
        value = _label(value) if index == 0 else value
        whens.append(f"WHEN {number} THEN {value}")
    return f"CASE event_id % {len(SHAPES)} " + " ".join(whens) + " END"
