"""The registered queries and, for each, SQL that gives the same rows without parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import render as R
from checks import sanitize_sql as Q
from emberlog.functions import levels as L
from emberlog.functions.patterns import normalize_message
from emberlog.functions.secrets import passes_luhn
from emberlog.functions.text import first_non_duration, key_value_pairs, last_wins_map
from emberlog.operators import classify as C
from emberlog.operators import groups as G
from emberlog.operators.counts import count_patterns
from emberlog.operators.formats import parse_records
from emberlog.operators.records import records_from_lines, records_from_rows, records_from_text
from emberlog.plans.analyze import analyze
from emberlog.plans.sanitize import sanitize
from emberlog.session import configure
from emberlog.sources.rules import load_rules, rules_table
from emberlog.sources.text import row_lines, spread, table_lines



def _all():
    """One scope for the whole table."""
    return F.lit("all")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _records(spark: SparkSession, sf_dir: str, shape: str | None = None) -> DataFrame:
    configure(spark)
    line = R.mixed_line() if shape is None else R.shape_line(shape)
    return records_from_rows(R.events(spark, sf_dir).withColumn("line", line), "line", _all(), "event_id")



# --- formats ------------------------------------------------------------------------------------------------------


def _register_shape(shape: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = parse_records(_records(spark, sf_dir, shape))
        return parsed.select(
            F.col("pos").alias("event_id"), "source_type", "level", "service", F.col("timestamp").alias("time_text"), "message"
        )

    query(f"parse_{shape}", f"SELECT event_id, {R.expected(shape)} FROM events")(run)


for _shape in R.SHAPES:
    _register_shape(_shape)

MIX = (
    f"SELECT event_id, event_type, {R.by_shape(0)} AS source_type, {R.by_shape(1)} AS level, {R.by_shape(2)} AS service, "
    f"{R.by_shape(4)} AS message, "
    f"CASE event_id % {len(R.SHAPES)} WHEN 2 THEN 'HTTP ' || {R.STATUS} || ' POST /v2/settle/' || "
    f"CASE WHEN event_id < 10 THEN {R.ID} ELSE '<NUMBER>' END "
    f"WHEN 12 THEN '[' || {R.SERVICE} || '] ' || upper({R.SEVERITY}) || ' ' || {R.PATTERN} ELSE {R.PATTERN} END AS pattern, "
    f"CASE event_id % {len(R.SHAPES)} WHEN 2 THEN CASE event_type WHEN 'error' THEN 'GATEWAY_ERROR' WHEN 'purchase' THEN 'RATE_LIMIT' "
    f"ELSE 'UNKNOWN' END ELSE {R.CLASS} END AS classification, "
    f"event_id % {len(R.SHAPES)} <> 2 AND {R.ERROR_WORDED} AS worded FROM events"
)
ERRORS = f"SELECT * FROM ({MIX}) WHERE worded OR level IN ('WARNING', 'ERROR', 'FATAL', 'CRITICAL')"
GROUPS = (
    "SELECT lower(pattern) AS pattern_key, arg_min(pattern, event_id) AS pattern, count(*) AS n, "
    "arg_min(level, struct_pack(r := CASE level WHEN 'ERROR' THEN -2 WHEN 'WARNING' THEN -1 ELSE 0 END, e := event_id)) AS level, "
    "CASE WHEN min(service) = max(service) THEN min(service) WHEN min(service) IS NOT NULL THEN 'multiple' END AS service, "
    "CASE WHEN min(source_type) = max(source_type) THEN min(source_type) ELSE 'multiple' END AS source_type, "
    f"min(classification) AS classification FROM ({ERRORS}) GROUP BY 1"
)
RANKED = f"SELECT *, row_number() OVER (ORDER BY n DESC, pattern_key) AS rank FROM ({GROUPS})"


@query("format_mix", f"SELECT source_type, count(*) AS n FROM ({MIX}) GROUP BY 1")
def format_mix(spark, sf_dir):
    parsed = parse_records(_records(spark, sf_dir))
    return parsed.groupBy("source_type").agg(F.count("*").alias("n"))


@query(
    "parse_forced",
    f"SELECT event_id, CASE event_id % 16 WHEN 10 THEN 'java' ELSE 'plain' END AS source_type FROM events",
)
def parse_forced(spark, sf_dir):
    """Only the forced parser is tried, then plain text."""
    parsed = parse_records(_records(spark, sf_dir), "java")
    return parsed.select(F.col("pos").alias("event_id"), "source_type")


@query(
    "parse_fields",
    f"SELECT event_id, '10.0.0.9' AS remote_addr, '/v2/settle/' || {R.ID} AS path, {R.STATUS} AS status, '1.1' AS http_version FROM events",
)
def parse_fields(spark, sf_dir):
    parsed = parse_records(_records(spark, sf_dir, "web_access"))
    return parsed.select(
        F.col("pos").alias("event_id"), *[F.col("fields")[k].alias(k) for k in ("remote_addr", "path", "status", "http_version")]
    )


@query(
    "parse_payload",
    f"SELECT event_id, {R.SEVERITY} AS level_text, {R.SERVICE} AS service_name FROM events",
)
def parse_payload(spark, sf_dir):
    parsed = parse_records(_records(spark, sf_dir, "json"))
    return parsed.select(
        F.col("pos").alias("event_id"),
        F.try_variant_get("payload", "$.log.level", "string").alias("level_text"),
        F.try_variant_get("payload", "$.service.name", "string").alias("service_name"),
    )


# --- records ------------------------------------------------------------------------------------------------------

TRACED = (
    f"SELECT event_id, event_type, {R.SPACED} || ',123 ' || upper({R.SEVERITY}) || ' [' || {R.SERVICE} || '] c.e.Shop - ' || {R.MESSAGE} "
    "|| CASE WHEN event_type = 'error' THEN "
    + " || ".join(f"chr(10) || '{t}'" for t in R.TRACE)
    + " ELSE '' END AS raw FROM events"
)


@query(
    "record_coalesce",
    f"SELECT event_id * 8 AS pos, raw, CASE event_type WHEN 'error' THEN 4 ELSE 1 END AS n_lines FROM ({TRACED})",
)
def record_coalesce(spark, sf_dir):
    """Lines of traces, one per row, joined back to records; the ranges cut through traces on purpose."""
    lines = (
        R.events(spark, sf_dir)
        .select("event_id", F.posexplode(R.traced_lines()).alias("n", "line"))
        .select(F.lit("all").alias("scope"), (F.col("event_id") * 8 + F.col("n")).alias("pos"), "line")
    )
    records = records_from_lines(lines, F.floor((F.col("pos") + 3) / 501))
    return records.select("pos", "raw", "n_lines")


_CONTINUED = (
    r"^([ \t]|\s*(at\s+\S|Caused by:|Suppressed:|Traceback \(most recent call last\):|File \"|During handling"
    r"|The above exception|\.\.\. [0-9]+ more|(DETAIL|HINT|STATEMENT|CONTEXT|QUERY):\s+\S))"
)


@query(
    "record_text",
    f"""WITH lines AS (
      SELECT doc_id, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) AS i,
             unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '\\S'))
    SELECT doc_id, count(*) AS n_lines,
           sum(CASE WHEN k = 1 OR NOT regexp_matches(line, '{_CONTINUED}') THEN 1 ELSE 0 END)::BIGINT AS n_records
    FROM kept GROUP BY doc_id""",
)
def record_text(spark, sf_dir):
    records = records_from_text(_table(spark, sf_dir, "documents"), "text", "doc_id")
    return records.groupBy(F.col("scope").cast("bigint").alias("doc_id")).agg(
        F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_records")
    )


# --- scalar functions ---------------------------------------------------------------------------------------------

_WORD = (
    "CASE o_orderkey % 11 WHEN 0 THEN 'warn' WHEN 1 THEN 'Err' WHEN 2 THEN 'SEVERE' WHEN 3 THEN 'crit' WHEN 4 THEN 'ALERT' "
    "WHEN 5 THEN 'emerg' WHEN 6 THEN 'notice' WHEN 7 THEN 'Trace' WHEN 8 THEN 'fatal' WHEN 9 THEN 'info' ELSE 'error' END"
)
_NORMAL = (
    "CASE o_orderkey % 11 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'CRITICAL' WHEN 4 THEN 'CRITICAL' "
    "WHEN 5 THEN 'CRITICAL' WHEN 6 THEN 'NOTICE' WHEN 7 THEN 'TRACE' WHEN 8 THEN 'FATAL' WHEN 9 THEN 'INFO' ELSE 'ERROR' END"
)


@query("level_normalize", f"SELECT o_orderkey, {_NORMAL} AS level FROM orders")
def level_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", L.normalize_level(F.expr(_WORD)).alias("level"))


_INFER_TEXT = (
    "CASE o_orderkey % 5 WHEN 0 THEN 'order ' || CAST(o_orderkey AS STRING) || ' failed' "
    "WHEN 1 THEN 'state: ' || " + _WORD + " || ' after failure' WHEN 2 THEN 'gateway said 503' "
    "WHEN 3 THEN 'informed 5030 warnings' ELSE o_orderpriority END"
)


@query(
    "level_infer",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ERROR' "
    f"WHEN 1 THEN CASE WHEN o_orderkey % 11 = 2 THEN 'ERROR' ELSE {_NORMAL} END "
    "WHEN 2 THEN 'ERROR' ELSE 'INFO' END AS level FROM orders",
)
def level_infer(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", L.infer_level(F.expr(_INFER_TEXT)).alias("level"))


@query(
    "level_status",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN 100 + o_custkey % 500 >= 500 THEN 'ERROR' "
    "WHEN 100 + o_custkey % 500 >= 400 THEN 'WARNING' ELSE 'INFO' END AS level FROM orders",
)
def level_status(spark, sf_dir):
    text = F.expr(
        "CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_totalprice AS STRING) ELSE ' ' || CAST(100 + o_custkey % 500 AS STRING) || ' ' END"
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", L.level_from_status(text).alias("level"))


@query(
    "level_priority",
    "SELECT o_orderkey, CASE WHEN o_custkey % 8 <= 2 THEN 'CRITICAL' WHEN o_custkey % 8 = 3 THEN 'ERROR' "
    "WHEN o_custkey % 8 = 4 THEN 'WARNING' ELSE 'INFO' END AS level FROM orders",
)
def level_priority(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", L.level_from_priority(F.col("o_custkey").cast("string")).alias("level")
    )


@query(
    "key_values",
    "SELECT o_orderkey, CAST(o_custkey AS STRING) AS customer, o_orderpriority AS priority, "
    "'c' || CAST(o_custkey AS STRING) AS service, 4 AS n_keys FROM orders",
)
def key_values(spark, sf_dir):
    line = F.expr(
        "'customer=x took=12ms priority=\"' || o_orderpriority || '\" app=c' || CAST(o_custkey AS STRING) "
        "|| ' customer=' || CAST(o_custkey AS STRING)"
    )
    kv = last_wins_map(key_value_pairs(line))
    return (
        _table(spark, sf_dir, "orders")
        .withColumn("kv", kv)
        .select(
            "o_orderkey",
            F.col("kv")["customer"].alias("customer"),
            F.col("kv")["priority"].alias("priority"),
            first_non_duration(F.col("kv")["took"], F.col("kv")["app"]).alias("service"),
            F.size("kv").alias("n_keys"),
        )
    )


# --- patterns and groups ------------------------------------------------------------------------------------------


@query("normalize_patterns", f"SELECT event_id, {R.PATTERN} AS pattern FROM events")
def normalize_patterns(spark, sf_dir):
    return R.events(spark, sf_dir).select("event_id", normalize_message(F.expr(R.MESSAGE)).alias("pattern"))


@query("normalize_urls", "SELECT page_id, 'fetched <URL> in <DURATION> size <SIZE>' AS pattern FROM pages")
def normalize_urls(spark, sf_dir):
    text = F.expr("'fetched ' || url || ' in ' || CAST(page_id AS STRING) || 'ms size ' || CAST(page_id AS STRING) || 'KB'")
    return _table(spark, sf_dir, "pages").select("page_id", normalize_message(text).alias("pattern"))


_VALUES = (
    ("CAST(o_orderkey AS STRING)", "order <NUMBER>", "'order 1000' || CAST(o_orderkey AS STRING)"),
    ("uuid", "id <UUID>", "'id 123e4567-e89b-12d3-a456-42661417' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')"),
    ("span", "span_id=<ID>", "'span-id:s' || CAST(o_orderkey AS STRING)"),
    ("correlation", "correlation_id=<ID>", "'correlation-id=c' || CAST(o_orderkey AS STRING)"),
    ("request", "request_id=<ID> x", "'request_id=r' || CAST(o_orderkey AS STRING) || ' x'"),
    ("session", "session_id=<ID>", "'session id:' || CAST(o_orderkey AS STRING)"),
    ("uid", "uid=<ID> done", "'uid=u' || CAST(o_orderkey AS STRING) || ' done'"),
    ("hex", "blob <HEX>", "'blob deadbeefdeadbeef' || CAST(o_orderkey AS STRING)"),
    ("date", "on <DATE>", "'on ' || substr(CAST(o_orderdate AS STRING), 1, 10)"),
    ("time", "at <TIMESTAMP> ok", "'at ' || substr(CAST(o_orderdate AS STRING), 1, 10) || 'T00:00:01Z ok'"),
    ("access", "[<TIMESTAMP>]", "'[01/Jan/2024:00:00:01 +0000]'"),
    ("syslog", "<TIMESTAMP> up", "'Jan  1 00:00:01 up'"),
    ("ip", "from <IP>", "'from 10.0.0.' || CAST(o_orderkey % 250 AS STRING)"),
    ("frames", "boom at <STACK_FRAME> ... <STACK_FRAMES> more", "'boom' || chr(10) || '  at Shop(Shop)' || chr(10) || '  ... ' || CAST(o_orderkey % 90 AS STRING) || ' more'"),
    ("python", "boom File <PYTHON_FRAME>", "'boom' || chr(10) || 'File \"a\", line ' || CAST(o_orderkey % 900 AS STRING) || ', in run'"),
)


@query(
    "normalize_values",
    f"SELECT o_orderkey, CASE o_orderkey % {len(_VALUES)} "
    + " ".join(f"WHEN {i} THEN '{v[1]}'" for i, v in enumerate(_VALUES))
    + " END AS pattern FROM orders",
)
def normalize_values(spark, sf_dir):
    text = F.expr(f"CASE o_orderkey % {len(_VALUES)} " + " ".join(f"WHEN {i} THEN {v[2]}" for i, v in enumerate(_VALUES)) + " END")
    return _table(spark, sf_dir, "orders").select("o_orderkey", normalize_message(text).alias("pattern"))


@query("error_filter", f"SELECT event_id, level, message FROM ({ERRORS})")
def error_filter(spark, sf_dir):
    return G.error_events(parse_records(_records(spark, sf_dir))).select(F.col("pos").alias("event_id"), "level", "message")


@query(
    "error_groups",
    f"SELECT rank, pattern, n, level, service, source_type, classification FROM ({RANKED}) WHERE rank <= 50",
)
def error_groups(spark, sf_dir):
    result = analyze(_records(spark, sf_dir), max_groups=50, examples=False)
    return result.groups.select(
        "rank", "pattern", F.col("count").alias("n"), "level", "service", "source_type", "classification"
    )


@query(
    "group_examples",
    f"""WITH e AS (SELECT lower(pattern) AS pattern_key, message, event_id,
        row_number() OVER (PARTITION BY lower(pattern) ORDER BY event_id) AS k FROM ({ERRORS}))
    SELECT pattern_key, string_agg(CAST(event_id AS STRING), ',' ORDER BY event_id) AS events FROM e WHERE k <= 3 GROUP BY 1""",
)
def group_examples(spark, sf_dir):
    """The examples of all groups; the raw line of an example is its event id here."""
    parsed = parse_records(_records(spark, sf_dir)).withColumn("raw", F.col("pos").cast("string"))
    examples = G.group_examples(count_patterns(G.with_pattern(parsed)))
    return examples.select("pattern_key", F.array_join("examples", ",").alias("events"))


@query("classify_rules", f"SELECT pattern_key, classification FROM ({GROUPS})")
def classify_rules(spark, sf_dir):
    stats = analyze(_records(spark, sf_dir), examples=False).stats
    return C.classify(G.error_groups(stats), load_rules()).select("pattern_key", "classification")


@query("classify_rule_table", f"SELECT pattern_key, classification FROM ({GROUPS})")
def classify_rule_table(spark, sf_dir):
    stats = analyze(_records(spark, sf_dir), examples=False).stats
    rules = rules_table(spark, load_rules())
    return C.classify_by_table(G.error_groups(stats), rules).select("pattern_key", "classification")


@query(
    "insights",
    f"""WITH best AS (SELECT classification, min(rank) AS r FROM ({RANKED}) WHERE classification <> 'UNKNOWN' GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS rank, classification,
      CASE classification WHEN 'NETWORK_ERROR' THEN 'A peer does not accept or keep connections' WHEN 'DNS_ERROR' THEN 'A host name has no usable answer'
        WHEN 'TIMEOUT' THEN 'Work takes longer than its callers allow' WHEN 'DATABASE_ERROR' THEN 'The data store cannot take or finish statements'
        WHEN 'RATE_LIMIT' THEN 'A limit on calls has been reached' ELSE 'The edge cannot get a good answer from what it forwards to' END AS title,
      CASE classification WHEN 'RATE_LIMIT' THEN 2 ELSE 3 END AS n_actions FROM best""",
)
def insights(spark, sf_dir):
    result = analyze(_records(spark, sf_dir), max_groups=1, examples=False)
    return result.insights.select("rank", "classification", "title", F.size("recommended_actions").alias("n_actions"))


@query(
    "rca_summary",
    f"""SELECT (SELECT count(*) FROM events) AS total_lines, (SELECT count(*) FROM events) AS parsed_lines,
      sum(n)::BIGINT AS error_events, count(*) AS unique_patterns, arg_min(pattern, rank) AS dominant_issue,
      CASE WHEN 400.0 * max(n) / sum(n) = floor(400.0 * max(n) / sum(n)) THEN round_even(max(n) / sum(n) * 100, 1)
        ELSE round(max(n) / sum(n) * 100, 1) END AS dominant_percentage FROM ({RANKED})""",
)
def rca_summary(spark, sf_dir):
    return analyze(_records(spark, sf_dir), examples=False).summary.drop("scope")


@query(
    "source_breakdown",
    f"SELECT row_number() OVER (ORDER BY count(*) DESC, source_type) AS rank, source_type, count(*) AS n FROM ({MIX}) GROUP BY source_type",
)
def source_breakdown(spark, sf_dir):
    """Counts by source type in display order; at most fourteen rows are ranked."""
    counts = analyze(_records(spark, sf_dir), examples=False).source_types
    return G.breakdown(counts, "source_type").drop("scope")


@query(
    "scoped_groups",
    f"""WITH g AS (SELECT event_type AS scope, pattern, count(*) AS n FROM ({ERRORS}) GROUP BY event_type, pattern),
    r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, lower(pattern)) AS rank FROM g)
    SELECT scope, rank, pattern, n FROM r WHERE rank <= 10""",
)
def scoped_groups(spark, sf_dir):
    """Each event type as a unit of its own, ranked by itself."""
    df = R.events(spark, sf_dir).withColumn("line", R.mixed_line())
    result = analyze(records_from_rows(df, "line", "event_type", "event_id"), examples=False)
    return result.groups.select("scope", "rank", "pattern", F.col("count").alias("n"))


# --- sanitising ---------------------------------------------------------------------------------------------------


def _secret_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = R.events(spark, sf_dir).withColumn("line", Q.secret_line(kind))
    return row_lines(df, "line", _all(), "event_id")


def _register_sanitize(kind: str, mode: str, correlate: bool, suffix: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = sanitize(_secret_lines(spark, sf_dir, kind), mode, correlate)
        return result.lines.select(F.col("pos").alias("event_id"), "kind", "sanitized")

    query(f"sanitize_{kind}_{suffix}", Q.expected_line(kind, suffix))(run)


for _kind in Q.KINDS:
    _register_sanitize(_kind, "mask", False, "mask")
    _register_sanitize(_kind, "hash", True, "hash")
    _register_sanitize(_kind, "mask", True, "numbered")


@query("sanitize_docs_mask", Q.documents_sql("sanitized"))
def sanitize_docs_mask(spark, sf_dir):
    """All rules over all lines of all documents."""
    lines = table_lines(_table(spark, sf_dir, "documents"), "text", "doc_id")
    return sanitize(lines, "mask", False).lines.select(
        F.col("scope").cast("bigint").alias("doc_id"), F.col("pos").alias("line_no"), "sanitized"
    )


@query("sanitize_docs_counts", Q.documents_sql("counts"))
def sanitize_docs_counts(spark, sf_dir):
    lines = table_lines(_table(spark, sf_dir, "documents"), "text", "doc_id")
    found = sanitize(lines, "mask", False).categories
    return found.groupBy("category").agg(F.sum("n").alias("n"))


@query("sanitize_docs_summary", Q.documents_sql("summary"))
def sanitize_docs_summary(spark, sf_dir):
    lines = table_lines(_table(spark, sf_dir, "documents"), "text", "doc_id")
    result = sanitize(lines, "mask", False).summary
    return result.select(
        F.col("scope").cast("bigint").alias("doc_id"), "total_lines", "transformed_lines", "total_matches"
    )


@query("sanitize_summary", Q.SUMMARY)
def sanitize_summary(spark, sf_dir):
    return sanitize(_secret_lines(spark, sf_dir, "logfmt"), "mask", False).summary.drop("scope")


@query("sanitize_categories", Q.CATEGORIES)
def sanitize_categories(spark, sf_dir):
    return sanitize(_secret_lines(spark, sf_dir, "logfmt"), "mask", False).categories.drop("scope")


@query("sanitize_examples", Q.EXAMPLES)
def sanitize_examples(spark, sf_dir):
    return sanitize(_secret_lines(spark, sf_dir, "logfmt")).examples.drop("scope")


@query("sanitize_then_analyze", Q.THEN_ANALYZE)
def sanitize_then_analyze(spark, sf_dir):
    """Safe lines are fed to the analysis."""
    lines = row_lines(R.events(spark, sf_dir).withColumn("line", Q.then_line()), "line", _all(), "event_id")
    safe = sanitize(lines, "mask", False).lines
    result = analyze(records_from_rows(safe, "sanitized", "scope", "pos"), examples=False)
    return result.groups.select("rank", "pattern", F.col("count").alias("n"), "classification")


@query("luhn_cards", Q.LUHN)
def luhn_cards(spark, sf_dir):
    digits = F.expr("'4' || lpad(CAST(o_orderkey * 7919 + o_custkey AS STRING), 15, '0')")
    spaced = F.regexp_replace(digits, "(.{4})(?=.)", "$1 ")
    return _table(spark, sf_dir, "orders").select("o_orderkey", passes_luhn(spaced).alias("valid"))
