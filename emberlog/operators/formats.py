"""Format detection and parsing of records as one chain of column expressions.

A record's first line picks its format: containers (docker JSON, CRI) are unwrapped first, at most twice, and the
innermost text is then parsed once. Each line format is one regex whose groups are laid out by one replacement:

    format | timestamp | level | service | message | name=value pairs for ``fields``
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import levels as L
from emberlog.functions import text as S
from emberlog.functions.plan import Steps, add, let, replay, settled
from emberlog.functions.text import MARK_CLOSE, MARK_OPEN, MARK_PAIR, unicode_re


class LineFormat(NamedTuple):
    name: str  # name of the shape
    source_type: str  # what the record is labelled
    flags: str
    digit: bool  # starts with a digit: a cheap test before the regex
    pattern: str
    layout: tuple[str, str, str, str]  # timestamp, level, service, message
    fields: tuple[str, ...]  # group names in order


# The line shapes in the order they are tried.
CRI = (
    r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z)\s+(stdout|stderr)\s+([FP])\s+(.*)$"
)
LINE_FORMATS = (
    LineFormat(
        "nginx_error", "nginx_error", "i", True,
        r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(\d+)#(\d+):\s+(.*)$",
        ("$1", "$2", "nginx", "$5"),
        ("timestamp", "level", "pid", "tid", "message"),
    ),
    LineFormat(
        "web_access", "web_access", "", False,
        r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)(?:\s+HTTP/([^"]+))?"\s+(\d{3})\s+(\S+)',
        ("$2", "$6", "web", "HTTP $6 $3 $4"),
        ("remote_addr", "timestamp", "method", "path", "http_version", "status", "body_bytes_sent"),
    ),
    LineFormat(
        "syslog_5424", "syslog", "", False,
        r"^<(\d+)>\d+\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:-|\[[^\]]+\])\s+(.*)$",
        ("$2", "$1", "$4", "$7"),
        ("priority", "timestamp", "host", "app", "procid", "msgid", "message"),
    ),
    LineFormat(
        "syslog_3164", "syslog", "", False,
        r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w.\-/]+)(?:\[(\d+)\])?:\s+(.*)$",
        ("$1", "", "$3", "$5"),
        ("timestamp", "host", "process", "pid", "message"),
    ),
    LineFormat(
        "postgres", "postgres", "", True,
        r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s+\w+)?)\s+\[(\d+)\]\s+([A-Z]+):\s+(.*)$",
        ("$1", "$3", "postgres", "$4"),
        ("timestamp", "pid", "level", "message"),
    ),
    LineFormat(
        "mysql", "mysql", "i", True,
        r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)\s+(\d+)\s+\[(\w+)\]\s+"
        r"(?:\[[^\]]+\]\s+)?(?:\[[^\]]+\]\s+)?(.*)$",
        ("$1", "$3", "mysql", "$4"),
        ("timestamp", "thread", "level", "message"),
    ),
    LineFormat(
        "redis", "redis", "", True,
        r"^(\d+):([A-Z])\s+(\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+([#*\-.])\s+(.*)$",
        ("$3", "$4", "redis", "$5"),
        ("pid", "role", "timestamp", "marker", "message"),
    ),
    LineFormat(
        "spring", "java", "i", True,
        r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+\d+\s+---\s+"
        r"\[([^\]]+)\]\s+(\S+)\s+:\s+(.*)$",
        ("$1", "$2", "$4", "$5"),
        ("timestamp", "level", "thread", "logger", "message"),
    ),
    LineFormat(
        "java", "java", "i", True,
        r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[,.]\d+)?)\s+"
        r"(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\s+(.*?)\s+-\s+(.*)$",
        ("$1", "$2", "$3", "$4"),
        ("timestamp", "level", "context", "message"),
    ),
    LineFormat(
        "python", "python", "i", True,
        r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:,\d+)?)\s+(?:-\s+)?([\w.\-/]+)?\s*-?\s*"
        r"(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\s*-?\s*(.*)$",
        ("$1", "$3", "$2", "$4"),
        ("timestamp", "logger", "level", "message"),
    ),
    LineFormat(
        "iso_level", "plain", "i", True,
        r"^(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:[,.]\d+)?Z?)\s+"
        r"(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL)\s+(.*)$",
        ("$1", "$2", "", "$3"),
        ("timestamp", "level", "message"),
    ),
)
REDIS_ERROR = r"\berror|fail|oom|denied\b"

# JSON paths by meaning, first non-null wins, a literal dotted key before the nested one.
JSON_LEVEL = ("log.level", "level", "severity", "severity_text", "status.level", "event.severity")
JSON_SERVICE = (
    "service.name", "service", "app.name", "app", "application", "logger", "log.logger",
    "kubernetes.container.name", "kubernetes.container_name", "kubernetes.labels.app",
    "container.name", "container_name", "pod", "job",
)
JSON_TIMESTAMP = ("@timestamp", "timestamp", "time", "ts", "datetime", "event.created", "observedTimestamp")
JSON_MESSAGE = (
    "message", "msg", "error.message", "error", "event.original", "log", "body", "textPayload",
    "jsonPayload.message",
)
JSON_STATUS = (
    "http.response.status_code", "http.status_code", "response.status", "response.status_code",
    "status", "status_code",
)
JSON_STACK = ("error.stack_trace", "stacktrace", "stack_trace", "exception.stacktrace", "exc_info")

# Key names of key=value lines by meaning.
KV_LEVEL = ("level", "severity", "at")
KV_STATUS = ("status", "status_code", "http_status")
KV_MESSAGE = ("message", "msg", "error", "err")
KV_SERVICE = ("service_name", "app", "application", "logger", "container", "service")
KV_TIMESTAMP = ("timestamp", "time", "ts")

# The names a caller may force.
SOURCE_TYPES = (
    "auto", "json", "docker_json", "cri", "logfmt", "web_access", "nginx_error", "syslog",
    "postgres", "mysql", "redis", "java", "python", "plain",
)
FORCED_SHAPES = {"syslog": ("syslog_5424", "syslog_3164")}
#: Containers that have projections of their own; what is nested deeper is unwrapped by a fold, however deep.
UNWRAP_DEPTH = 2
#: Longest JSON line whose keys are searched for before they are looked up; a longer one is not read once more for each key.
SEARCHED_BYTES = 4096
CONTAINER_MARK = r"log|std(?:out|err)"
PARSED = ("message", "level", "service", "timestamp", "source_type", "fields")


def parse_records(records: DataFrame, source_type: str = "auto") -> DataFrame:
    """Add ``message, level, service, timestamp, source_type, fields, payload, inner_payload`` to ``records(raw, ...)``.

    ``payload`` is the JSON object of the record itself, ``inner_payload`` that of the innermost text of a container.

    Columns that later steps read more than once get a projection of their own, which keeps each generated method small.
    """
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"source_type must be one of {', '.join(SOURCE_TYPES)}")
    keep = records.columns
    df = replay(records, _write_steps, source_type)
    return df.select(
        *keep,
        *[settled(_restored(c)).alias(c) for c in PARSED],
        settled(F.coalesce("__json0", "__json")).alias("payload"),
        settled(F.when(F.col("__box0").isNotNull(), F.col("__json"))).alias("inner_payload"),
    )


def _restored(name: str) -> Column:
    value = F.col(f"__{name}")
    if name in ("message", "service", "timestamp"):
        return S.restore_marks(value)
    return F.transform_values(value, lambda _, v: S.restore_marks(v)) if name == "fields" else value


def _write_steps(steps: Steps, source_type: str) -> None:
    add(steps, "__text0", S.clean(F.col("raw")))
    for depth in range(UNWRAP_DEPTH):
        _unwrap(steps, depth, source_type)
    _unwrap_deeper(steps)
    _detect_innermost(steps, source_type)
    _read_innermost(steps)
    _wrap_deeper(steps)
    for depth in reversed(range(UNWRAP_DEPTH)):
        _wrap(steps, depth)


# --- containers -------------------------------------------------------------------------------------------------


def _with_json_object(df: Steps, name: str, line: Column, when: Column) -> Steps:
    """Add ``name``: the line as a variant if it is exactly one JSON object, else NULL."""
    df = add(df, f"{name}_text", F.when(when, S.strip_column(line)))
    text = F.col(f"{name}_text")
    df = add(df, f"{name}_list", _as_list(text))
    return add(df, name, _only_object(text, F.col(f"{name}_list")))


def _as_list(text: Column) -> Column:
    return F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))


def _only_object(text: Column, listed: Column) -> Column:
    # A stray bracket could close the list early; then the same text cannot close as an object member too.
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    whole = ~text.contains("]") | keyed.isNotNull()
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(listed.isNotNull() & alone & whole, F.try_variant_get(listed, "$[0]", "variant"))


def _unsearched(line: Column) -> Column:
    """Whether a JSON line's keys are not searched for: their letters may be written as escapes, or the line is long."""
    return (F.octet_length(line) > SEARCHED_BYTES) | line.contains("\\u")


def _at(payload: Column, keys: tuple[str, ...], kind: str, line: Column, unsearched: Column) -> Column:
    """The value at a path of keys in the JSON of ``line``.

    A path that leads nowhere costs an exception inside Spark, so its keys are searched for in the text before.
    """
    path = "$" + "".join(f'["{key}"]' for key in keys)
    named = reduce(lambda a, b: a & b, [line.contains(f'"{key}"') for key in keys])
    return F.when(unsearched | named, F.try_variant_get(payload, path, kind))


def _has(payload: Column, key: str, line: Column) -> Column:
    return _at(payload, (key,), "variant", line, _unsearched(line)).isNotNull()


def _is_docker(json: Column, line: Column) -> Column:
    return _has(json, "log", line) & (_has(json, "stream", line) | _has(json, "time", line))


def _text_at(payload: Column, key: str) -> Column:
    return F.try_variant_get(payload, f'$["{key}"]', "string")


def _starts_with_digit(line: Column) -> Column:
    return line.substr(1, 1).rlike(unicode_re(r"\d"))


def _unwrap(df: Steps, depth: int, source_type: str) -> Steps:
    """Detect a container at this depth; the next depth is its inner text, or the same text."""
    text, line, json, box, cri = (F.col(f"__{c}{depth}") for c in ("text", "line", "json", "box", "cri"))
    inside = F.lit(True) if depth == 0 else F.col(f"__box{depth - 1}").isNotNull()
    df = add(df, f"__line{depth}", S.first_line(text))
    if depth == 0 and source_type not in ("auto", "json", "docker_json"):
        df = add(df, "__json0", F.lit(None).cast("variant"))
    else:
        df = _with_json_object(df, f"__json{depth}", line, inside)
    docker = _is_docker(json, line)
    is_cri = F.lit(False)
    if depth > 0 or source_type in ("auto", "cri"):
        is_cri = inside & json.isNull() & _starts_with_digit(line) & line.rlike(unicode_re(CRI))
    df = add(df, f"__box{depth}", F.when(docker, "docker_json").when(is_cri, "cri"))
    groups = F.split(_layout_hit(line, CRI, "", ("$1", "$2", "$3", "$4")), MARK_OPEN, -1)
    df = add(df, f"__cri{depth}", F.when(box == "cri", groups))
    log = F.rtrim(F.coalesce(_text_at(json, "log"), F.lit("")), F.lit("\n"))
    inner = F.when(box == "docker_json", log).when(box == "cri", cri[3])
    df = add(df, f"__inner{depth}", inner)
    inner = F.col(f"__inner{depth}")
    return add(df, f"__text{depth + 1}", F.when(box.isNotNull(), S.clean(inner, inner=True)).otherwise(text))


def _unwrap_deeper(df: Steps) -> Steps:
    """Add ``__inmost``, the text within all containers, and ``__deep``: what containers below the static levels lay over it.

    Each container's text holds a mark of its own, so their number bounds the fold. Rows without such containers skip it.
    """
    text = F.col(f"__text{UNWRAP_DEPTH}")
    none = F.lit(None).cast("string")
    start = F.struct(
        text.alias("text"), F.lit(True).alias("live"), none.alias("label"), F.lit(False).alias("raised"), F.lit(False).alias("docker"),
        F.lit(False).alias("stderr"), text.alias("around"), F.lit("").alias("tail"), F.lit(None).cast("array<string>").alias("cri"),
    )

    def opened(state, line, json, docker, cri):
        log = F.rtrim(F.coalesce(_text_at(json, "log"), F.lit("")), F.lit("\n"))
        after = S.following_lines(state["text"], line)
        return F.struct(
            S.clean(F.when(docker, log).otherwise(cri[3]), inner=True).alias("text"), F.lit(True).alias("live"),
            F.coalesce(state["label"], F.when(docker, "docker_json").otherwise("cri")).alias("label"),
            (state["raised"] | (~docker & (cri[1] == "stderr"))).alias("raised"), docker.alias("docker"),
            (docker & (_text_at(json, "stream") == "stderr")).alias("stderr"), state["text"].alias("around"),
            F.when(docker, state["tail"]).otherwise(F.concat(F.coalesce(F.concat(F.lit("\n"), after), F.lit("")), state["tail"])).alias("tail"),
            F.coalesce(state["cri"], F.when(~docker, cri)).alias("cri"),
        )

    def with_json(state, line, json):
        docker = F.coalesce(_is_docker(json, line), F.lit(False))
        is_cri = json.isNull() & _starts_with_digit(line) & line.rlike(unicode_re(CRI))
        cri = F.when(is_cri, F.split(_layout_hit(line, CRI, "", ("$1", "$2", "$3", "$4")), MARK_OPEN, -1))
        ended = state.withField("live", F.lit(False))
        found = F.struct(docker.alias("docker"), cri.alias("cri"))
        return let(found, lambda x: F.when(x["docker"] | x["cri"].isNotNull(), opened(state, line, json, x["docker"], x["cri"])).otherwise(ended))

    def step(state, _):
        def with_line(line):
            return let(S.strip_column(line), lambda text: with_text(line, text))

        def with_text(line, text):
            return let(_as_list(text), lambda listed: let(_only_object(text, listed), lambda json: with_json(state, line, json)))

        return F.when(state["live"], let(S.first_line(state["text"]), with_line)).otherwise(state)

    marks = F.regexp_count(text, F.lit(CONTAINER_MARK))
    inside = F.col(f"__box{UNWRAP_DEPTH - 1}").isNotNull() & (marks > 0)
    df = add(df, "__deep", F.when(inside, F.aggregate(F.sequence(F.lit(1), marks), start, step)))
    return add(df, "__inmost", F.coalesce(F.col("__deep.text"), text))


def _wrap_deeper(df: Steps) -> Steps:
    deep = F.col("__deep")
    label, plain = deep["label"], F.coalesce(deep["docker"] & (F.col("__source_type") == "plain"), F.lit(False))
    raised = (deep["raised"] | (plain & deep["stderr"])) & (F.col("__level") == "INFO")
    message = F.when(plain, F.coalesce(S.null_if_empty(F.col("__inmost")), deep["around"])).otherwise(F.col("__message"))
    names = F.array(*[F.lit(n) for n in ("timestamp", "stream", "flag", "message")])
    return add(df, {
            "__level": F.when(raised, "ERROR").otherwise(F.col("__level")),
            "__service": F.when(~plain, F.col("__service")),
            "__message": F.when(label.isNotNull(), F.concat(message, deep["tail"])).otherwise(F.col("__message")),
            "__fields": F.when(deep["cri"].isNotNull(), F.map_from_arrays(names, deep["cri"])).otherwise(F.col("__fields")),
            "__source_type": F.coalesce(label, F.col("__source_type")),
        }
    )


def _wrap(df: Steps, depth: int) -> Steps:
    """Lay the container's own level, time and label over the parsed inner text."""
    text, line, json, box, cri = (F.col(f"__{c}{depth}") for c in ("text", "line", "json", "box", "cri"))
    inner = F.col(f"__text{depth + 1}")
    docker = box == "docker_json"
    plain_inside = docker & (F.col("__source_type") == "plain")
    stream = F.when(docker, F.coalesce(_text_at(json, "stream"), F.lit("stdout"))).otherwise(cri[1])
    # The level of a plain text is the one inferred from it, so it can be taken over as it is.
    raised = (plain_inside | (box == "cri")) & (F.col("__level") == "INFO") & (stream == "stderr")
    names = F.array(*[F.lit(n) for n in ("timestamp", "stream", "flag", "message")])
    return add(df, {
            "__level": F.when(raised, "ERROR").otherwise(F.col("__level")),
            "__service": F.when(~F.coalesce(plain_inside, F.lit(False)), F.col("__service")),
            "__message": F.when(plain_inside, F.when(inner != "", inner).otherwise(text))
            .when(box == "cri", F.concat_ws("\n", F.col("__message"), S.following_lines(text, line)))
            .otherwise(F.col("__message")),
            "__timestamp": F.when(docker, _text_at(json, "time"))
            .when(box == "cri", cri[0])
            .otherwise(F.col("__timestamp")),
            "__fields": F.when(box == "cri", F.map_from_arrays(names, cri)).otherwise(F.col("__fields")),
            "__source_type": F.coalesce(box, F.col("__source_type")),
        }
    )


# --- the innermost text -----------------------------------------------------------------------------------------


def _layout_hit(line: Column, pattern: str, flags: str, parts: tuple[str, ...]) -> Column:
    """One regex pass that turns a matching line into its laid-out parts."""
    return F.regexp_replace(line, unicode_re(pattern + r"[\s\S]*", flags), MARK_OPEN.join(parts))


def _shape_chain(line: Column, names: tuple[str, ...] | None = None) -> Column:
    """CASE over the line shapes in order; each row pays the regexes up to its own."""
    chain = F
    for shape in LINE_FORMATS:
        if names is not None and shape.name not in names:
            continue
        pairs = MARK_CLOSE.join(f"{name}{MARK_PAIR}${i}" for i, name in enumerate(shape.fields, 1))
        layout = (shape.name, *shape.layout, pairs)
        test = line.rlike(unicode_re(shape.pattern, shape.flags))
        test = F.col("__digit") & test if shape.digit else test
        chain = chain.when(test, _layout_hit(line, shape.pattern, shape.flags, layout))
    return F.lit(None).cast("string") if chain is F else chain


def _detect_innermost(df: Steps, source_type: str) -> Steps:
    """Add ``__json``, or ``__hit`` (the laid-out parts of a line shape), or ``__kv``; none of them means plain."""
    depth = UNWRAP_DEPTH
    df = add(df, "__line", S.first_line(F.col("__inmost")))
    line = F.col("__line")
    df = _with_json_object(df, "__deepest", line, F.col(f"__box{depth - 1}").isNotNull())
    known = [F.when(F.col(f"__box{d}").isNull(), F.col(f"__json{d}")) for d in range(depth)]
    df = add(df, {"__json": F.coalesce(*known, F.col("__deepest")), "__digit": _starts_with_digit(line), "__unsearched": _unsearched(line)})
    json, hit = F.col("__json"), F.col("__hit")

    shapes, pairs_allowed = _shape_chain(line), F.lit(True)
    if source_type != "auto":
        wrapped = F.col("__box0").isNotNull()
        forced = _shape_chain(line, FORCED_SHAPES.get(source_type, (source_type,)))
        may_wrap = source_type in ("json", "docker_json", "cri")
        shapes = F.when(wrapped, shapes).otherwise(forced) if may_wrap else forced
        pairs_allowed = wrapped if may_wrap else F.lit(source_type == "logfmt")
    df = add(df, "__hit", F.split(F.when(json.isNull(), shapes), MARK_OPEN, -1))
    pairs = F.when(json.isNull() & hit.isNull() & pairs_allowed & line.contains("="), S.key_value_pairs(line))
    df = add(df, "__pairs", pairs)
    df = add(df, "__kv", F.when(F.size("__pairs") >= 2, S.last_wins_map(F.col("__pairs"))))
    return add(df, "__kv", F.when(F.size("__kv") >= 2, F.col("__kv")))


def _read_innermost(df: Steps) -> Steps:
    """Read level, service, time, message and fields of the innermost text."""
    text, line = F.col("__inmost"), F.col("__line")
    json, hit, kv = F.col("__json"), F.col("__hit"), F.col("__kv")
    shape = hit[0]
    by_json, by_shape, by_kv = json.isNotNull(), hit.isNotNull(), kv.isNotNull()

    def kv_first(keys):
        return F.coalesce(*[S.null_if_empty(kv[k]) for k in keys])

    redis = F.when(hit[4].rlike(unicode_re(REDIS_ERROR, "i")), "ERROR").when(hit[2] == "#", "WARNING").otherwise("INFO")
    shape_word = (
        F.when(shape == "syslog_5424", L.level_from_priority(hit[2]))
        .when(shape == "redis", redis)
        .when(shape != "web_access", hit[2])
    )
    df = add(df, {
            "__status": F.when(by_json, _json_text(json, JSON_STATUS))
            .when(shape == "web_access", hit[2])
            .when(by_kv, kv_first(KV_STATUS)),
            "__word": F.when(by_json, _json_text(json, JSON_LEVEL)).when(by_kv, kv_first(KV_LEVEL)),
            # A level is inferred from the message of an old-style syslog line, and from the whole of a plain text.
            "__infer": F.when(shape == "syslog_3164", hit[4]).when(~(by_json | by_shape | by_kv), text),
            "__msg": F.when(by_json, _json_text(json, JSON_MESSAGE)).when(by_kv, kv_first(KV_MESSAGE)),
            "__stack": F.when(by_json, _json_text(json, JSON_STACK)),
        }
    )
    df = add(df, {
            "__msg": _spaced_if_nested(json, F.col("__msg"), JSON_MESSAGE),
            "__stack": S.null_if_empty(_spaced_if_nested(json, F.col("__stack"), JSON_STACK)),
            "__word": F.coalesce(
                F.when(by_shape & (shape != "syslog_3164"), shape_word),
                F.when(F.col("__infer").isNotNull(), L.inferred_word(F.col("__infer"))),
                S.null_if_empty(F.col("__word")),
                F.lit("INFO"),
            ),
        }
    )
    status, msg, stack = F.col("__status"), F.col("__msg"), F.col("__stack")
    json_message = F.coalesce(msg, S.strip(line))
    json_message = F.when(stack.isNotNull(), S.strip(F.concat_ws("\n", json_message, stack))).otherwise(json_message)
    method, path = (S.strip(F.coalesce(kv[k], F.lit(""))) for k in ("method", "path"))
    named = (S.null_if_empty(kv["method"]).isNotNull()) | (S.null_if_empty(kv["path"]).isNotNull())
    http = F.when(
        status.isNotNull() & named, S.strip(F.concat(F.lit("HTTP "), status, F.lit(" "), method, F.lit(" "), path))
    )
    head = (
        F.when(by_json, json_message)
        .when(by_shape, hit[4])
        .when(by_kv, F.coalesce(msg, http, line))
    )
    tail = F.when(F.coalesce(shape != "web_access", F.lit(True)), S.following_lines(text, line))
    label = reduce(lambda c, s: c.when(shape == s.name, s.source_type), LINE_FORMATS, F)
    groups = F.str_to_map(hit[5], F.lit(MARK_CLOSE), F.lit(MARK_PAIR))
    # A group that took no part in the match is empty here; only a message may be empty by itself.
    groups = F.transform_values(groups, lambda k, v: F.when((v != "") | (k == "message"), v))
    return add(df, {
            "__level": F.coalesce(L.level_from_status(status), L.normalize_level(F.col("__word"))),
            "__service": F.when(by_json, _json_text(json, JSON_SERVICE))
            .when(shape == "java", S.context_service(hit[3]))
            .when(by_shape, S.null_if_empty(hit[3]))
            .when(by_kv, S.first_non_duration(*[kv[k] for k in KV_SERVICE]))
            .otherwise(S.bracketed_name(line)),
            "__timestamp": F.when(by_json, _json_text(json, JSON_TIMESTAMP))
            .when(by_shape, hit[1])
            .when(by_kv, kv_first(KV_TIMESTAMP)),
            "__message": F.when(by_json | by_shape | by_kv, F.concat_ws("\n", head, tail)).otherwise(text),
            "__source_type": F.when(by_json, "json").when(by_shape, label).when(by_kv, "logfmt").otherwise("plain"),
            "__fields": F.when(by_shape, groups).when(by_kv, kv),
        }
    )


def _paths(key: str) -> list[tuple[str, ...]]:
    return [(key,), tuple(key.split("."))] if "." in key else [(key,)]


def _json_values(json: Column, keys: tuple[str, ...], kind: str) -> list[Column]:
    """The innermost line's values at all paths of the keys."""
    return [_at(json, p, kind, F.col("__line"), F.col("__unsearched")) for k in keys for p in _paths(k)]


def _json_text(json: Column, keys: tuple[str, ...]) -> Column:
    """First non-null of the paths as text."""
    return F.coalesce(*_json_values(json, keys, "string"))


def _spaced_if_nested(json: Column, text: Column, keys: tuple[str, ...]) -> Column:
    """Write an object or list with a blank after each comma and colon; a string stays as it is."""
    values = _json_values(json, keys, "variant")
    first = F.get(F.filter(F.array(*values), lambda v: v.isNotNull() & ~F.is_variant_null(v)), F.lit(0))
    # Of a NULL text the type would be looked up too: only FALSE ends an AND.
    nested = F.coalesce(text.substr(1, 1).isin("{", "[") & json.isNotNull(), F.lit(False))
    return F.when(nested & (F.schema_of_variant(first) != "STRING"), S.spaced_json(text)).otherwise(text)
