"""Masking of variable values, which turns a message into a stable failure pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.plan import Steps, add
from emberlog.functions.text import WS_CLASS, folded, occurrences, strip, unicode_re

# Fixed values, applied in this order: (pattern, flags, replacement).
MASKS = (
    (r"https?://[^\s\"']+", "i", "<URL>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "i", "<UUID>"),
    (r"\btrace[_-]?id[:=]\w[\w.\-]*", "i", "trace_id=<ID>"),
    (r"\bspan[_-]?id[:=]\w[\w.\-]*", "i", "span_id=<ID>"),
    (r"\bcorrelation[_-]?id[:=]\w[\w.\-]*", "i", "correlation_id=<ID>"),
    (r"\brequest[_-]?id[:=]\w[\w.\-]*", "i", "request_id=<ID>"),
    (r"\buser[_-]?id[:=]\w[\w.\-]*", "i", "user_id=<ID>"),
    (r"\b(?:req|txn|tx|session|client|order|bet)-[A-Za-z0-9_.-]+\b", "i", "<ID>"),
    (r"\b\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\b", "", "<TIMESTAMP>"),
    (r"\b\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+\-]\d{4}\b", "", "<TIMESTAMP>"),
    (r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b", "", "<TIMESTAMP>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "", "<DATE>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b", "", "<IP>:<PORT>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "", "<IP>"),
    (
        r"\b(?:[a-z0-9](?:[-a-z0-9]*[a-z0-9])?\.)+[a-z][a-z0-9-]{1,}(?::\d{2,5})?\b",
        "i",
        "<HOST>",
    ),
    (r"(?<=/)\d{2,}(?=/|$)", "", "<NUMBER>"),
    (r"\b\d+(?:\.\d+)?(?:ms|s|sec|msec|seconds)\b", "i", "<DURATION>"),
    (r"\b\d+(?:\.\d+)?(?:KiB|MiB|GiB|KB|MB|GB|bytes)\b", "i", "<SIZE>"),
    (r"\b[0-9a-f]{16,}\b", "i", "<HEX>"),
    (
        r"\b(request|trace|span|correlation|session|user|client|order|bet)[-_ ]?id[:=][\w.\-]+",
        "i",
        "$1_id=<ID>",
    ),
    (r"\b(id|uid)=\w[\w.\-]*", "i", "$1=<ID>"),
    (r"\b\d{4,}\b", "", "<NUMBER>"),
    (r"^\s+at\s+[\w.$_]+\(.*?\)$", "m", " at <STACK_FRAME>"),
    (r'^File ".*?", line \d+, in .*$', "m", "File <PYTHON_FRAME>"),
    (r"^\s*\.\.\. \d+ more$", "m", "... <STACK_FRAMES> more"),
)

# What makes a record an error event.
ERROR_LEVELS = ("WARNING", "ERROR", "FATAL", "CRITICAL")
ERROR_WORD = (
    r"\b(error|exception|failed|failure|timeout|timed out|refused|denied|forbidden|unauthorized"
    r"|oomkilled|bad gateway|crashloopbackoff|deadlock|no space left|too many connections"
    r"|certificate|x509)\b"
)


# Runs of neighbouring masks that share a cheap test, as (first, last, test of the folded text). A test only says where
# the masks cannot fire: what they look for must be in the message itself, the tokens of earlier masks never supply it.
def _tests(low: Column, digit: Column) -> tuple[tuple[int, int, Column | None], ...]:
    named = ("req-", "txn-", "tx-", "session-", "client-", "order-", "bet-")
    any_named = reduce(lambda a, b: a | b, [low.contains(n) for n in named])
    return (
        (1, 1, low.contains("://")),
        (2, 2, occurrences(low, "-") >= 4),
        (3, 7, low.contains("id:") | low.contains("id=")),
        (8, 8, any_named),
        (9, 12, digit),
        (13, 14, occurrences(low, ".") >= 3),
        (15, 15, low.contains(".")),
        (16, 18, digit),
        (19, 19, None),
        (20, 21, low.contains("id:") | low.contains("id=")),
        (22, 22, digit),
        (23, 25, low.contains("\n") | low.startswith('file "') | low.startswith("...")),
    )


def _masked(col: Column, first: int, last: int) -> Column:
    for pattern, flags, replacement in MASKS[first - 1 : last]:
        col = F.regexp_replace(col, unicode_re(pattern, flags), replacement)
    return col


def _squeezed(col: Column) -> Column:
    return strip(F.regexp_replace(col, unicode_re(WS_CLASS + "+"), " "))


def normalize_message(col: Column) -> Column:
    """The message with ids, times, addresses, numbers and stack frames replaced by tokens, as one expression."""
    return _squeezed(_masked(strip(col), 1, len(MASKS)))


def write_normalized(steps: Steps, name: str, message: Column) -> None:
    """Write the steps that add the normalised message; cheap tests skip masks, which is much faster on large inputs."""
    col, low, digit = F.col(name), F.col("__low"), F.col("__has_digit")
    add(steps, name, strip(message))
    add(steps, {"__low": folded(col), "__has_digit": col.rlike(unicode_re(r"\d"))})
    for first, last, test in _tests(low, digit):
        masked = _masked(col, first, last)
        add(steps, name, masked if test is None else F.when(test, masked).otherwise(col))
    add(steps, name, _squeezed(col))


def is_error_event(level: Column, message: Column) -> Column:
    return level.isin(*ERROR_LEVELS) | message.rlike(unicode_re(ERROR_WORD, "i"))
