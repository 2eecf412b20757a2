"""String helpers shared by the operators: whitespace, lines, quoting, keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode noncharacters: they never occur in interchanged text, so they are safe as inner separators.
MARK_SEP = "\ufdd0"
MARK_OPEN = "\ufdd1"
MARK_CLOSE = "\ufdd2"
MARK_PAIR = "\ufdd3"
MARKS = MARK_SEP + MARK_OPEN + MARK_CLOSE + MARK_PAIR

# Marks that a text holds itself are written as an escape and a stand-in, both noncharacters too, and restored in the output.
MARK_ESCAPE = "\ufdd4"
_STAND_IN = {mark: MARK_ESCAPE + chr(0xFDE0 + k) for k, mark in enumerate((*MARKS, MARK_ESCAPE))}

# The characters that count as white space, and those that end a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ANY_LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NOT_LINE_END = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WS_CLASS = r"[\s\x1c-\x1f]"
UNCLEAN = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029\ufdd0-\ufdd4]"

# The key=value shape and the shapes of service names and durations.
KEY_VALUE = r"""([A-Za-z_][\w.\-]*)=("[^"]*"|'[^']*'|[^\s]+)"""
BRACKETED_NAME = r"\[([A-Za-z][\w.\-]{1,80})\]"
DURATION_VALUE = r"^\d+(?:\.\d+)?(?:ms|s|m|h)$"


def unicode_re(pattern: str, flags: str = "") -> str:
    r"""Give ``\w \d \s \b`` their Unicode meaning and let only ``\n`` end a line for ``. ^ $``."""
    return f"(?dU{flags})" + pattern


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


# Trimming by a set lists every character of a text first. For plain columns, which cost nothing to read twice, an end is looked at before.


def strip_column(col: Column) -> Column:
    ends = F.substring(col, 1, 1).isin(*WHITESPACE) | F.substring(col, -1, 1).isin(*WHITESPACE)
    return F.when(ends, strip(col)).otherwise(col)


def rstrip_column(col: Column) -> Column:
    return F.when(F.substring(col, -1, 1).isin(*WHITESPACE), rstrip(col)).otherwise(col)


def null_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def clean(col: Column, inner: bool = False) -> Column:
    """Only ``\\n`` as line end, and the inner separators, should a text hold them, escaped. One scan if neither occurs.

    ``inner`` text stems from text that is escaped already: only marks that its decoding brought in are escaped.
    """
    ends = F.regexp_replace(col, LINE_END, "\n")
    unclean = col.rlike(r"[^ -~\t\n]") & col.rlike(UNCLEAN)
    return F.when(unclean, _stand_ins(ends, not inner)).otherwise(col)


def _stand_ins(col: Column, with_escape: bool) -> Column:
    for mark in (MARK_ESCAPE, *MARKS) if with_escape else MARKS:
        col = F.replace(col, F.lit(mark), F.lit(_STAND_IN[mark]))
    return col


def escape_marks(col: Column, with_escape: bool = True) -> Column:
    """The text with its own marks, if any, as stand-ins."""
    return F.when(col.rlike("[\ufdd0-\ufdd4]"), _stand_ins(col, with_escape)).otherwise(col)


def restore_marks(col: Column) -> Column:
    """The text with its stand-ins as the marks they stand for."""
    out = col
    for mark in (*MARKS, MARK_ESCAPE):
        out = F.replace(out, F.lit(_STAND_IN[mark]), F.lit(mark))
    return F.when(col.contains(MARK_ESCAPE), out).otherwise(col)


def folded(col: Column) -> Column:
    """Lower case for cheap ``contains`` tests before a case-blind regex; letters that fold to ASCII ones included."""
    return F.lower(F.when(col.rlike("[\\u0130\\u0131\\u017f]"), F.translate(col, "\u0130\u0131\u017f", "iis")).otherwise(col))


def occurrences(col: Column, text: str) -> Column:
    """How often a one-character text occurs."""
    return F.length(col) - F.length(F.replace(col, F.lit(text)))


def split_lines(col: Column) -> Column:
    """Array of lines; the empty piece after a final line end is dropped."""
    pieces = F.split(col, LINE_END, -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def split_lines_with_ends(col: Column) -> Column:
    """Array of lines, each with its own line end."""
    line = rf"{NOT_LINE_END}*+(?:{LINE_END})|{NOT_LINE_END}++$"
    return F.regexp_extract_all(col, F.lit(line), F.lit(0))


def first_line(col: Column) -> Column:
    """First line of a clean text."""
    return F.substring_index(col, "\n", 1)


def following_lines(col: Column, first: Column) -> Column:
    """Lines two and later of a clean text; NULL for one line."""
    return F.when(col.contains("\n"), col.substr(F.length(first) + 2, F.length(col)))


def unquote(col: Column) -> Column:
    return F.regexp_replace(col, r"""(?s)^(["'])(.*)\1$""", "$2")


def key_value_pairs(col: Column) -> Column:
    """``array<struct<k,v>>`` of all key=value pairs, values without their quotes."""

    def pair(found):
        key = F.substring_index(found, "=", 1)
        value = found.substr(F.length(key) + 2, F.length(found))
        quoted = value.startswith('"') | value.startswith("'")
        return F.struct(key.alias("k"), F.when(quoted, unquote(value)).otherwise(value).alias("v"))

    return F.transform(F.regexp_extract_all(col, F.lit(unicode_re(KEY_VALUE)), F.lit(0)), pair)


def last_wins_map(pairs: Column) -> Column:
    """Map of ``array<struct<k,v>>`` where the last of equal keys wins, whatever the session's policy is."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]),
        )
    )


def bracketed_name(col: Column) -> Column:
    return null_if_empty(F.regexp_extract(col, unicode_re(BRACKETED_NAME), 1))


def context_service(col: Column) -> Column:
    """Service of a logger context: a bracketed name, else the last word if it has a dot."""
    last = F.element_at(F.split(strip(col), unicode_re(WS_CLASS + "+")), -1)
    return F.coalesce(bracketed_name(col), F.when(last.contains("."), last))


def first_non_duration(*cols: Column) -> Column:
    return F.coalesce(*[F.when((c != "") & ~c.rlike(unicode_re(DURATION_VALUE)), c) for c in cols])


def spaced_json(col: Column) -> Column:
    """Put a blank after each ``,`` and ``:`` outside the strings of a compact JSON text."""
    return F.regexp_replace(
        col, r'\G((?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^",:])*+)([,:])', "$1$2 "
    )
