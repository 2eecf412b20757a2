"""A line as a list of segments: fixed text, text to be searched, and values whose field name gives them away.

``segments`` is ``array<struct<pre, txt, cat, post>>``. A line is put together again as ``pre + result + post`` of each
segment, where the result of a segment without ``txt`` is empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions import text as S
from emberlog.functions.plan import Steps, add, let
from emberlog.functions.secrets import hinted_category, key_hint
from emberlog.functions.text import KEY_VALUE, MARK_CLOSE, MARK_OPEN, MARK_SEP, WS_CLASS, unicode_re

JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
JSON_TOKEN = JSON_STRING + r'|[{}\[\],:]|[^\s{}\[\],:"]++'
# A line that may be JSON as a whole: an object, a list, a string, a number or a word.
JSON_LIKE = r'^(?:\{.*\}|\[.*\]|".*"|-?[0-9][0-9.eE+-]*|true|false|null)$'
#: Tokens of a JSON line that are folded together.
TOKEN_BLOCK = 512
SEGMENT = "array<struct<pre:string,txt:string,cat:string,post:string>>"


def write_segments(steps: Steps) -> None:
    """Write the steps that add ``kind`` (blank, json, logfmt, text) and ``__segments`` to lines."""
    line = F.col("__line")
    add(steps, "__line", S.escape_marks(F.col("line")))
    text = F.trim(line, F.lit(" \t\r\n"))
    add(steps, "__list", F.when(text.rlike("(?s)" + JSON_LIKE), F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))))
    )
    alone = F.try_variant_get("__list", "$[1]", "variant").isNull()
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}"))).isNotNull()
    is_json = F.col("__list").isNotNull() & alone & (~line.contains("]") | keyed)
    # One search lays the line out as gap, key and value, gap, and so on.
    laid = F.regexp_replace(line, unicode_re(KEY_VALUE), f"{MARK_OPEN}$1{MARK_CLOSE}$2{MARK_OPEN}")
    add(steps, "__cut", F.when(line.contains("=") & ~F.coalesce(is_json, F.lit(False)), F.split(laid, MARK_OPEN, -1)))
    cut = F.col("__cut")
    rest = F.array_join(F.filter(cut, lambda _, i: i % 2 == 0), "")
    is_pairs = (F.size(cut) >= 5) & ~rest.rlike(unicode_re(r"[^\s\x1c-\x1f]"))
    add(steps, "kind",
        F.when(S.strip_column(line) == "", "blank").when(is_json, "json").when(is_pairs, "logfmt").otherwise("text"),
    )
    kind = F.col("kind")
    add(steps, "__tokens", F.when(kind == "json", F.regexp_extract_all(line, F.lit(JSON_TOKEN), F.lit(0))))
    add(steps, "__keys", F.when(kind == "json", _token_keys(line, F.col("__tokens"))))
    # Hints are looked up once per value here; later steps only read them.
    hinted = F.when(kind == "json", _hinted_tokens(F.col("__tokens"), F.col("__keys")))
    add(steps, "__hinted", hinted.otherwise(F.when(kind == "logfmt", _hinted_pairs(cut))))
    segments = (
        F.when(kind == "json", _json_segments(F.col("__hinted")))
        .when(kind == "logfmt", _pair_segments(cut, F.col("__hinted")))
        .when(kind == "text", F.array(_segment(F.lit(""), line)))
        .otherwise(F.array(_segment(line)))
    )
    add(steps, "__segments", segments.cast(SEGMENT))


def searchable(segments: Column) -> Column:
    """All texts to be searched in one string; the separator keeps the place of every segment."""
    return F.array_join(
        F.transform(segments, lambda s: F.when(s["cat"].isNull(), F.coalesce(s["txt"], F.lit(""))).otherwise("")), MARK_SEP
    )


def reassembled(kind: Column, segments: Column, results: Column) -> Column:
    """The line from its segments and their results (an array of the same length)."""
    plain = F.transform(segments, lambda s, i: F.concat(s["pre"], results[i], s["post"]))
    quoted = F.transform(segments, lambda s, i: F.concat(s["pre"], json_escaped(results[i]), s["post"]))
    return F.when(kind == "text", results[0]).otherwise(
        F.array_join(F.when(kind == "json", quoted).otherwise(plain), "")
    )


def _segment(pre, txt=None, cat=None, post=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        pre.alias("pre"),
        (null if txt is None else txt).alias("txt"),
        (null if cat is None else cat).alias("cat"),
        (F.lit("") if post is None else post).alias("post"),
    )


def _hinted_pairs(cut: Column) -> Column:
    def one(pair):
        key, raw = F.substring_index(pair, MARK_CLOSE, 1), F.substring_index(pair, MARK_CLOSE, -1)
        quoted = raw.startswith('"') | raw.startswith("'")
        text = F.when(quoted, S.unquote(raw)).otherwise(raw)
        return F.struct(key.alias("token"), raw.alias("raw"), text.alias("text"), key_hint(key).alias("hint"))

    return F.transform(F.filter(cut, lambda _, i: i % 2 == 1), one)


def _pair_segments(cut: Column, hinted: Column) -> Column:
    def one(p, i):
        quote = F.when(F.length(p["raw"]) > F.length(p["text"]), F.left(p["raw"], F.lit(1))).otherwise("")
        before = F.concat(F.get(cut, i * 2), p["token"], F.lit("="), quote)
        return _segment(before, p["text"], hinted_category(p["hint"], p["text"]), quote)

    return F.concat(F.transform(hinted, one), F.array(_segment(F.element_at(cut, -1))))


# --- JSON -------------------------------------------------------------------------------------------------------


def _token_keys(line: Column, tokens: Column) -> Column:
    """For each token the key token it stands under, or NULL.

    Without lists that is the string before the colon. With lists the tokens are folded with a stack of keys: elements
    stand under the key of their list, an object inside a list starts afresh. Keys are named by their place, and the places
    found are one text: a fold copies its state at every step, and an array of strings is copied string by string. The fold fills
    blocks of ``TOKEN_BLOCK`` tokens and only adds up the full blocks.
    """
    direct = F.transform(
        tokens, lambda x, i: F.when(F.get(tokens, i - 1) == ":", F.get(tokens, i - 2))
    )
    nowhere = F.lit(None).cast("int")

    def state(stack, key, out):
        return F.struct(stack.alias("stack"), key.alias("key"), out.alias("out"))

    def moved(s, token, at, out):
        depth = F.size(s["stack"])
        return (
            F.when(token.isin("{", "["), state(F.concat(s["stack"], F.array(s["key"])), F.when(token == "[", s["key"]), out))
            .when(token.isin("}", "]"), state(F.slice(s["stack"], 1, F.greatest(depth - 1, F.lit(0))), F.get(s["stack"], depth - 1), out))
            .otherwise(state(s["stack"], at - 1, out))
        )

    def step(s, at):
        out = F.concat(s["out"], F.coalesce(s["key"].cast("string"), F.lit("")), F.lit(","))
        token = F.get(tokens, at)
        return F.when(token.isin("{", "[", "}", "]", ":"), moved(s, token, at, out)).otherwise(state(s["stack"], s["key"], out))

    def block(s, first):
        places = F.sequence(first, F.least(first + (TOKEN_BLOCK - 1), F.size(tokens) - 1))
        filled = F.aggregate(places, state(s["stack"], s["key"], F.lit("")), step)
        return let(filled, lambda t: state(t["stack"], t["key"], F.concat(s["out"], t["out"])))

    start = state(F.array().cast("array<int>"), nowhere, F.lit(""))
    folded = F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(TOKEN_BLOCK)), start, block, lambda s: F.split(s["out"], ","))
    keys = F.transform(folded, lambda place: F.when(place != "", F.get(tokens, place.cast("int"))))
    return F.when(line.contains("["), keys).otherwise(direct)


def _hinted_tokens(tokens: Column, keys: Column) -> Column:
    """Each token with its role: a key, a value with its text and hint, or anything else (no text)."""

    def one(token, i):
        is_key = F.get(tokens, i + 1) == ":"
        fixed = token.isin("{", "}", "[", "]", ",", ":", "null")
        key = keys[i]
        hint = F.when(~fixed & key.isNotNull() & (key != '""'), key_hint(json_text(key)))
        text = F.when(token.startswith('"'), json_text(token)).otherwise(token)
        return F.struct(
            token.alias("token"),
            F.when(is_key, "key").alias("raw"),
            F.when(~fixed, text).alias("text"),
            F.when(~F.coalesce(is_key, F.lit(False)), hint).alias("hint"),
        )

    return F.transform(tokens, one)


def _json_segments(hinted: Column) -> Column:
    quote = F.lit('"')

    def one(t):
        is_string = t["token"].startswith('"')
        return (
            F.when(t["text"].isNull(), _segment(t["token"]))
            .when(t["raw"] == "key", _segment(F.concat(quote, json_escaped(t["text"]), quote)))
            .when(is_string | t["hint"].isNotNull(), _segment(quote, t["text"], hinted_category(t["hint"], t["text"]), quote))
            .otherwise(_segment(t["token"]))
        )

    return F.transform(hinted, one)


def json_text(token: Column) -> Column:
    """Text of a JSON string token."""
    decoded = F.try_variant_get(F.try_parse_json(token), "$", "string")
    decoded = S.escape_marks(decoded, with_escape=False)
    return F.when(token.contains("\\"), decoded).otherwise(token.substr(F.lit(2), F.length(token) - 2))


def json_escaped(text: Column) -> Column:
    """Text inside the quotes of a JSON string: only quotes, backslashes and control characters are escaped."""
    names = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(names.get(code, f"\\u{code:04x}")))
    return F.when(text.rlike(r'["\\\x00-\x1f]'), out).otherwise(text)
