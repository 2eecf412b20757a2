"""Lines with known secrets rendered from ``events`` (Spark), and the SQL for their sanitised form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.secrets import TEXT_RULES

KINDS = ("json", "logfmt", "text")
USER = "CAST(user_id AS STRING)"
EVENT = "CAST(event_id AS STRING)"
EMAIL = f"'user' || {USER} || '@example.com'"
IP = f"'10.0.' || {USER} || '.9'"
TOKEN = f"'tok' || {EVENT}"
REQUEST = f"'req-' || {EVENT}"
PASSWORD = f"'pw' || CAST(user_id % 10 AS STRING) || '!'"
SESSION = f"'sess-' || {EVENT}"


def secret_line(kind: str) -> Column:
    e, lit = F.expr, F.lit
    if kind == "logfmt":
        return F.concat(
            lit("zone=b client_ip="), e(IP), lit(" token="), e(TOKEN), lit(" upstream="), e(IP), lit(" belt=7 request_id="), e(REQUEST),
            lit(' owner.x=none email="'), e(EMAIL), lit('"'),
        )
    if kind == "json":
        return F.concat(
            lit('{"level": "info", "user_email" : "'), e(EMAIL), lit('", "meta": {"password": "'), e(PASSWORD),
            lit('", "n": '), e(EVENT), lit('}, "tags": ["x", {"ip": "'), e(IP), lit('"}, "seen '), e(IP),
            lit(' é"], "client-id": '), e(USER), lit(', "ok": true, "none": null}'),
        )
    return F.concat(
        lit("login by "), e(EMAIL), lit(" from "), e(IP), lit(" password = "), e(PASSWORD), lit(" session_id: "),
        e(SESSION), lit("; Authorization: Bearer ab.cd-"), e(USER),
    )


# Category and value of each find, in the order values are met within a line.
FINDS = {
    "logfmt": (("IP_ADDRESS", IP), ("API_KEY", TOKEN), ("IP_ADDRESS", IP), ("REQUEST_ID", REQUEST), ("EMAIL", EMAIL)),
    "json": (("EMAIL", EMAIL), ("PASSWORD", PASSWORD), ("IP_ADDRESS", IP), ("IP_ADDRESS", IP), ("CLIENT_ID", USER)),
    "text": (
        ("BEARER_TOKEN", f"'ab.cd-' || {USER}"), ("PASSWORD", PASSWORD), ("EMAIL", EMAIL), ("SESSION_ID", SESSION),
        ("IP_ADDRESS", IP),
    ),
}


def _expected_text(kind: str, p: dict[str, str]) -> str:
    if kind == "logfmt":
        return (
            f"'zone=b client_ip=' || {p['IP_ADDRESS']} || ' token=' || {p['API_KEY']} || ' upstream=' || {p['IP_ADDRESS']} "
            f"|| ' belt=7 request_id=' || {p['REQUEST_ID']} || ' owner.x=none email=\"' || {p['EMAIL']} || '\"'"
        )
    if kind == "json":
        return (
            f"'{{\"level\":\"info\",\"user_email\":\"' || {p['EMAIL']} || '\",\"meta\":{{\"password\":\"' || {p['PASSWORD']} "
            f"|| '\",\"n\":' || {EVENT} || '}},\"tags\":[\"x\",{{\"ip\":\"' || {p['IP_ADDRESS']} || '\"}},\"seen ' || {p['IP_ADDRESS']} "
            f"|| ' é\"],\"client-id\":\"' || {p['CLIENT_ID']} || '\",\"ok\":true,\"none\":null}}'"
        )
    return (
        f"'login by ' || {p['EMAIL']} || ' from ' || {p['IP_ADDRESS']} || ' password = ' || {p['PASSWORD']} || ' session_id: ' "
        f"|| {p['SESSION_ID']} || '; Authorization: Bearer ' || {p['BEARER_TOKEN']}"
    )


def expected_line(kind: str, suffix: str) -> str:
    values = dict(FINDS[kind])
    if suffix == "mask":
        p = {c: f"'<{c}>'" for c in values}
        return f"SELECT event_id, '{kind}' AS kind, {_expected_text(kind, p)} AS sanitized FROM events"
    if suffix == "hash":
        p = {c: f"('<{c}:' || left(sha256({v}), 8) || '>')" for c, v in values.items()}
        return f"SELECT event_id, '{kind}' AS kind, {_expected_text(kind, p)} AS sanitized FROM events"
    # Numbers by first occurrence of the value.
    ctes, joins, p = [], [], {}
    for c, v in values.items():
        ctes.append(
            f"n_{c} AS (SELECT v, row_number() OVER (ORDER BY first) AS k FROM "
            f"(SELECT {v} AS v, min(event_id) AS first FROM events GROUP BY 1))"
        )
        joins.append(f"JOIN n_{c} ON n_{c}.v = {v}")
        p[c] = f"('<{c}:' || CAST(n_{c}.k AS STRING) || '>')"
    return (
        f"WITH {', '.join(ctes)} SELECT event_id, '{kind}' AS kind, {_expected_text(kind, p)} AS sanitized "
        f"FROM events {' '.join(joins)}"
    )


_LOGFMT_FINDS = " UNION ALL ".join(
    f"SELECT event_id, {i} AS i, '{c}' AS category, {v} AS v FROM events" for i, (c, v) in enumerate(FINDS["logfmt"])
)
SUMMARY = "SELECT count(*) AS total_lines, count(*) AS transformed_lines, 5 * count(*) AS total_matches FROM events"
CATEGORIES = f"SELECT category, count(*) AS n FROM ({_LOGFMT_FINDS}) GROUP BY 1"
EXAMPLES = f"""WITH f AS ({_LOGFMT_FINDS}),
  seen AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY event_id, i) AS k FROM f),
  numbers AS (SELECT category, v, row_number() OVER (PARTITION BY category ORDER BY min(event_id * 10 + i)) AS number FROM f GROUP BY 1, 2)
  SELECT CAST(row_number() OVER (ORDER BY event_id, i) AS INTEGER) AS n, category,
    CASE WHEN length(v) <= 4 THEN '***' ELSE left(v, 2) || '***' || right(v, 2) END AS original_preview,
    '<' || category || ':' || CAST(number AS STRING) || '>' AS replacement_preview
  FROM seen JOIN numbers USING (category, v) WHERE k <= 3"""


def then_line() -> Column:
    return F.concat(
        F.lit('level=error app=shop msg="payment of '), F.expr(EMAIL), F.lit(" refused by "), F.expr(IP),
        F.lit('" card="4111 1111 1111 1111"'),
    )


THEN_ANALYZE = (
    "SELECT 1 AS rank, 'payment of <EMAIL> refused by <IP_ADDRESS>' AS pattern, count(*) AS n, 'UNKNOWN' AS classification FROM events"
)

# --- documents: the rules in DuckDB's own regex engine -------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _luhn(digits: str) -> str:
    """Check digit by list arithmetic, from the right: every second digit doubled."""
    d = f"list_reverse(string_split({digits}, ''))"
    one = "(CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(x AS INTEGER) > 9 THEN 2 * CAST(x AS INTEGER) - 9 ELSE 2 * CAST(x AS INTEGER) END ELSE CAST(x AS INTEGER) END)"
    return f"(list_sum(list_transform({d}, lambda x, i: {one})) % 10 = 0)"


def documents_sql(what: str) -> str:
    """Line by line, the rules one after another; each step also counts its finds."""
    steps = [
        "l0 AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM (SELECT doc_id, "
        "CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS p FROM documents)))",
        "s0 AS (SELECT doc_id, line_no, line, line AS t FROM l0)",
    ]
    counts = []
    for number, rule in enumerate(TEXT_RULES, 1):
        flags = "gi" if rule.flags else "g"
        before = f"s{number - 1}"
        pattern = _quoted(f"({rule.before})({rule.value})({rule.after})")
        if rule.card:
            found = f"list_filter(regexp_extract_all(t, {pattern}, 0), lambda c: {_luhn('regexp_replace(c, ' + _quoted('[^0-9]') + ', ' + _quoted('') + ', ' + _quoted('g') + ')')})"
            new = f"list_reduce(list_prepend(t, {found}), lambda a, c: replace(a, c, '<{rule.category}>'))"
            # This engine's word boundary knows ASCII letters only: before any other letter the blank belongs to the match too.
            new = f"regexp_replace({new}, '(<{rule.category}>)[ -]([^\\x00-\\x7F])', '\\1\\2', 'g')"
            count = f"len({found})"
        else:
            new = f"regexp_replace(t, {pattern}, {_quoted(chr(92) + '1<' + rule.category + '>' + chr(92) + '3')}, '{flags}')"
            count = f"len(regexp_extract_all(t, {_quoted('(?i)' if rule.flags else '')} || {pattern}, 0))"
        old = "".join(f", c{k}" for k in range(1, number))
        steps.append(f"s{number} AS MATERIALIZED (SELECT doc_id, line_no, line, {new} AS t{old}, {count} AS c{number} FROM {before})")
        counts.append((rule.category, f"c{number}"))
    last = f"s{len(TEXT_RULES)}"
    head = "WITH " + ", ".join(steps)
    if what == "sanitized":
        return f"{head} SELECT doc_id, line_no, t AS sanitized FROM {last}"
    total = " + ".join(c for _, c in counts)
    if what == "summary":
        return (
            f"{head} SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(line, '\\S') THEN 1 ELSE 0 END) AS BIGINT) AS total_lines, "
            f"CAST(sum(CASE WHEN t <> line THEN 1 ELSE 0 END) AS BIGINT) AS transformed_lines, "
            f"CAST(sum({total}) AS BIGINT) AS total_matches FROM {last} GROUP BY 1"
        )
    parts = " UNION ALL ".join(f"SELECT '{c}' AS category, {col} AS n FROM {last}" for c, col in counts)
    return f"{head} SELECT category, CAST(sum(n) AS BIGINT) AS n FROM ({parts}) GROUP BY 1 HAVING sum(n) > 0"


LUHN = f"SELECT o_orderkey, {_luhn(chr(39) + '4' + chr(39) + ' || lpad(CAST(o_orderkey * 7919 + o_custkey AS STRING), 15, ' + chr(39) + '0' + chr(39) + ')')} AS valid FROM orders"
