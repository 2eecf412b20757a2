import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions import levels as L
from emberlog.functions.patterns import normalize_message
from emberlog.operators import classify as C
from emberlog.operators import groups as G
from emberlog.operators.formats import parse_records
from emberlog.operators.records import records_from_files, records_from_lines, records_from_text
from emberlog.plans.analyze import analyze
from emberlog.session import JIT_METHOD_BYTES, configure
from emberlog.sources.rules import load_rules, make_rules, rules_table
from emberlog.sources.text import file_lines, spread, table_lines
from tests.samples import ANALYSIS


def text_records(spark, *texts):
    configure(spark)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    return records_from_text(df, "text", "id")


def parse(spark, *records, source_type="auto"):
    configure(spark)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "pos long, raw string")
    return [r.asDict() for r in parse_records(df, source_type).drop("payload").orderBy("pos").collect()]


def test_sample_end_to_end(spark):
    result = analyze(text_records(spark, ANALYSIS), max_groups=30)
    s = result.summary.collect()[0]
    assert (s.total_lines, s.parsed_lines, s.error_events, s.unique_patterns) == (27, 20, 16, 8)
    assert (s.dominant_issue, s.dominant_percentage) == ("panic: belt index <NUMBER> out of reach", 25.0)
    groups = {g.rank: g for g in result.groups.collect()}
    assert groups[1]["count"] == 4 and groups[1].service == "conveyor" and groups[1].classification == "APPLICATION_ERROR"
    assert [e[:33] for e in groups[1].examples] == [f"<11>1 2026-11-03T02:10:1{k}Z dock{k} " for k in range(3)]
    assert groups[3].service == "multiple" and groups[3].source_type == "java" and "Caused by" in groups[3].pattern
    assert groups[5].pattern == "could not extend file HINT: Check free disk space."
    insights = result.insights.orderBy("rank").collect()
    assert [i.classification for i in insights] == ["APPLICATION_ERROR", "TLS_CERTIFICATE_ERROR", "DATABASE_ERROR", "GATEWAY_ERROR", "RESOURCE_EXHAUSTION"]
    assert [i.rank for i in insights] == [1, 2, 3, 4, 5] and insights[0].possible_causes
    sources = {r.source_type: r.n for r in result.source_types.collect()}
    assert sources == {"mysql": 1, "postgres": 2, "java": 3, "syslog": 5, "logfmt": 3, "docker_json": 2, "web_access": 2, "cri": 1, "plain": 1}


def test_records_same_from_text_lines_and_files(spark, tmp_path):
    text = "   at odd.start(X)\nDETAIL: more\n" + (ANALYSIS + "\n\n") * 40
    want = [r.raw for r in text_records(spark, text).orderBy("pos").collect()]
    df = spark.createDataFrame([(0, text)], "id long, text string")
    lines = table_lines(df, "text", F.lit("all"))
    for width in (1, 3, 7, 100_000):
        got = records_from_lines(lines, F.floor(F.col("pos") / width)).orderBy("pos").collect()
        assert [r.raw for r in got] == want
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "app.log").write_text(text)
    (tmp_path / "skip.bin").write_text("not a log")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "3000b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = records_from_files(file_lines(spark, str(tmp_path))).orderBy("pos").collect()
            assert [r.raw for r in got] == want
            assert sum(r.n_lines for r in got) == len([x for x in text.splitlines() if x.strip()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_read_once_for_all_results(spark, tmp_path, monkeypatch):
    from emberlog.operators import counts, records

    (tmp_path / "a.log").write_text(ANALYSIS)
    ran = []

    def spied(df, name, by=None, real=records.staged):
        ran.append((name, physical(df)))
        return real(df, name, by)

    monkeypatch.setattr(records, "staged", spied)
    monkeypatch.setattr(counts, "staged", spied)
    found = records_from_files(file_lines(spark, str(tmp_path)))
    assert [name for name, _ in ran] == ["pieces"] and ran[0][1].count("FileScan text") == 1 and ran[0][1].count("MapInArrow") == 1
    assert "text" not in physical(found).replace("Context", "") or "FileScan text" not in physical(found)
    assert "MapInArrow" not in physical(found) and physical(found).count("PartitionFilters: [edge") + physical(found).count("PartitionFilters: [isnotnull(edge") == 3
    result = analyze(found)
    assert [name for name, _ in ran] == ["pieces", "patterns"] and ran[1][1].count("MapInArrow") == 1
    for frame in (result.groups, result.summary, result.insights, result.source_types):
        plan = physical(frame)
        assert "FileScan text" not in plan and "MapInArrow" not in plan and "pieces-" not in plan
    assert result.groups.first().examples and len(ran) == 2


def test_examples_are_the_first_in_every_order(spark, monkeypatch):
    from emberlog.operators import counts

    rows = [("s", k % 3 != 0, f"p{k % 5}", "ERROR", None if k % 2 else "x", "plain", 1 + k % 2, (f"f{k * 7 % 4}", None if k == 9 else k * 31 % 400), f"raw {k}") for k in range(400)]
    schema = "scope string, is_error boolean, pattern string, level string, service string, source_type string, n_lines long, pos struct<path:string,n:long>, raw string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    for groups, text in ((counts.HELD_GROUPS, counts.HELD_TEXT), (3, 40)):
        monkeypatch.setattr(counts, "HELD_GROUPS", groups)
        monkeypatch.setattr(counts, "HELD_TEXT", text)
        counted = counts.count_patterns(df)
        plain = counts.count_patterns(df, examples=False)
        assert sorted(map(str, G.pattern_stats(counted).collect())) == sorted(map(str, G.pattern_stats(plain).collect()))
        got = {r.pattern_key: list(r.examples) for r in G.group_examples(counted).collect()}
        place = lambda r: (r[7][0], r[7][1] is not None, r[7][1])
        assert got == {p: [r[8] for r in sorted((r for r in rows if r[1] and r[2] == p), key=place)[:3]] for p in {r[2] for r in rows}}
    empty = counts.count_patterns(df.limit(0))
    assert empty.count() == 0 and G.group_examples(empty).count() == 0


def test_json_details(spark):
    rows = parse(
        spark,
        '{"level":"error","status":200}',
        '{"level":"x","status":"502"}',
        '{"level":"warn","message":{"b":[1,"a,b:c"],"a":null}}',
        '{"msg":"boom","stack_trace":"line1\\nline2","service":"s"}',
        '{"log.level":"fatal","log":{"level":"info"},"level":"debug"}',
        '{"a":1} x',
        '{"a":1}] x}',
        '{"log":"plain words","stream":"stderr","time":"t1"}',
        '{"log":"","stream":"stderr","time":"t2"}',
        '{"level":"error","level":"info","message":"twice"}',
    )
    assert [r["level"] for r in rows] == ["INFO", "ERROR", "WARNING", "INFO", "FATAL", "INFO", "INFO", "ERROR", "ERROR", "INFO"]
    assert rows[0]["message"] == '{"level":"error","status":200}'
    assert rows[2]["message"] == '{"a": null, "b": [1, "a,b:c"]}'
    assert rows[3]["message"] == "boom\nline1\nline2" and rows[3]["service"] == "s"
    assert rows[5]["source_type"] == rows[6]["source_type"] == "plain"
    assert (rows[7]["source_type"], rows[7]["message"], rows[7]["timestamp"]) == ("docker_json", "plain words", "t1")
    assert rows[8]["message"] == '{"log":"","stream":"stderr","time":"t2"}'
    assert rows[9]["source_type"] == "json"


def test_json_keys_written_as_escapes(spark):
    rows = parse(
        spark,
        '{"\\u006cevel":"error","\\u006dsg":"x","app":{"na\\u006de":"a"}}',
        '{"http":{"status\\u005fcode":503},"msg":"x","stack_trace":["a","b"]}',
        '{"\\u006cog":"plain words\\n","ti\\u006de":"t1"}',
        '{"other":"level","x":{"log":"l"}}',
        '{"pad":"' + "p" * 5000 + '","level":"warn","msg":"long"}',
        '2026-01-01T00:00:00Z stdout F {"log":"{\\"log\\":\\"deep words\\",\\"tim\\\\u0065\\":\\"t\\"}","stream":"stdout"}',
    )
    assert [(r["source_type"], r["level"], r["message"]) for r in rows] == [
        ("json", "ERROR", "x"), ("json", "ERROR", 'x\n["a", "b"]'), ("docker_json", "INFO", "plain words"),
        ("json", "INFO", '{"other":"level","x":{"log":"l"}}'), ("json", "WARNING", "long"), ("cri", "INFO", "deep words"),
    ]
    assert (rows[0]["service"], rows[2]["timestamp"]) == ("a", "t1")


def test_json_keys_are_searched_for_before_they_are_looked_up(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == str(JIT_METHOD_BYTES)
    records = spark.createDataFrame([(1, "{}")], "pos long, raw string")
    plan = parse_records(records)._jdf.queryExecution().optimizedPlan().toString()
    for key in ("stacktrace", "datetime", "status_code", "job"):
        found = re.findall(rf'(Contains\(__line#\d+, "{key}"\)\) THEN )?try_variant_get\(__json#\d+, \$\["{key}"\]', plan)
        assert found and all(found)


def test_nested_containers_and_forced_types(spark):
    docker_in_cri = '2026-01-01T00:00:00Z stderr F {"log":"level=info app=deep msg=\\"ok\\"\\n","stream":"stdout","time":"t"}'
    rows = parse(spark, docker_in_cri, "2026-01-01T00:00:00Z stdout P part one\n  tail")
    assert (rows[0]["source_type"], rows[0]["level"], rows[0]["service"], rows[0]["message"]) == ("cri", "ERROR", "deep", "ok")
    assert rows[1]["message"] == "part one\n  tail" and rows[1]["fields"]["flag"] == "P"
    line = "<34>1 2026-01-01T00:00:00Z h app 1 ID [x y=1] disk failed"
    assert [parse(spark, line, source_type=t)[0]["source_type"] for t in ("auto", "syslog", "redis", "logfmt")] == ["syslog", "syslog", "plain", "plain"]
    assert parse(spark, line)[0]["level"] == "CRITICAL"
    assert parse(spark, '{"log":"[a] b","time":"t"}', source_type="docker_json")[0]["source_type"] == "docker_json"
    with pytest.raises(ValueError):
        parse(spark, line, source_type="spring")


def test_logfmt_details(spark):
    rows = parse(spark, "status=503 method=GET path=/a took=3s", "a=1 a=2", 'x=1 level="" severity=crit service=5ms app=web')
    assert (rows[0]["message"], rows[0]["level"]) == ("HTTP 503 GET /a", "ERROR")
    assert rows[1]["source_type"] == "plain"
    assert (rows[2]["level"], rows[2]["service"]) == ("CRITICAL", "web")


def test_levels(spark):
    df = spark.createDataFrame([("Severe", "0"), ("emerg", "11"), ("odd", "164"), ("err", "x")], "l string, p string")
    rows = df.select(L.normalize_level(F.col("l")), L.level_from_priority(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("ERROR", "CRITICAL"), ("CRITICAL", "ERROR"), ("ODD", "WARNING"), ("ERROR", "INFO")]


def test_normalised_message_by_steps_equals_expression(spark):
    texts = [
        "gave up on 192.0.2.7:99 after 41s, user_id=88, see /bins/330044 of 2025-12-24T18:00:00Z, request_id=q-5",
        "File \"a.py\", line 3, in run", "... 12 more", "deadbeefdeadbeefdead", "Session ID:abc uid=x 12KB", "x\n  at Foo_1(Foo)\n",
        "id 123e4567-e89b-12d3-a456-426614174000 bet-5.x Jan  2 03:04:05 tail", "  ", "https://a.b/c?d=1 é 12345",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "message string").withColumns({"level": F.lit("ERROR")})
    rows = G.with_pattern(df).select("message", "pattern", normalize_message(F.col("message")).alias("want")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.pattern == (r.want or r.message)
    assert rows[0].pattern == "gave up on <IP>:<PORT> after <DURATION>, user_id=<ID>, see /bins/<NUMBER> of <TIMESTAMP>, request_id=<ID>"


def test_group_ties_service_and_cut(spark):
    text = "\n".join(
        ["[a] ERROR boom 1111", "[b] CRIT boom 2222", "[a] ALERT boom 3333", "[a] ERROR boom 4444"]
        + [f"[s] ERROR kind{chr(97 + i)} certificate" for i in range(12)]
        + ["[z] INFO new certificate issued"]
    )
    text = text.replace("[b] CRIT boom", "[a] CRIT boom").replace("[a] ALERT", "[a] CRIT")
    result = analyze(text_records(spark, text), max_groups=2)
    groups = result.groups.orderBy("rank").collect()
    assert [g["count"] for g in groups] == [2, 2] and groups[0].pattern == "[a] CRIT boom <NUMBER>"
    assert groups[0].level == "CRITICAL"
    s = result.summary.collect()[0]
    assert s.unique_patterns == 15 and s.error_events == 17
    assert [i.classification for i in result.insights.collect()] == ["TLS_CERTIFICATE_ERROR"]
    two = [f'{{"level":"error","service":"{s}","message":"same"}}' for s in "aab"]
    group = analyze(text_records(spark, "\n".join(two * 2))).groups.collect()[0]
    assert group.service == "multiple" and len(group.examples) == 3
    with pytest.raises(ValueError):
        analyze(text_records(spark, text), max_groups=51)


def test_stream_of_whole_records(spark, tmp_path):
    from emberlog.streaming.records import parse_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("level=error app=dock msg=\"arm 1234 stuck\"\n[x] INFO fine\n")
    configure(spark)
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "raw")
    out = parse_stream(stream).select("source_type", "level", "is_error", "pattern")
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows[0] == ("logfmt", "ERROR", True, "arm <NUMBER> stuck") and rows[1][2] is False


def test_scopes_are_apart_and_empty_input(spark):
    result = analyze(text_records(spark, "ERROR a", "ERROR b\nINFO fine", " \n"))
    rows = {r.scope: r for r in result.summary.collect()}
    assert set(rows) == {"0", "1"} and rows["1"].parsed_lines == 2 and rows["0"].dominant_percentage == 100.0
    quiet = analyze(text_records(spark, "INFO fine"))
    assert quiet.summary.collect()[0].asDict()["dominant_issue"] is None and quiet.groups.count() == 0


def test_rules(spark, tmp_path):
    first = make_rules([{"pattern": "boom", "name": "n"}, {"pattern": "BOOM", "classification": "B"}, {"pattern": ""}])
    assert first[0].classification == "UNKNOWN" and first[0].title == "n"
    groups = spark.createDataFrame([("s", "a boom", "A Boom", 1), ("s", "b", "b", 1)], "scope string, pattern_key string, pattern string, count long")
    got = [(r.rule_priority, r.classification) for r in C.classify(groups, first).orderBy("pattern_key").collect()]
    assert got == [(0, "UNKNOWN"), (None, "UNKNOWN")]
    table = C.classify_by_table(groups, rules_table(spark, first)).orderBy("pattern_key").collect()
    assert [(r.rule_priority, r.classification) for r in table] == got
    many = make_rules([{"pattern": f"never{k}x", "classification": "N"} for k in range(1150)] + [{"pattern": "^b$", "classification": "LATE"}])
    table = C.classify_by_table(groups, rules_table(spark, many)).orderBy("pattern_key").collect()
    assert [(r.rule_priority, r.classification) for r in table] == [(None, "UNKNOWN"), (1150, "LATE")]
    assert len(load_rules()) == 13
    path = tmp_path / "rules.json"
    path.write_text('{"rules": {"a": 1}}')
    with pytest.raises(ValueError):
        load_rules(path)


def test_required_texts():
    from emberlog.operators.rule_index import required_texts

    for pattern, want in {
        r"\bword12\b": ["word12"], "Refused|timed out": ["refused", "timed out"], "a|timeout": None, "(?:no|bad) route+ x": [" route"], "colou?r": ["colo"],
        "x*abc{2}d": ["abc"], "(abc)?defg": ["defg"], "(?!never)other": ["other"], r"\Qa.b\E": None, "(?i)abc": None, r"10\.0\.0\.1": ["10.0.0.1"], "[abc]def[^]x]ghij": ["ghij"],
        "(abcd|efgh)ij": ["abcd", "efgh"], "é12": None, "ab": None, "": None, "(open": None, "close)": None, "a{0,3}bcd": ["bcd"], "(?:one|two|three){2}": ["one", "three", "two"], "abc\\": None,
    }.items():
        assert required_texts(pattern) == want, pattern


def test_rule_index_equals_case(spark):
    rules = make_rules([{"pattern": p, "classification": f"C{k}"} for k, p in enumerate([r"\bdisk\b", "(?:full|No space)", "", r"^\d+$", "ſtale|kelvin", "time(?:d)? ?out", "x{3}", "lost.{0,3}peer"] + [f"never{k}seen" for k in range(300)])])
    texts = ["Disk FULL", "no SPACE left", "123", "a sTALE file", "0 \u212aelvin", "timeout", "timed out", "axxxb", "lost a peer", "never77Seen", "unſeen never77ſeen", "quiet", "", None, "disk"]
    groups = spark.createDataFrame([("s", t, k) for k, t in enumerate(texts)] * 2, "scope string, pattern string, priority int")
    keyed = lambda df: sorted(map(str, df.select("scope", "pattern", "priority", "rule_priority", "classification").collect()))
    assert keyed(C.classify_by_table(groups, rules_table(spark, rules))) == keyed(C.classify(groups, rules))


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    """Many splits, one of which holds the only row group; and more rows in a split than a task may take."""
    path = str(tmp_path / "t")
    spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() >= 8
        sizes = [r["count"] for r in spread(table).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 8 and max(sizes) < 10_000 and sum(sizes) == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr("emberlog.sources.text.ROWS_A_TASK", 500)
    sizes = [r["count"] for r in spread(spark.range(0, 20_000, 1, 8)).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1_000 and sum(sizes) == 20_000
    assert spread(spark.range(0, 100, 1, 8)).rdd.getNumPartitions() == 8
    assert spread(spark.range(0)).count() == 0
