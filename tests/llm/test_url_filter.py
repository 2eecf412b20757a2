import re

from emberlog.llm import url_filter as U


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path):
    found = [rule for rule, _ in U.RULES if (host == (h := rule.split("/")[0]) or host.endswith("." + h)) and path.startswith(rule[len(h):])]
    return max(found, key=len, default=None)


def test_parts_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://A.Example.ORG", "http://example.org/es/1", "https://x.example.org/es", "http://example.org/en/1?x#y", "http://notexample.org/en/12",
        "ftp://example.com/de/1", "http://com/fr/", "http://ÉCOLE.com/de/", "a://b://c/d", "http://x.com?q=/de/", "http://x.com#/de/", "http://org.com/de", "http://h.net/a\nb", "x" * 5000 + "://h.org/",
    ]
    pages = spark.createDataFrame([(k, u, "h", "clash") for k, u in enumerate(urls)], "page_id int, url string, html string, host string")
    rows = {r.page_id: r for r in U.judge_urls(pages).collect()}
    assert len(rows) == len(urls)
    for k, url in enumerate(urls):
        host, path = _parts(url)
        assert (rows[k].host, rows[k].path, rows[k].rule) == (host, path, _rule(host, path)), url
        assert rows[k].verdict == (dict(U.RULES)[rows[k].rule] if rows[k].rule else "block" if rows[k].score >= 0.5 else "allow")


def test_learned_verdicts_and_plan(spark):
    urls = [("http://cheap-spam-pills.test.net/en/4", "block"), ("https://casino-jackpot.test.net/x", "block"), ("https://blog.lighthouse.test.net/en/44", "allow"), ("https://www.bakery.test.net/", "allow")]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id int, url string")
    out = U.judge_urls(pages)
    assert [r.verdict for r in out.orderBy("page_id").collect()] == [v for _, v in urls]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Exchange|Join", plan)


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id int, url string")).collect() == []
