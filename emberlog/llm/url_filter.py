"""URL filter: allow and block rules, else a logistic regression on hashed character n-grams of host and path.

The regression learns from a small labelled URL table when the filter is built: its n-gram buckets come from the same SQL
expression that scores pages, its weights become one constant array, and scoring is a sum over that array inside the JVM.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by the method on no
n-grams (the intercept alone); repeated rows are judged alike; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import LOWER, UPPER

#: (rule, verdict): a host and, from its first slash on, the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: The labelled table: 1 is to be blocked.
LABELLED = (
    ("https://news.city-herald.example.net/politics/2021/budget-vote", 0),
    ("https://docs.orchard.example.com/guide/install.html", 0),
    ("http://library.northfield.example.net/catalog/item/4471", 0),
    ("https://blog.river.example.net/2019/04/walking-the-coast", 0),
    ("https://www.gardeners.example.com/en/roses/pruning", 0),
    ("https://m.weather.example.net/fr/paris", 0),
    ("http://museum.example.net/de/ausstellung/12", 0),
    ("https://www.recipes.example.com/es/sopa.html", 0),
    ("https://blog.physics.example.com/en/217", 0),
    ("http://archive.county.example.net/records/1880.html", 0),
    ("https://forum.cyclists.example.com/thread/88231", 0),
    ("https://wiki.birders.example.net/en/Heron", 0),
    ("https://www.school-district.example.net/calendar", 0),
    ("https://m.trains.example.com/en/timetable/45", 0),
    ("http://blog.kitchen.example.net/en/903.html", 0),
    ("https://theatre.example.com/fr/programme", 0),
    ("https://harbour.example.net/en/770", 0),
    ("http://thistle.example.net/en/231#top", 0),
    ("https://another.example.com/en/66.html", 0),
    ("https://blog.tension.example.net/es/533/", 0),
    ("https://other.example.net/fr/825?page=2", 0),
    ("http://www.stones.example.com/en/853/", 0),
    ("https://m.thunder.example.net/de/19", 0),
    ("https://whistle.example.com/en/474.html", 0),
    ("https://blog.hearth.example.net/fr/369", 0),
    ("http://rover.example.net/es/797", 0),
    ("https://inner.example.com/es/578?utm_source=feed", 0),
    ("https://m.leather.example.net/en/960", 0),
    ("http://tinder-box.example.com/en/302", 0),
    ("https://thorn-hill.example.net/en/148/", 0),
    ("https://cheap-meds-online.example.net/en/12", 1),
    ("http://www.cheap-viagra.example.com/buy-now", 1),
    ("https://diet-pills-shop.example.com/en/77", 1),
    ("http://pills4less.example.net/order", 1),
    ("https://best-casino-bonus.example.net/win", 1),
    ("http://free-slots-casino.example.com/jackpot", 1),
    ("https://spam-links.example.net/en/5", 1),
    ("http://link-farm.example.com/page/1", 1),
    ("https://seo-link-farm.example.net/backlinks", 1),
    ("http://spam.example.com/fr/301", 1),
    ("https://replica-watches-outlet.example.net/sale", 1),
    ("http://cheap-replica-bags.example.com/de/9", 1),
    ("https://payday-loan-fast.example.net/apply", 1),
    ("http://xxx-cams.example.com/live", 1),
    ("https://hot-adult-xxx.example.net/free", 1),
    ("http://cheap-pharmacy-pills.example.net/es/41", 1),
    ("https://spam-mail.example.net/en/633", 1),
    ("https://www.cheap-tablets.example.com/en/176/", 1),
    ("http://content-farm.example.com/en/480?utm_source=feed", 1),
    ("https://www.pills-direct.example.net/fr/258", 1),
)

BUCKETS, GRAM, ROUNDS, RATE, RIDGE = 4096, 4, 800, 1.0, 1e-3


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def gram_buckets(host: Column, path: Column, buckets: int = BUCKETS, gram: int = GRAM) -> Column:
    """The distinct buckets of the character n-grams of host and path, each part with marks at its ends."""

    def grams(part: Column, tag: str) -> Column:
        marked = F.concat(F.lit("^"), part, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (gram - 1), F.lit(1)))
        bucket = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(tag), F.substring(marked, i, F.lit(gram)))), F.lit(buckets)).cast("int"))
        return F.when(F.length(part) > 0, bucket).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(grams(host, "h"), grams(path, "p")))


def learn(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept, by gradient descent over the labelled table, which the caller passes whole."""
    table = F.inline(F.array(*[F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in labelled]))
    rows = spark.range(1).select(table).select(gram_buckets(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("at"), "label").collect()
    x = np.zeros((len(rows), buckets))
    for k, row in enumerate(rows):
        x[k, row["at"]] = 1 / np.sqrt(max(1, len(row["at"])))
    y, w, b = np.array([row["label"] for row in rows], dtype=float), np.zeros(buckets), 0.0
    for _ in range(ROUNDS):
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= RATE * (x.T @ off + RIDGE * w)
        b -= RATE * off.mean()
    return w, b


def spam_score(at: Column, weights: np.ndarray, intercept: float) -> Column:
    """The regression's probability; the array is a constant that Spark folds once."""
    held = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(held, i))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(at), F.lit(1))) + F.lit(float(intercept)))))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null: its host is the url's or a parent domain of it, and the path starts with the rule's."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def judge_urls(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED, block_at: float = 0.5
) -> DataFrame:
    """One row per page: ``<key>, host, path, rule, verdict, score``; a rule's verdict stands before the method's."""
    weights, intercept = learn(pages.sparkSession, labelled)
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    return (
        pages.select(pages[key], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
        .withColumns({"rule": fitting_rule(F.col("host"), F.col("path"), rules), "score": spam_score(gram_buckets(F.col("host"), F.col("path")), weights, intercept)})
        .select(key, "host", "path", "rule", F.coalesce(verdicts, F.when(F.col("score") >= block_at, "block").otherwise("allow")).alias("verdict"), "score")
    )
