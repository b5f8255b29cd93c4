"""URL filter: longest host and path rule, else a logistic regression on hashed character n-grams, in column functions only."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propspark.llm.common import LOWER, UPPER

#: Rules (host and path, verdict); fixed values.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Words that mark unwanted and ordinary hosts and paths; the labelled table is made of these.
UNWANTED = ("casino", "poker", "bets", "betting", "jackpot", "slots", "adult", "porn", "xxx", "sexcams", "pills", "viagra", "pharma-cheap", "cheap-meds",
            "spam", "link-farm", "ads", "adserver", "track", "tracker", "popunder", "clickbait", "free-money", "win-prizes", "payday-loans", "replica-watches", "warez", "torrentz")
ORDINARY = ("news", "journal", "library", "university", "museum", "science", "history", "weather", "recipes", "garden", "travel", "health", "school", "books",
            "music", "forum", "docs", "wiki", "blog", "city", "sports", "archive", "research", "community", "software", "theatre", "nature", "handbook",
            "nation", "station", "motion", "section", "thing", "nothing", "other", "mother", "rather", "whether", "author", "month", "north", "south", "theory",
            "method", "earth", "thread", "thanks", "those", "there", "within", "enter", "center", "winter", "water", "letter", "order", "under", "paper", "river",
            "house", "friend", "ground", "island", "reason", "season", "person", "answer", "thought", "health", "stone", "start", "first", "street", "table")
PATHS = ("", "/", "/en/12", "/de/345/", "/fr/678.html", "/es/90#top", "/en/news/2020?page=2&ref=x", "/about?utm_source=feed")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small table of ``url`` and ``label`` (1: unwanted): each word under several hosts and paths."""
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, w in enumerate(words):
            hosts = (f"{w}.example.com", f"www.{w}-{words[(i + 5) % len(words)]}.example.net", f"{words[(i + 9) % len(words)]}{w}.example.org")
            rows += [(f"https://{h}{PATHS[(i + k) % len(PATHS)]}", label) for k, h in enumerate(hosts)]
    table = json.dumps([{"url": u, "label": label} for u, label in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<url string, label int>>")))


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty without "://"."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column, sizes: Sequence[int], buckets: int) -> Column:
    """Buckets of the character n-grams of host and path, each with marked ends and hashed apart."""

    def of(text: Column, seed: int) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

        def bucket(c: Column, n: int):
            return lambda i: F.pmod(F.xxhash64(F.lit(seed), F.concat(*[F.get(c, i + k) for k in range(n)])), F.lit(buckets)).cast("int")

        def made(c: Column) -> Column:
            starts = lambda n: F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
            return F.flatten(F.array(*[F.transform(starts(n), bucket(c, n)) for n in sizes]))

        # One array of characters is shared by all positions, so a long URL costs its length only.
        return F.flatten(F.transform(F.array(F.filter(chars, lambda x: x != "")), made))

    return F.concat(of(host, 1), of(path, 2))


def trained(labelled: DataFrame, *, sizes: Sequence[int] = (3, 4, 5), buckets: int = 1 << 14, penalty: float = 1e-4) -> tuple[list[float], float]:
    """Weights by bucket and the intercept, for n-gram counts scaled to length 1; both labels weigh the same.

    ``labelled`` holds ``url`` and ``label`` (1: unwanted); rows without a label are left out. With one
    label or none the weights are 0 and the intercept tells that label.
    """
    rows = labelled.filter("label is not null").select(
        F.col("label").cast("double").alias("label"), grams(host_of(F.col("url")), path_of(F.col("url")), sizes, buckets).cast("array<string>").alias("grams"))
    kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(3).collect()}
    if len(kinds) != 2:
        return [0.0] * buckets, 1.0 if 1.0 in kinds else -1.0
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 1 / kinds[1.0]).otherwise(1 / kinds[0.0]))
    counts = CountVectorizerModel.from_vocabulary([str(b) for b in range(buckets)], inputCol="grams", outputCol="counts").transform(rows)
    scaled = Normalizer(inputCol="counts", outputCol="features").transform(counts)
    model = LogisticRegression(regParam=penalty, standardization=False, maxIter=100, weightCol="weight").fit(scaled)
    return [round(float(w), 6) for w in model.coefficients.toArray()], float(model.intercept)


def judged_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, limit: float = 0.5, sizes: Sequence[int] = (3, 4, 5),
                buckets: int = 1 << 14, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """Per row ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``p_block``, the model's chance of an unwanted URL.

    A rule holds for its host and the host's subdomains where the path starts with the rule's; the longest
    rule wins, and without one the model decides. The rules are few and written as a constant.

    Null URLs and URLs without "://" have an empty host and path, which no rule fits, and are judged by
    the model's intercept and their empty n-grams. Nothing is shuffled; repeated rows are judged alike;
    other columns are not read.
    """
    weights, intercept = trained(labelled, sizes=sizes, buckets=buckets, **options)
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    known = [{"host": r.partition("/")[0], "path": "/" + r.partition("/")[2], "rule": r, "verdict": v} for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0]))]
    known = F.from_json(F.lit(json.dumps(known)), "array<struct<host string, path string, rule string, verdict string>>")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith(F.concat(F.lit("."), r.host))) & F.col("path").startswith(r.path)
    rows = rows.withColumn("first", F.get(F.filter(known, fits), F.lit(0))).withColumn("grams", grams(F.col("host"), F.col("path"), sizes, buckets))
    # The length of the count vector: equal buckets count together.
    ordered = F.sort_array("grams")
    runs = F.aggregate(ordered, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("run"), F.lit(-1).alias("last")), lambda a, b: F.struct(
        (a.sum + F.when(b == a.last, 2 * a.run + 1).otherwise(1.0)).alias("sum"), F.when(b == a.last, a.run + 1).otherwise(1.0).alias("run"), b.alias("last")),
        lambda a: a.sum)
    dot = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(table, b))
    rows = rows.withColumn("score", F.lit(intercept) + dot / F.sqrt(F.greatest(runs, F.lit(1.0))))
    chance = 1 / (1 + F.exp(-F.col("score")))
    return rows.select("page_id", "host", "path", F.col("first.rule").alias("rule"), F.coalesce(
        F.col("first.verdict"), F.when(chance > limit, "block").otherwise("allow")).alias("verdict"), chance.alias("p_block"))
