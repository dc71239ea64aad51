"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with the rule's; the longest
that fits decides. The classifier is trained from a small table of labelled URLs; more than MAX_LABELLED is an error.

Defined cases: a null URL, or one without `://`, has an empty host and path and is judged by the classifier's bias;
URLs of any length are taken whole; rows that repeat are judged one by one; of rules that fit, the longest host and path
decides, of equal ones the last in alphabetical order; a score of exactly 0.5 allows; an empty table gives an empty
result, and without labelled URLs every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules given for this corpus.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES, MAX_LABELLED = 1000, 20_000
BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
STEPS, RATE, DECAY = 300, 0.5, 1e-4

#: A small labelled table: what a filter keeps (1) and what it blocks (0).
LABELLED = tuple((u, 1) for u in """
https://docs.library.example.org/en/guide/intro
https://www.encyclopedia.example.org/wiki/Algebra
https://news.daily.example.com/world/2021/05/story
https://blog.research.example.org/posts/reading-notes
https://university.example.org/courses/history/lecture-3
https://m.journal.example.com/articles/1542
https://www.museum.example.org/collection/prints
https://recipes.kitchen.example.com/soup/lentil
https://forum.gardeners.example.org/thread/8812
https://archive.gazette.example.com/1998/07/12
https://science.weekly.example.org/physics/article/221
https://help.editor.example.com/manual/chapter-2
https://www.travel.example.com/guides/mountains
https://poetry.example.org/en/anthology/spring
https://blog.weather.example.com/en/forecast-methods
https://law.review.example.org/volume/12/essay
https://school.example.org/lessons/fractions
https://health.institute.example.org/topics/sleep
https://books.example.com/reviews/fiction/77
https://code.example.org/tutorial/loops
""".split()) + tuple((u, 0) for u in """
http://free-casino-bonus.example.com/win/jackpot
http://cheap-pills-online.example.com/buy/now
http://adult-cams.example.net/live/xxx
http://track.adserver.example.net/click?id=1
http://download-crack-keygen.example.net/serial/full
http://bet-slots-poker.example.com/bonus/spin
http://xxx-videos.example.net/hot/free
http://win-free-prize.example.com/claim/now
http://ads.banner.example.net/impression/pixel
http://replica-watches-outlet.example.com/sale/cheap
http://torrent-warez.example.net/download/movie
http://payday-loan-fast.example.com/apply/cash
http://spam-links.example.net/seo/backlinks
http://hot-singles-chat.example.net/meet/tonight
http://miracle-diet-pills.example.com/order/discount
http://clickbait-viral.example.com/shocking/you-wont-believe
http://cdn.popunder.example.net/popup/redirect
http://poker-casino-slots.example.net/play/free
http://cheap-replica-bags.example.com/outlet/discount
http://login-verify-account.example.net/secure/update
""".split())


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(F.coalesce(url, F.lit("")), at + 3, F.length(url))).otherwise("")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), letters, letters.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the last that fits wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and of path, with marks at their ends."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(kind + text[i : i + n] for i in range(len(text) - n + 1))
    return np.array(sorted({zlib.crc32(g.encode()) & BUCKETS - 1 for g in found}), np.int64)


def margin(weights: np.ndarray, ids: np.ndarray) -> float:
    return float(weights[ids].sum() / np.sqrt(max(1, len(ids))) + weights[BUCKETS])


def train(rows: list[tuple[str, str, int]]) -> np.ndarray:
    """Weights (BUCKETS, then the bias) from (host, path, label) by gradient steps over the whole small table."""
    weights = np.zeros(BUCKETS + 1)
    items = [(grams(h, p), y) for h, p, y in rows]
    for _ in range(STEPS if items else 0):
        slope = DECAY * weights
        for ids, y in items:
            pull = (1 / (1 + np.exp(-margin(weights, ids))) - y) / len(items)
            slope[ids] += pull / np.sqrt(max(1, len(ids)))
            slope[BUCKETS] += pull
        weights -= RATE * slope
    return weights


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score (the classifier's chance of allow)."""
    spark = pages.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(list(LABELLED), "url string, label int")
    host, path = host_and_path(F.col("url"))
    known = labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("int")).filter("label is not null").limit(MAX_LABELLED + 1).collect()
    if len(known) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    weights = spark.sparkContext.broadcast(train(sorted(map(tuple, known))))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            scores = 1 / (1 + np.exp(-np.array([margin(weights.value, grams(h, p)) for h, p in pairs])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["page_id", "host", "path", "score"])

    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = parts.mapInArrow(run, "page_id long, host string, path string, score double")
    found = rule(F.col("host"), F.col("path"), rules)
    return scored.withColumn("found", found).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")
