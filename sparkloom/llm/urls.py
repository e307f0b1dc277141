"""URL filter: host and path rules first, then the likelihood ratio of two character models.

The models are variable-order Markov chains: the estimate at each order falls back to the next shorter context with a
weight that shrinks as the context's count grows. Counts are exact and come from every URL that a rule decides. They are a
table that grows with the input and is never sent anywhere whole: URLs are dealt into blocks, and each block's distinct
n-grams are joined to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, small, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
ORDERS = 6
BLOCK_CHARS = 1 << 18  # of the URLs whose n-grams are looked up together, unless a single one is longer
PRIOR = 4.0
BINS = 512
SPAN = 8.0
PAD, END = 2, 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), CAPITALS, CAPITALS.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host, or a domain above it, and the start of the path; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.name).otherwise(out)
    return out


def _codes(urls: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For all characters of a batch: the URL each belongs to, and for each length the n-gram that ends there and the one that
    ends before it. An n-gram's number holds its bytes and its length."""
    raw = [bytes([PAD]) * ORDERS + (u or "").encode("utf-8", "surrogatepass") + bytes([END]) for u in urls]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    real = np.flatnonzero(place >= ORDERS)
    grams, h = [], np.zeros(len(data), np.int64)
    for k in range(1, ORDERS + 1):
        h = np.concatenate((np.zeros(1, np.int64), h[:-1])) << 8 | data
        grams.append(np.stack((h[real], h[real - 1])) | k << 48)
    return owner[real], grams, lengths - ORDERS


def starts() -> np.ndarray:
    """The n-grams before a URL's first character, of each length that is a context."""
    return np.array([int.from_bytes(bytes([PAD]) * k, "big") | k << 48 for k in range(1, ORDERS)], np.int64)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, n0, n1) of every n-gram in rows of labelled(url, c): how often it ends at or before a character of class 0 and 1."""

    def count(batches):
        for pdf in batches:
            for c in (0, 1):
                urls = pdf["url"][pdf["c"] == c].tolist()
                if urls:
                    found, n = np.unique(np.concatenate([g[0] for g in _codes(urls)[1]]), return_counts=True)
                    at = np.concatenate((found, starts()))
                    yield pd.DataFrame({"gram": at, "c": c, "n": np.concatenate((n, np.full(ORDERS - 1, len(urls))))})

    sums = [F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    return materialize(labelled.mapInPandas(count, "gram long, c int, n long").groupBy("gram").agg(*sums), "url-grams")


@dataclass
class UrlModel:
    """Counts (gram, n0, n1) of n-grams by class (0 rejected, 1 accepted), and how many characters each class has."""

    counts: DataFrame
    totals: tuple[int, int]

    @property
    def known(self) -> bool:
        return min(self.totals) > 0

    def scores(self, urls: DataFrame) -> DataFrame:
        """(url, score) of the distinct urls(url), none of them null.

        The score is the mean over characters of the log-likelihood under the accepted model less that under the rejected one.
        """
        urls = materialize(urls.select("url").distinct(), "urls")
        if not self.known:
            return urls.withColumn("score", F.lit(0.0))
        totals = self.totals
        blocks = -(-(urls.agg(F.sum(F.length("url") + 1)).first()[0] or 0) // BLOCK_CHARS)
        dealt = urls.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(max(blocks, 1))))

        def ask(pdf: pd.DataFrame) -> pd.DataFrame:
            grams = np.concatenate([*(g[0] for g in _codes(pdf["url"].tolist())[1]), starts()])
            return pd.DataFrame({"block": pdf["block"].iloc[0], "gram": np.unique(grams)})

        def score(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"url": pdf["url"], "score": url_scores(pdf["url"].tolist(), known, totals)})

        asks = materialize(dealt.groupBy("block").applyInPandas(ask, "block long, gram long"), "url-asks")
        known = materialize(asks.join(self.counts, "gram").select("block", "gram", "n0", "n1"), "url-known")
        return materialize(dealt.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(score, "url string, score double"), "url-scores")


def url_scores(urls: list[str | None], known: pd.DataFrame, totals: tuple[int, int]) -> np.ndarray:
    """Scores of urls by the counts known(gram, n0, n1); an n-gram that isn't there has none."""
    if not urls:
        return np.zeros(0)
    owner, grams, lengths = _codes(urls)
    known = known.sort_values("gram")
    at = np.append(known["gram"].to_numpy(np.int64), np.iinfo(np.int64).max)
    found = [np.searchsorted(at, g) for g in grams]
    found = [np.where(at[i] == g, i, len(at) - 1) for i, g in zip(found, grams)]
    total = np.zeros(len(owner))
    for c, sign in ((0, -1), (1, 1)):
        n = np.append(known[f"n{c}"].to_numpy(float), 0.0)
        p = (n[found[0][0]] + PRIOR / 256) / (totals[c] + PRIOR)
        for k in range(1, ORDERS):
            p = (n[found[k][0]] + PRIOR * p) / (n[found[k - 1][1]] + PRIOR)
        total += sign * np.log(p)
    return np.bincount(owner, total, len(urls)) / lengths


def fit(labelled: DataFrame) -> UrlModel:
    """Counts over all rows of labelled(url, c, held) that aren't held. If either class has no rows the model scores everything 0."""
    counts = gram_counts(labelled.where("c is not null and not held").select("url", "c"))
    single = (F.shiftright("gram", 48) == 1) & (F.col("gram") != int(starts()[0]))
    row = counts.where(single).agg(F.sum("n0"), F.sum("n1")).first()
    return UrlModel(counts, (row[0] or 0, row[1] or 0))


def threshold_of(scored: DataFrame) -> float:
    """The threshold on scored(c, score) that errs least over both classes."""
    bins = F.least(F.greatest(F.floor((F.col("score") + SPAN / 2) * (BINS / SPAN)), F.lit(0)), F.lit(BINS - 1))
    held = scored.select("c", bins.alias("bin")).groupBy("c", "bin").count().toPandas()
    hist = np.zeros((2, BINS))
    hist[held["c"].to_numpy(int), held["bin"].to_numpy(int)] = held["count"]
    share = hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    # errors of each cut: accepted ones below it, rejected ones at or above it; the middle of the best cuts
    wrong = np.concatenate(([0], np.cumsum(share[1]))) + share[0].sum() - np.concatenate(([0], np.cumsum(share[0])))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2] * SPAN / BINS - SPAN / 2)


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of every row of pages(page_id, url).

    A null url is an empty one: its host and path are empty and no rule fits. Rows with a null or a repeated page_id stay.
    Other columns are ignored. An empty table gives an empty result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)])
    ruled = F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")])
    judged = judged.withColumn("_url", F.coalesce("url", F.lit(""))).withColumn("_verdict", ruled)
    labelled = judged.select(F.col("_url").alias("url"), (ruled == "allow").cast("int").alias("c"), (F.pmod(F.xxhash64("_url"), F.lit(5)) == 0).alias("held"))
    model = fit(labelled)
    scores = small(model.scores(labelled))
    threshold = threshold_of(labelled.where("c is not null and held").join(scores, "url")) if model.known else 0.0
    out = judged.join(scores.withColumnRenamed("url", "_url"), "_url")
    verdict = F.coalesce("_verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
