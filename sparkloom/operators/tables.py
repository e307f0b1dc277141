"""Reports over stored tables: documents, symbols, commits, latencies, rates, retrieval metrics and first-wins dedupe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MOST_PARTS = 16


def search_docs(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Document chunks(url, chunk_index, title, content, updated_at) with the query in content, title or URL, in any case; newest first."""
    hit = T.contains_ignoring_case(F.col("content"), query) | T.contains_ignoring_case(F.col("title"), query) | T.contains_ignoring_case(F.col("url"), query)
    return docs.where(hit).orderBy(F.desc("updated_at"), "url", "chunk_index").limit(limit)


def get_symbols(symbols: DataFrame, name: str | None = None, file_path: str | None = None, kind: str | None = None, repo_id: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols by a part of the name in any case and exact path, kind and repository; empty arguments don't filter. limit in [1, 500]."""
    if name:
        symbols = symbols.where(T.contains_ignoring_case(F.col("name"), name))
    for column, want in (("file_path", file_path), ("kind", kind), ("repo_id", repo_id)):
        if want:
            symbols = symbols.where(F.col(column) == want)
    return symbols.orderBy("name", "file_path", "start_line").limit(min(500, max(1, limit)))


def recent_commits(commits: DataFrame, query: str | None = None, limit: int = 20, most: int = 1000) -> DataFrame:
    """The newest commits(commit, author, ts, message, files, repo_id) whose text has the query in any case. limit in [1, 200].

    Of each repository only the newest max(limit, min(most, 4 limit)) are looked at, before the text filter.
    """
    limit = min(200, max(1, limit))
    per_repo = Window.partitionBy("repo_id").orderBy(F.desc("ts"), "commit")
    rows = commits.withColumn("_n", F.row_number().over(per_repo)).where(F.col("_n") <= max(limit, min(most, 4 * limit))).drop("_n")
    if query:
        said = F.concat_ws("\n", "commit", F.left("commit", F.lit(7)), "author", "message", F.array_join("files", "\n"))
        rows = rows.where(T.contains_ignoring_case(said, query))
    return rows.orderBy(F.desc("ts"), "repo_id", "commit").limit(limit)


def last_changes(commits: DataFrame, as_of: str | None = None) -> DataFrame:
    """(repo_id, path, modified): the time of each path's newest commit(files, ts, repo_id), up to a time if one is given."""
    rows = commits.where("ts is not null")
    if as_of is not None:
        rows = rows.where(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    return rows.select("repo_id", "ts", F.explode("files").alias("path")).groupBy("repo_id", "path").agg(F.max("ts").alias("modified"))


def latest(samples: DataFrame, group: str, order: str, keep: int = 200) -> DataFrame:
    """A ring buffer: the last ``keep`` samples of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def floor_percentile(sorted_values: Column, p: float) -> Column:
    """The value at place floor((n - 1) p) of a sorted array."""
    return F.element_at(sorted_values, (F.floor((F.size(sorted_values) - 1) * F.lit(p)) + 1).cast("int"))


def latency_percentiles(samples: DataFrame, group: str, order: str, value: str, keep: int = 200) -> DataFrame:
    """n, p50 and p95 of the last samples of each group."""
    rows = latest(samples, group, order, keep).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    return rows.select(group, F.size("_v").alias("n"), floor_percentile(F.col("_v"), 0.5).alias("p50"), floor_percentile(F.col("_v"), 0.95).alias("p95"))


def rates(rows: DataFrame, **conditions: Column) -> DataFrame:
    """total, and for each condition a count and its share (0 of no rows)."""
    total = F.count("*")
    cols = [c for k, x in conditions.items() for c in (F.count_if(x).alias(k), F.when(total > 0, F.count_if(x) / total).otherwise(0.0).alias(f"{k}_rate"))]
    return rows.agg(total.alias("total"), *cols)


def language_counts(files: DataFrame, language: str = "language") -> DataFrame:
    return files.groupBy(language).agg(F.count("*").alias("n"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k_precision: int = 5, k_recall: int = 10) -> DataFrame:
    """mrr, ndcg, precision and recall, averaged over the queries of relevant(query, path).

    ranked(query, path, rank) may name a path more than once; the first place counts. A query without results counts as 0.
    """
    first = ranked.groupBy("query", "path").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "path"))
    hits = first.withColumn("place", place).join(relevant.select("query", "path").distinct(), ["query", "path"], "left_semi")
    gain = F.when(F.col("place") <= k_recall, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    per = hits.groupBy("query").agg(
        (1 / F.min("place")).alias("rr"), F.sum(gain).alias("dcg"), F.count_if(F.col("place") <= k_precision).alias("in_p"), F.count_if(F.col("place") <= k_recall).alias("in_r")
    )
    wanted = relevant.select("query", "path").distinct().groupBy("query").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k_recall)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    rows = wanted.join(per, "query", "left").fillna(0)
    return rows.agg(
        F.avg("rr").alias("mrr"), F.avg(F.col("dcg") / ideal).alias("ndcg"), F.avg(F.col("in_p") / k_precision).alias("precision"), F.avg(F.col("in_r") / F.col("n")).alias("recall")
    )


def regression_gate(metrics: dict[str, float], baseline: dict[str, float], most_drop_pct: float = 2.0) -> list[str]:
    """Metrics that fall more than so many percent below the baseline."""
    return [k for k, b in baseline.items() if metrics.get(k, 0.0) < b * (1 - most_drop_pct / 100)]


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged(primary: DataFrame, secondary: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Both tables, the first's row where they share a key."""
    both = primary.withColumn("_src", F.lit(0)).unionByName(secondary.withColumn("_src", F.lit(1)))
    return first_wins(both, key, ["_src", *order]).drop("_src")


def closure(edges: DataFrame, start: DataFrame, parent: str, child: str, most_rounds: int = 100) -> DataFrame:
    """(node, depth) of all that can be reached from start(node) along edges(parent, child), with the fewest steps; cycles are safe.

    Only the nodes new in a round go into the next and are written; what earlier rounds found is written again once in
    ``MOST_PARTS`` rounds, so that the plan stays small.
    """
    from .rounds import settle

    hops = edges.select(F.col(parent).alias("_from"), F.col(child).alias("node")).distinct()
    front = settle(start.select("node").distinct().withColumn("depth", F.lit(0)))
    parts = [front]
    for depth in range(1, most_rounds + 1):
        reached = reduce(DataFrame.unionByName, parts)
        found = front.join(hops, front["node"] == hops["_from"]).select(hops["node"]).distinct().join(reached, "node", "left_anti")
        front = settle(found.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        parts = [settle(reached), front] if len(parts) >= MOST_PARTS else [*parts, front]
    return reduce(DataFrame.unionByName, parts)
