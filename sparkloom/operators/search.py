"""Vector search, transparent rescoring, and the search over chunks that joins them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from .rounds import settle

#: Weights of the fused score, and the penalties by language and length.
VECTOR, SYMBOL, PATH, RECENCY = 0.75, 0.15, 0.10, 0.08
MONTH_MS = 30 * 24 * 3600 * 1000
PROSE, TRANSCRIPT = 0.04, 0.1
LENGTHS = ((80, 0.08), (60, 0.05), (40, 0.03))


def distance(a: Column, b: Column, squared: bool = True) -> Column:
    """Euclidean distance of two arrays in double precision, summed in order."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return d if squared else F.sqrt(d)


def score(d: Column) -> Column:
    """1 / (1 + distance); 1 for a missing distance."""
    return F.coalesce(1 / (1 + d), F.lit(1.0))


def scalar_filter(conditions: Mapping[str, object]) -> Column:
    """All of: column = value, column in a list, column is null (None). No conditions are always true."""
    out = F.lit(True)
    for name, want in conditions.items():
        if want is None:
            out = out & F.col(name).isNull()
        elif isinstance(want, (list, tuple, set)):
            out = out & F.col(name).isin(*want)
        else:
            out = out & (F.col(name) == F.lit(want))
    return out


def knn(vectors: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "vector", where: Mapping[str, object] | None = None, squared: bool = True) -> DataFrame:
    """The k rows nearest to one query, with distance and score, by distance and then key; conditions apply before."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(scalar_filter(where or {})).withColumn("distance", distance(F.col(vector), q, squared))
    return rows.orderBy("distance", key).limit(k).withColumn("score", score(F.col("distance")))


def _best_of(names: np.ndarray, q: np.ndarray, batches, k: int) -> pd.DataFrame:
    """(q, k, distance): for each query the k rows of frames(k, v) that are nearest, by distance and then key."""
    best_d, best_k = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    for pdf in batches:
        for a in range(0, len(pdf), 4096):
            x, ids = _first_of_equals(np.stack(pdf["v"].iloc[a : a + 4096].to_numpy()).astype(np.float64), pdf["k"].iloc[a : a + 4096].to_numpy(np.int64), k)
            for b in range(0, len(q), 512):
                some = q[b : b + 512]
                size = (some * some).sum(1)[:, None] + (x * x).sum(1)[None, :]
                d = np.maximum(size - 2 * some @ x.T, 0)
                # candidates by the fast form, as many as could be among the k by what it rounds; then the exact distances of those
                n = min(k, d.shape[1])
                reach = np.partition(d, n - 1, axis=1)[:, n - 1] + 1e-12 * size.max(axis=1)
                n = int((d <= reach[:, None]).sum(axis=1).max())
                keep = np.argpartition(d, n - 1, axis=1)[:, :n]
                exact = np.concatenate([((one[None, :] - x[own]) ** 2).sum(1)[None, :] for one, own in zip(some, keep)])
                all_d, all_k = np.concatenate((best_d[b : b + 512], exact), axis=1), np.concatenate((best_k[b : b + 512], ids[keep]), axis=1)
                order = np.lexsort((all_k, all_d), axis=1)[:, :k]
                best_d[b : b + 512], best_k[b : b + 512] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_k, order, 1)
    real = best_k.ravel() >= 0
    return pd.DataFrame({"q": np.repeat(names, k)[real], "k": best_k.ravel()[real], "distance": best_d.ravel()[real]})


def _first_of_equals(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors only the k smallest keys can count, so ties never crowd out candidates."""
    _, same = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, same.ravel()))
    first = np.flatnonzero(np.diff(same.ravel()[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return x[order[place < k]], ids[order[place < k]]


#: Queries that are sent to every task, and rows in a group of the way beyond that.
BLOCK, BLOCK_ROWS = 16384, 65536


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, key: str, query_key: str, vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """query_key, key, distance (squared) and rank of the k rows nearest to each query, by distance and then key.

    Up to ``block`` queries go to every task that reads rows, which sends on only its own k best for each. More are dealt in
    blocks, as are the rows, and each pair of blocks is a group; nothing goes through the driver. Rows without a vector have
    no neighbours.
    """
    spark = vectors.sparkSession
    q_type, k_type = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]
    base = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).alias("v"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    out = f"q {q_type}, k long, distance double"
    held = base.limit(block + 1).toPandas()
    if not len(held):
        return spark.createDataFrame([], f"{query_key} {q_type}, {key} {k_type}, distance double, rank int")
    if len(held) <= block:
        sent = spark.sparkContext.broadcast((held["q"].to_numpy(), np.stack(held["v"].to_numpy()).astype(np.float64)))

        def nearest(batches):
            yield _best_of(*sent.value, batches, k)

        found = rows.mapInPandas(nearest, out)
    else:
        parts, blocks = -(-base.count() // block), max(-(-rows.count() // BLOCK_ROWS), 1)
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        left = base.withColumn("part", deal("q", parts)).withColumn("block", every(blocks))
        right = rows.withColumn("block", deal("k", blocks)).withColumn("part", every(parts))

        def compared(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs):
                return pd.DataFrame({"q": qs["q"], "k": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
            return _best_of(qs["q"].to_numpy(), np.stack(qs["v"].to_numpy()).astype(np.float64), [xs], k)

        found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(compared, out)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "k"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("k").cast(k_type).alias(key), "distance", "rank")


def penalty(language: Column, path: Column, n_lines: Column) -> Column:
    """What prose loses for its kind and length, and transcripts for theirs; 0 or less."""
    by_length = F.lit(0.0)
    for least, p in reversed(LENGTHS):
        by_length = F.when(n_lines >= least, p).otherwise(by_length)
    prose = F.when(language.isin("markdown", "text"), by_length + PROSE).otherwise(0.0)
    return -(prose + F.when(F.contains(F.lower(path), F.lit("transcript")), TRANSCRIPT).otherwise(0.0))


def recency(modified: Column, now_ms: int) -> Column:
    """RECENCY for a file changed now, falling to 0 over 30 days; 0 if it is absent."""
    age = F.lit(now_ms) - F.unix_millis(modified.cast("timestamp"))
    return F.coalesce(RECENCY * F.greatest(F.lit(0.0), 1 - age / F.lit(float(MONTH_MS))), F.lit(0.0))


def rescore(candidates: DataFrame, query: str | Column, now_ms: int) -> DataFrame:
    """candidates(path, score, symbol_name, language, start_line, end_line, modified) with the parts of the fused score and final_score; the query is a text, or a column of them."""
    q = T.camel_tokens(query if isinstance(query, Column) else F.lit(query))
    parts = {
        "symbol_match": T.coverage(q, T.camel_tokens(F.col("symbol_name"))), "path_match": T.coverage(q, T.camel_tokens(F.col("path"))),
        "recency": recency(F.col("modified"), now_ms), "penalty": penalty(F.col("language"), F.col("path"), F.col("end_line") - F.col("start_line") + 1),
    }
    rows = candidates.withColumns(parts)
    return rows.withColumn("final_score", VECTOR * F.col("score") + SYMBOL * F.col("symbol_match") + PATH * F.col("path_match") + F.col("recency") + F.col("penalty"))


def post_filter(rows: DataFrame, include: str | None = None, exclude: str | None = None, language: str | None = None, min_score: float | None = None, code_only: bool = False) -> DataFrame:
    """The filters that come after rescoring and before the limit; min_score is held to [0, 10]."""
    if include:
        rows = rows.where(P.matches(F.col("path"), include))
    if exclude:
        rows = rows.where(~P.matches(F.col("path"), exclude))
    if language:
        rows = rows.where(F.lower("language") == language.lower())
    if code_only:
        rows = rows.where(P.is_code(F.col("path"), F.col("language")))
    if min_score is not None:
        rows = rows.where(F.col("final_score") >= min(10.0, max(0.0, min_score)))
    return rows


def first_places(rows: DataFrame, own: str = "_own") -> DataFrame:
    """Of the paths at which a chunk can be seen, the one that it was cut from, else the first."""
    names = [c for c in rows.columns if c != "chunk_id"]
    best = rows.groupBy("chunk_id").agg(F.min_by(F.struct(*names), F.struct(F.col("path") != F.col(own), "path")).alias("_r"))
    return best.select("chunk_id", *[F.col(f"_r.{c}").alias(c) for c in names])


def semantic_search(chunks: DataFrame, query: str, query_vector: Sequence[float], limit: int = 10, now_ms: int = 0, visible: DataFrame | None = None, blobs: DataFrame | None = None, **filters) -> DataFrame:
    """The best chunks for a query: nearest by vector, visible ones only, rescored, filtered and cut to ``limit``.

    Filters come after the nearest max(100, 10 limit) are chosen, so a strict one can leave fewer than ``limit``. A blank
    query has no results. With blobs(chunk_id, blob_hash), a chunk belongs to each content that has it and is seen wherever one
    of them is.
    """
    limit = max(1, limit)
    if not query.strip():
        return rescore(chunks.limit(0).withColumns({"distance": F.lit(0.0), "score": F.lit(0.0)}), "", now_ms).drop("vector")
    near = knn(chunks, query_vector, max(100, 10 * limit), "chunk_id")
    if visible is not None:
        from .overlay import resolve_candidates

        if blobs is not None:
            near = first_places(resolve_candidates(near.withColumn("_own", F.col("path")).join(blobs, "chunk_id"), visible)).drop("_own")
        else:
            near = resolve_candidates(near, visible)
    rows = post_filter(rescore(near, query, now_ms), **filters)
    return rows.orderBy(F.desc("final_score"), "distance", "chunk_id").limit(limit).drop("vector")


def search_many(chunks: DataFrame, queries: DataFrame, limit: int = 10, now_ms: int = 0) -> DataFrame:
    """The best ``limit`` chunks for each of queries(query_id, query, vector), with rank, over stored chunks(n, chunk_id, vector, ...).

    ``n`` is a number in the order of chunk_id. Keys and vectors are scanned; the rest is joined to the nearest alone. These
    are written first, so that their size is known and, unless there are very many queries, the chunks aren't shuffled for them.
    """
    near = settle(knn_join(queries.select("query_id", "vector"), chunks.select("n", "vector"), max(100, 10 * limit), "n", "query_id"))
    near = near.withColumn("score", score(F.col("distance"))).join(queries.select("query_id", "query"), "query_id").join(chunks.drop("vector"), "n")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "distance", "chunk_id"))
    return rescore(near, F.col("query"), now_ms).withColumn("rank", rank).where(F.col("rank") <= limit)


def suggestion_score(name: Column, wanted: str) -> Column:
    """How well a symbol's name answers a wanted one, both trimmed and in any case: 1 if equal, 0.95 if it begins with it, 0.85
    if it holds it, 0.7 if it is a part of it, else the better of shared prefix and token overlap; 0 if either is blank."""
    low, want = F.lower(F.trim(name)), wanted.strip().lower()
    w = F.lit(want)
    prefix = T.common_prefix(low, w) / F.greatest(F.length(low), F.length(w))
    overlap = T.coverage(T.camel_tokens(w), T.camel_tokens(low))
    return (
        F.when((F.coalesce(low, F.lit("")) == "") | (w == ""), 0.0).when(low == w, 1.0).when(F.startswith(low, w), 0.95).when(F.contains(low, w), 0.85).when(F.contains(w, low), 0.7)
        .otherwise(F.greatest(0.65 * prefix, 0.75 * overlap))
    )


def suggest_symbols(symbols: DataFrame, wanted: str, n: int = 5) -> DataFrame:
    """The n best names with a positive score; if none has one, the first n by line."""
    scored = symbols.withColumn("match", suggestion_score(F.col("name"), wanted))
    good = scored.where("match > 0").orderBy(F.desc("match"), "start_line", "file_path", "name").limit(n)
    return good if not good.isEmpty() else scored.orderBy("start_line", "file_path", "name").limit(n)
