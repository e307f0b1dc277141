"""Exact top-k search by integer inner product, with a table of distances to pivots.

Every vector keeps its distances to a few pivots. For a query q and a row x the largest difference of their distances to one
pivot is a lower bound of the distance between them, so (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of their inner
product. Rows are evaluated in the order of that bound, and a query is done with a block of rows once the bound of the next
one is below the score that it has to beat. The bounds have room for rounding, so results are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize, table

SCALE, K, EVERY = 256, 5, 50
#: Pivots, and the rows of lowest hash from which they are chosen; the same rows give each query a first score to beat.
PIVOTS, SAMPLE = 16, 2048
#: Values of the vectors in a block of rows or of queries, at most; and rows in a block of a small table.
BLOCK_VALUES, LEAST_ROWS, LEAST_BLOCKS = 1 << 22, 1024, 32
FIRST = 32
#: Stands for a null id, which comes after all others.
NO_ID = (1 << 63) - 1


def quantised(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v) with v = floor(scale * x) of each component x as a double.

    Vectors that are null or hold a null, a NaN or an infinity take no part. A component beyond the range of long counts as
    its end, an empty vector is one of zeros, and a null id becomes NO_ID.
    """
    x = F.col(f"`{vector}`")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return rows.where(x.isNotNull() & F.coalesce(whole, F.lit(False))).select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("id"), v.alias("v"))


def matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of int64, short ones with zeros at their end."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of two sets of integer rows: in doubles where all sums are exact in them, else in Python's integers, held to the range of long."""
    most = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    if most(a) * most(b) * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -(1 << 63), NO_ID).astype(np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """float32 distances of rows to pivots."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.stack([np.sqrt(((x - y) ** 2).sum(1)) for y in p], axis=1).astype(np.float32) if len(p) else np.zeros((len(x), 0), np.float32)


def farthest(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the one farthest from those chosen before."""
    x = sample.astype(np.float64)
    if not len(x):
        return sample
    picks, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(picks) < min(n, len(x)) and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picks[-1]]) ** 2).sum(1))
    return sample[picks]


def search(q: np.ndarray, q_table: np.ndarray, beat: np.ndarray, x: np.ndarray, x_table: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query the k rows of highest score, ties to smaller ids, among those that reach ``beat``; and how many were evaluated."""
    half_q, half_x = (q.astype(np.float64) ** 2).sum(1) / 2, (x.astype(np.float64) ** 2).sum(1) / 2
    columns = np.ascontiguousarray(x_table.T)
    out_ids, out_scores, evaluated = [], [], 0
    for i in range(len(q)):
        room = 2e-6 * (float(q_table[i].max(initial=0)) + float(x_table.max(initial=0)))
        alive, low, least = np.arange(len(x)), np.zeros(len(x), np.float32), beat[i]
        for a in range(0, len(columns), 4):
            for p in range(a, min(a + 4, len(columns))):
                np.maximum(low, np.abs((columns[p] if len(alive) == len(x) else columns[p][alive]) - q_table[i, p]), out=low)
            if least is None:
                continue
            bound = half_q[i] + half_x[alive] - np.maximum(low.astype(np.float64) - room, 0) ** 2 / 2
            keep = bound * (1 + 1e-12 * np.sign(bound)) + 1e-3 >= least
            if not keep.all():
                alive, low = alive[keep], low[keep]
        bound = half_q[i] + half_x[alive] - np.maximum(low.astype(np.float64) - room, 0) ** 2 / 2
        bound = bound * (1 + 1e-12 * np.sign(bound)) + 1e-3
        order = np.argsort(-bound, kind="stable")
        alive, bound = alive[order], bound[order]
        best_ids, best, a, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST
        while a < len(alive) and (least is None or bound[a] >= least):
            some = alive[a : a + step]
            best, best_ids = np.concatenate((best, exact(x[some], q[i : i + 1])[:, 0])), np.concatenate((best_ids, ids[some]))
            first = np.lexsort((best_ids, -best.astype(object) if best.min() == -(1 << 63) else -best))[:k]
            best, best_ids = best[first], best_ids[first]
            if len(best) == k and (least is None or best[-1] > least):
                least = int(best[-1])
            a, step = a + len(some), step * 2
        evaluated += a
        out_ids.append(best_ids)
        out_scores.append(best)
    return out_ids, out_scores, evaluated


def top_k(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each of queries(id, v) with the rows(id, v) but its own.

    Both are as ``quantised`` gives them, and queries are some of the rows: of rows that equal a query in id and vector one is
    its own, the others are its candidates. Ties go to smaller ids, a null id last. Repeated queries have a result each;
    where there are fewer than k candidates all are returned; no queries or no other rows give nothing. Shorter vectors count
    as having zeros at their end.

    Rows are dealt in blocks by number, whatever they hold, and queries in blocks; each pair of blocks is a task's group, of
    at most BLOCK_VALUES values a side. Of equal vectors in a batch only the k + 1 smallest ids can count, so large groups of
    copies shrink before they are dealt out.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = seen["n"], max(seen["width"] or 0, 1)
    sample = rows.orderBy(F.xxhash64("id", "v"), "id", F.col("v").cast("string")).limit(SAMPLE).toPandas()
    near = matrix(sample["v"], width)
    pivots = farthest(near, PIVOTS)
    blocks = max(math.ceil(n * width / BLOCK_VALUES), min(LEAST_BLOCKS, math.ceil(n / LEAST_ROWS)), 1)

    def tabled(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = matrix(pdf["v"], width), pdf["id"].to_numpy(np.int64)
            _, same = np.unique(x, axis=0, return_inverse=True)
            order = np.lexsort((ids, same.ravel()))
            first = np.flatnonzero(np.diff(same.ravel()[order], prepend=-1))
            order = np.sort(order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) <= k])
            yield pd.DataFrame({"id": ids[order], "v": x[order].tolist(), "dist": distances(x[order], pivots).tolist()})

    def started(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf["v"], width)
            scores = exact(x, near)
            beat = -np.sort(-scores, axis=1)[:, k] if scores.shape[1] > k else [None] * len(x)
            yield pd.DataFrame({"id": pdf["id"], "copies": pdf["copies"], "v": x.tolist(), "dist": distances(x, pivots).tolist(), "own": [int(exact(y[None], y[None])[0, 0]) for y in x], "beat": pd.array(beat, dtype="Int64")})

    laid = rows.mapInPandas(tabled, "id long, v array<long>, dist array<float>").withColumn("at", F.monotonically_increasing_id())
    laid = materialize(laid, "pivot-table")
    asked = queries.groupBy("id", "v").agg(F.count("*").alias("copies")).mapInPandas(started, "id long, copies long, v array<long>, dist array<float>, own long, beat long")
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    parts = max(math.ceil(asked.count() * width / BLOCK_VALUES), 1)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = asked.withColumn("part", deal("q", parts)).withColumn("block", every(blocks))
    right = laid.withColumn("block", deal("at", blocks)).withColumn("part", every(parts))

    def compared(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        names = ["q", "query_id", "copies", "own", "id", "score"]
        if not len(qs) or not len(xs):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        tables = [np.array(t["dist"].tolist(), np.float32).reshape(len(t), -1) for t in (qs, xs)]
        beat = [None if pd.isna(b) else int(b) for b in qs["beat"].array]
        ids, scores, _ = search(matrix(qs["v"], width), tables[0], beat, matrix(xs["v"], width), tables[1], xs["id"].to_numpy(np.int64), k + 1)
        counts = [len(x) for x in ids]
        return pd.DataFrame({c: np.repeat(qs[s].to_numpy(np.int64), counts) for c, s in (("q", "q"), ("query_id", "id"), ("copies", "copies"), ("own", "own"))} | {"id": np.concatenate(ids), "score": np.concatenate(scores)})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(compared, "q long, query_id long, copies long, own long, id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    self_ = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    met = F.sum(self_.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.withColumns({"self": self_, "met": met}).where("not (self and met = 1)")
    rank = F.col("n") - F.when(F.col("met") > 0, 1).otherwise(0)
    found = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select("query_id", "rank", null("id").alias("vec_id"), "score")


def op11_pivots(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows.where((F.col("id") % EVERY == 0) & (F.col("id") != NO_ID)), rows)


def oracle() -> str:
    return f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM e q JOIN e x ON x.r <> q.r WHERE q.vec_id % {EVERY} = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM k WHERE n <= {K}"""
