"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source's weight is its share of the tokens to an exponent, normalised. The exponent is bisected: the largest at which the
weights have the target entropy, or the smallest that keeps to the repetition limit if that is larger. Every source is then
laid out epoch by epoch in a keyed permutation, all are stretched to the same length, and the whole is cut into blocks of
one token budget, so each block holds the sources by weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize, shuffle_partitions, small, table

SEED = 31
ENTROPY = 0.95  # of the logarithm of the number of sources
REPEATS = 2.0
BLOCK_TOKENS = 1 << 16
STEPS = 6  # of bisection for each pass over the sources
ROUNDS = 8
#: Rows in a bucket of a source, and buckets in a shelf: running totals go over one bucket, one shelf or all shelves of a source.
PER_BUCKET, PER_SHELF = 512, 4096
#: Per-source figures are broadcast up to so many sources and joined by shuffle beyond.
BROADCAST_SOURCES = 50_000


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    exponent: float
    n_sources: int
    sources: DataFrame  # source, tokens, docs, weight, repeats


def _bisect(low: float, high: float, holds) -> tuple[float, float]:
    """The ends of the last interval of a bisection of [low, high], for what holds below some point and not above; STEPS at a time."""
    cuts = 1 << STEPS
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / cuts for i in range(1, cuts)]
        last = low
        for x, ok in zip(points, holds(points)):
            if not ok:
                high = x
                break
            last = x
        low = last
    return low, high


def plan(rows: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> Mix:
    """Weights and repeats of the sources of rows(source, tokens).

    Without a budget the mix is the shortest that holds every source in full at least once. Sources without tokens have
    weight 0 and are laid out once. A null source is a source.
    """
    if not 0 <= entropy <= 1 or repeats < 1:
        raise ValueError("entropy is a share of the most there can be, and repeats at least 1")
    sources = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    known = sources.where("tokens > 0")
    facts = known.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    n = sources.count()
    if not facts["n"]:
        return Mix(1.0, n, sources.select("*", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats")))
    total, most = float(facts["t"]), float(facts["most"])
    p = F.col("tokens") / F.lit(total)
    target = entropy * float(known.select(F.log(F.lit(float(facts["n"])))).first()[0])

    def even_enough(points: list[float]) -> list[bool]:
        sums = [x for a in points for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        row = known.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)])
        terms = [F.log(F.col(f"c{2 * i}")) - F.lit(a) * F.col(f"c{2 * i + 1}") / F.col(f"c{2 * i}") for i, a in enumerate(points)]
        return [h >= target - 1e-12 for h in row.select(*[t.alias(f"h{i}") for i, t in enumerate(terms)]).first()]

    def over(points: list[float]) -> list[bool]:
        if budget is None:
            worst = [F.max(F.pow(F.lit(most) / F.col("tokens"), F.lit(1 - a))) for a in points]
            return [w > repeats for w in known.agg(*[w.alias(f"w{i}") for i, w in enumerate(worst)]).first()]
        cols = [x for i, a in enumerate(points) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.max(F.pow(p, F.lit(a)) / F.col("tokens")).alias(f"m{i}"))]
        row = known.agg(*cols).first()
        return [budget * row[f"m{i}"] / row[f"z{i}"] > repeats for i in range(len(points))]

    a = 1.0 if even_enough([1.0])[0] else _bisect(0.0, 1.0, even_enough)[0]
    if over([a])[0]:
        a = 1.0 if over([1.0])[0] else _bisect(a, 1.0, over)[1]  # too many repeats below, few enough from here on
    z = known.agg(F.sum(F.pow(p, F.lit(a)))).first()[0]
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(0.0)
    if budget is None:
        times = F.when(F.col("tokens") > 0, F.pow(F.lit(most) / F.col("tokens"), F.lit(1 - a))).otherwise(1.0)
    else:
        times = F.when(F.col("tokens") > 0, F.lit(float(budget)) * weight / F.col("tokens")).otherwise(1.0)
    return Mix(a, n, sources.select("*", weight.alias("weight"), F.round(times, 9).alias("repeats")))  # so that a limit met is met exactly


def lay_out(rows: DataFrame, mix: Mix, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row for each copy of rows(key, mark, source, tokens): key, source, tokens, weight, repeats, epoch, block and turn.

    ``mark`` tells rows of one key apart, so that each has a turn of its own. A source's whole epochs hold all its rows; the
    last, partial one holds those whose turn begins before it ends. A large source is cut into buckets of the keyed order, and
    those into shelves, so running totals never need more than one of them in a task.
    """
    buckets = F.greatest(F.ceil(F.col("docs") / PER_BUCKET), F.lit(1)).cast("long")
    figures = mix.sources.select(F.col("source").alias("s"), F.col("tokens").alias("of"), "weight", "repeats", buckets.alias("buckets"))
    total = mix.sources.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] or 0.0
    blocks = max(1, -(-int(total) // block_tokens))
    if mix.n_sources <= BROADCAST_SOURCES:
        figures = F.broadcast(figures)
    at = rows.join(figures, rows["source"].eqNullSafe(F.col("s"))).drop("s")
    last = F.greatest(F.ceil("repeats").cast("int") - 1, F.lit(0))
    at = at.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    at = at.withColumn("turn", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("mark"))), 1, 15), 16, 10).cast("long"))
    at = at.withColumn("bucket", F.pmod(F.shiftright("turn", 20), F.col("buckets")))
    group = ["source", "epoch", "bucket"]
    sums = at.groupBy(*group).agg(F.sum("tokens").alias("in_bucket"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("shelf", F.floor(F.col("bucket") / PER_SHELF))
    shelves = sums.groupBy("source", "epoch", "shelf").agg(F.sum("in_bucket").alias("in_shelf"))
    shelves = shelves.select(*[F.col(c).alias(f"s_{c}") for c in ("source", "epoch", "shelf")], F.coalesce(F.sum("in_shelf").over(before(Window.partitionBy("source", "epoch").orderBy("shelf"))), F.lit(0)).alias("below"))
    sums = sums.join(shelves, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("epoch") == F.col("s_epoch")) & (F.col("shelf") == F.col("s_shelf")))
    ahead = F.col("below") + F.coalesce(F.sum("in_bucket").over(before(Window.partitionBy("source", "epoch", "shelf").orderBy("bucket"))), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"g_{c}") for c in group], ahead.alias("ahead"))
    own = F.sum("tokens").over(before(Window.partitionBy(*group).orderBy("turn", "key", "mark")))
    at = at.withColumn("own", F.coalesce(own, F.lit(0)))
    match = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in group]
    at = at.join(sums, match[0] & match[1] & match[2])
    before = F.when(F.col("of") > 0, (F.col("ahead") + F.col("own")) / F.col("of")).otherwise(0.0)
    at = at.withColumn("place", F.col("epoch") + before).where("place < repeats")
    block = F.least(F.floor(F.col("place") / F.col("repeats") * blocks), F.lit(blocks - 1))
    return at.select("key", "source", "tokens", "weight", "repeats", "epoch", block.cast("long").alias("block"), "turn")


def mix_documents(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, weight, repeats, epoch, block and turn of every copy of docs(doc_id, text, source) in the mix.

    Blocks follow each other, and rows within a block by turn. Null and empty texts have no tokens but are laid out like
    others. Null and repeated ids are allowed, each row being laid out by itself: rows of one id are told apart by their texts'
    hash, and equal rows are counted and numbered, so the result doesn't depend on where rows are read. Other columns are
    ignored; an empty table gives an empty result.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").alias("key"), F.col("source").cast("string").alias("source"), digest.alias("digest"), n_tokens(F.col("text")).alias("tokens"))
    rows = rows.groupBy("key", "source", "digest", "tokens").agg(F.count("*").alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = materialize(rows.select("key", F.concat_ws(":", "digest", F.col("copy").cast("string")).alias("mark"), "source", "tokens"), "tokens")
    out = lay_out(rows, plan(rows, entropy, repeats, budget), block_tokens, seed)
    return out.select(F.col("key").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("repeats", 6).alias("repeats"), "epoch", "block", "turn")


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) themselves, each as often as the mix has it, block by block.

    As ``mix_documents``, but all columns stay and rows alike in doc_id, source and text are laid out together.
    """
    names = docs.columns
    source = F.col("source").cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(whole, F.xxhash64("doc_id", source, F.col("text").cast("string")).alias("key"), source.alias("source"))
    rows = keyed.select("key", "source", n_tokens(F.col("row.text")).alias("tokens"))
    rows = materialize(rows.groupBy("key", "source").agg(F.sum("tokens").alias("tokens")).withColumn("mark", F.lit("")), "tokens")
    copies = lay_out(rows, plan(rows, entropy, repeats, budget), block_tokens, seed)
    copies = materialize(copies.select("key", "block", "turn"), "copies")
    out = keyed.select("row", "key").join(small(copies), "key").repartition(shuffle_partitions(docs.sparkSession), "block").sortWithinPartitions("block", "turn")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def oracle() -> str:
    entropy = "(ln(list_sum(list_transform(ps, lambda p: pow(p, {0}))) ) - {0} * list_sum(list_transform(ps, lambda p: pow(p, {0}) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, {0}))))"
    enough = f"{entropy.format('mid')} >= {ENTROPY} * ln(n) - 1e-12"
    half = "i + 1 AS i, CASE WHEN {0} THEN mid ELSE lo END AS lo, CASE WHEN {0} THEN hi ELSE mid END AS hi"
    return f"""WITH RECURSIVE t AS (SELECT doc_id, source, md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::DOUBLE AS tok, count(*) AS docs FROM t GROUP BY 1),
f AS (SELECT list(tok / (SELECT sum(tok) FROM s) ORDER BY source) AS ps, max(tok) AS most, min(tok) AS low, count(*)::DOUBLE AS n FROM s WHERE tok > 0),
e(i, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL SELECT {half.format(enough)} FROM (SELECT *, (lo + hi) / 2 AS mid FROM e WHERE i < {STEPS * ROUNDS}), f),
a1 AS (SELECT CASE WHEN {entropy.format('1.0')} >= {ENTROPY} * ln(n) - 1e-12 THEN 1.0::DOUBLE ELSE (SELECT lo FROM e ORDER BY i DESC LIMIT 1) END AS a FROM f),
o(i, lo, hi) AS (SELECT 0, a, 1::DOUBLE FROM a1 UNION ALL SELECT {half.format(f'pow(most / low, 1 - mid) > {REPEATS}')} FROM (SELECT *, (lo + hi) / 2 AS mid FROM o WHERE i < {STEPS * ROUNDS}), f),
a2 AS (SELECT CASE WHEN pow(most / low, 1 - a) > {REPEATS} THEN (SELECT hi FROM o ORDER BY i DESC LIMIT 1) ELSE a END AS a FROM a1, f),
w AS (SELECT source, tok, CASE WHEN tok > 0 THEN pow(tok / (SELECT sum(tok) FROM s), a) / list_sum(list_transform(ps, lambda p: pow(p, a))) ELSE 0 END AS weight,
 round(CASE WHEN tok > 0 THEN pow(most / tok, 1 - a) ELSE 1 END, 9) AS repeats, greatest(ceil(docs / {PER_BUCKET}), 1)::BIGINT AS buckets FROM s, f, a2),
b AS (SELECT greatest(1, ceil(trunc(sum(tok * repeats)) / {BLOCK_TOKENS}))::BIGINT AS blocks FROM w),
c AS (SELECT t.*, tok, weight, repeats, buckets, unnest(range(0, greatest(ceil(repeats)::INT - 1, 0) + 1)) AS epoch FROM t JOIN w USING (source)),
h AS (SELECT *, ('0x' || substr(md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || mark), 1, 15))::BIGINT AS turn FROM c),
p AS (SELECT *, epoch + CASE WHEN tok > 0 THEN coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY (turn >> 20) % buckets, turn, doc_id, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / tok ELSE 0 END AS place FROM h)
SELECT doc_id, source, tokens AS n_tokens, round(weight, 6) AS weight, round(repeats, 6) AS repeats, epoch::INT AS epoch, least(floor(place / repeats * blocks), blocks - 1)::BIGINT AS block, turn FROM p, b WHERE place < repeats"""


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
