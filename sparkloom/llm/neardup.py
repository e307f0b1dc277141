"""Near-dedup of whole documents on five-word shingles at a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints linked through the Gray-order index, and from bands of minimum hashes, because
fingerprints of texts that are 0.8 alike differ by about ten of 64 bits, far beyond what any exact index can search. Each
candidate is verified on the two texts' own shingles, and verified links are joined to components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, components, materialize, small
from .simhash import fingerprint_links
from .words import mix, words_in

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 4
CENTRES = 5
#: Texts in a bucket up to which all are compared with all.
FEW = 6
#: Shingles of a large bucket that one task holds against as many others.
SIDE = 1 << 20
_SALTS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word; A-Z lower-cased, split at ASCII white space."""
    return words_in((text or "").encode("utf-8", "surrogatepass").lower())[2]


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A hash of each k-word shingle, repeats included; fewer words are one shingle, none have none."""
    n = max(len(words) - k + 1, min(len(words), 1))
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(h)


def sketch(text: str | None) -> tuple[int, int, int, np.ndarray]:
    """Two hashes of the word sequence, the SimHash of its shingles, and one key for each band (none for a wordless text)."""
    words = word_hashes(text)
    if not len(words):
        return 0, 0, 0, np.zeros(0, np.int64)
    h = shingle_hashes(words)
    order = np.arange(1, len(words) + 1, dtype=np.uint64)
    one, two = (int(mix(np.add.reduce(mix(words * np.uint64(m) + order)[None, :], axis=1))[0]) for m in (3, 0x632BE59BD9B4E019))
    counts, low = np.zeros(64, np.int64), np.full(len(_SALTS), 2**64 - 1, np.uint64)
    for a in range(0, len(h), 1 << 15):
        part = h[a : a + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        for i, s in enumerate(_SALTS):
            low[i] = min(low[i], (part * s).min())
    bits = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
    keys = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + low[r::ROWS])
    return one, two, int(bits), keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def candidate_pairs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a > b, of node ids of texts(node, fp, bands), linear in the number of texts; and the buckets
    (band, key, node, n).

    In a small bucket all texts meet. In one of more than FEW every text meets CENTRES others: the smallest node, and those
    that share most buckets with others, by several weightings; in a group of copies of one text that is the text itself.
    ``rest_links`` compares what that leaves.
    Texts of one fingerprint meet its smallest node, and those meet along the index's links.
    """
    rows = texts.select("node", F.posexplode("bands").alias("band", "key"))
    shared = materialize(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = materialize(rows.join(shared, ["band", "key"]), "buckets")
    few = rows.where(F.col("n") <= FEW).groupBy("band", "key").agg(F.array_sort(F.collect_set("node")).alias("s"))
    few = few.select(F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as node, y as other))))")).alias("p")).select("p.*")
    degree = rows.groupBy("node").agg(F.sum("n").alias("degree"))
    many = rows.where(F.col("n") > FEW)
    ranked = many.join(degree, "node")
    unit = lambda i: F.pmod(F.xxhash64("node", "band", F.lit(i)), F.lit(1 << 20)) / (1 << 20)
    best = [F.max_by("node", F.struct(F.col("degree") * (1 + 0.4 * i * unit(i)), "node")).alias(f"m{i}") for i in range(CENTRES - 1)]
    centres = ranked.groupBy("band", "key").agg(F.min("node").alias("first"), *best)
    picks = F.array_distinct(F.array("first", *[f"m{i}" for i in range(CENTRES - 1)]))
    centres = materialize(centres.select("band", "key", F.explode(picks).alias("other")), "centres")
    banded = many.join(centres, ["band", "key"]).select("node", "other").unionByName(few)
    heads = materialize(texts.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "heads")
    same = texts.select("node", "fp").join(heads.where("n > 1"), "fp").select("node", F.col("head").alias("other"))
    links = fingerprint_links(heads.select("fp"))
    ends = [heads.select(F.col("fp").alias(x), F.col("head").alias(y)) for x, y in (("a", "node"), ("b", "other"))]
    linked = links.join(ends[0], "a").join(ends[1], "b").select("node", "other")
    pairs = banded.unionByName(same).unionByName(linked).where("node <> other")
    return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), rows


def rest_links(buckets: DataFrame, roots: DataFrame, texts_of, similar: float) -> DataFrame | None:
    """Links (a, b) within buckets(band, key, node, n) that connect all that the links behind roots(node, root) leave apart.

    Of a bucket whose texts aren't one component yet, every text outside its largest component is held against all of the
    bucket on their shingles, in blocks of about SIDE shingles, each pair of blocks a task's; nothing but links of
    ``similar`` or more between components leaves a task. ``texts_of`` gives (node, text) of given nodes. None if nothing is left.
    """
    where = ["band", "key"]
    big = buckets.where(F.col("n") > FEW).join(roots, "node", "left").select(*where, "node", F.coalesce("root", "node").alias("root"))
    big = materialize(big, "large-buckets")
    most = big.groupBy(*where, "root").agg(F.count("*").alias("c")).groupBy(*where).agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main"))
    most = materialize(most.where("roots > 1").drop("roots"), "split-buckets")
    if most.isEmpty():
        return None
    held = materialize(big.join(small(most), where), "held")

    @F.pandas_udf("array<long>")
    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(word_hashes(t))).view(np.int64) for t in texts])

    sets = materialize(texts_of(held.select("node").distinct()).select("node", shingled("text").alias("set")), "shingles")
    sides = held.join(sets.select("node", F.size("set").alias("size")), "node").groupBy(*where).agg(F.ceil(F.sum("size") / SIDE).cast("int").alias("sides"))
    held = held.join(small(materialize(sides, "sides")), where)
    own, every = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    left = held.where("root <> main").select(*where, "node", "root", own.alias("x"), every.alias("y")).join(sets, "node")
    right = held.select(*where, "node", "root", own.alias("y"), every.alias("x")).join(sets, "node")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: both sides come from the same tables

    def compared(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(two):
            sizes = np.array([len(x) for x in two["set"]])
            known, place = np.unique(np.concatenate(two["set"].tolist()), return_inverse=True)
            begins, marks = np.cumsum(sizes) - sizes, np.zeros(len(known), bool)
            nodes, roots = two["node"].to_numpy(), two["root"].to_numpy()
            for node, root, s in zip(one["node"], one["root"], one["set"]):
                i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                i = i[known[i] == s]
                marks[i] = True
                both = np.add.reduceat(marks[place], begins, dtype=np.int64)
                marks[i] = False
                near = np.flatnonzero((both >= similar * (len(s) + sizes - both)) & (roots != root))
                out += [(node, nodes[j]) for j in near[np.unique(roots[near], return_index=True)[1]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    blocks = [*where, "x", "y"]
    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(compared, "a long, b long")


def near_groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(key, stays) of every distinct text of docs(doc_id, text): its hash, and the key of its group's document that stays.

    Texts with equal words are one; groups are the components of links of ``similar`` or more. The smallest doc_id of a
    group stays (null ids last; of several texts under that id the one of lowest hash). All wordless texts are one group.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("one long, two long, fp long, bands array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = [sketch(t) for t in texts]
        signed = lambda i: np.array([r[i] for r in rows], np.uint64).view(np.int64)
        return pd.DataFrame({"one": signed(0), "two": signed(1), "fp": signed(2), "bands": [r[3] for r in rows]})

    text = F.col("text").cast("string")
    rows = docs.select(row_key().alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), sketched(text).alias("s"))
    rows = materialize(rows.select("key", "ord", "s.*"), "sketches")
    # one node for each distinct sequence of words
    classes = rows.groupBy("one", "two").agg(F.min(F.struct("ord", "key")).alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = classes.select("one", "two", F.col("low.ord").alias("ord"), F.col("low.key").alias("node"), "fp", "bands")
    classes = materialize(classes, "classes")
    pairs, buckets = candidate_pairs(classes)
    pairs = materialize(pairs, "pairs")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = small(materialize(nodes.select("node").distinct(), "wanted"))
        return docs.select(row_key().alias("node"), text.alias("text")).join(wanted, "node", "left_semi").dropDuplicates(["node"])

    texts = materialize(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "texts")

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        kept: dict[str, np.ndarray] = {}

        def shingles(t):
            if t not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[t] = np.unique(shingle_hashes(word_hashes(t)))
            return kept[t]

        return pd.Series([jaccard(shingles(a), shingles(b)) >= similar for a, b in zip(x, y)])

    ends = [texts.select(F.col("node").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y"))]
    links = materialize(pairs.join(ends[0], "a").join(ends[1], "b").where(alike("x", "y")).select("a", "b"), "links")
    roots = components(links)
    rest = rest_links(buckets, roots, texts_of, similar)
    if rest is not None:
        rest = materialize(rest, "rest")
        roots = roots if rest.isEmpty() else components(links.unionByName(rest))
    rooted = materialize(classes.select("ord", "node").join(roots, "node"), "rooted")
    lows = materialize(rooted.groupBy("root").agg(F.min(F.struct("ord", "node")).alias("low")), "lows")
    moved = materialize(rooted.join(small(lows), "root").where("low.node <> node").select("node", F.col("low.node").alias("other")), "moved")
    stays = classes.join(moved, "node", "left").select("one", "two", F.coalesce("other", "node").alias("stays"))
    stays = materialize(stays, "stays")
    return rows.join(stays, ["one", "two"]).select("key", "stays")


def row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs(doc_id, text, ...) with one document of each group of near-duplicates; all columns stay.

    See ``near_groups``. Rows that repeat both doc_id and text are one document and stay or go together. An empty table gives
    an empty result.
    """
    names = docs.columns
    gone = small(materialize(near_groups(docs.select("doc_id", "text"), similar).where("key <> stays").select("key").distinct(), "gone"))
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), row_key().alias("key"))
    return wide.join(gone, "key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in names])
