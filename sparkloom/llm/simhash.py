"""SimHash fingerprints and a Gray-order hierarchical index that links those within a few bits.

The 64 bits are three blocks, and two fingerprints within two bits of each other agree in one block at least. So the
distinct fingerprints are taken three times, each time turned so that another block stands on top, and dealt by ranges of
that block's Gray rank: the partitions are stretches of one Gray order, and linked fingerprints meet in one of them. Each
partition sorts its fingerprints by Gray rank; runs of neighbours become leaves, runs of leaves upper nodes, and each node
holds the bits that all below it share and no node above it has. A search adds up the differences on the way down and
leaves a whole node out as soon as they exceed the limit.

A block's value with very many distinct fingerprints is dealt out again by finer masks, whose groups cannot exceed
2 ** 22 distinct values, so no key can fill a task however many copies the corpus has.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, components, materialize, shuffle_partitions, small, table

SEED = 42
FULL = (1 << 64) - 1
#: First and last bit, exclusive, of each block.
BLOCKS = ((0, 21), (21, 42), (42, 64))
LEAF = 4
#: Fingerprints that a partition should hold.
PART = 1 << 17
#: A block's value is dealt out again beyond so many fingerprints, or beyond four times the share of a value if that is more.
GROUP_LIMIT = 4096


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(words: list[bytes], k: int) -> int:
    """Unsigned 64-bit SimHash of k-word shingles, repeats included; fewer words are one shingle, none give zero."""
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 15):  # a very long text needs no more memory than a short one
        part = words[start : start + (1 << 15) + k - 1]
        m = len(part) - k + 1
        hashes = np.fromiter((digest(join(s), SEED) for s in zip(*(part[i:] for i in range(k)))), np.uint64, m)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(m, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def with_fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp) of every row of docs; fp as a signed long."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(words_of(t), k)) for t in texts], dtype="int64")

    return docs.select("doc_id", fp(F.col("text").cast("string")).alias("fp"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in Gray order."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """The hierarchy over a set of fingerprints (uint64, any order, no repeats). ``looked`` counts the codes that searches compared."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves' parents up: own mask, own pattern
        self.looked = 0
        everything = np.uint64(FULL)
        low, high = self.codes, self.codes  # AND and OR of all codes below
        shared = []
        while len(low) > 1 or not shared:
            starts = np.arange(0, len(low), LEAF)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            shared.append((everything ^ (low ^ high), low))
        for k, (mask, low) in enumerate(shared):
            above = np.repeat(shared[k + 1][0], LEAF)[: len(mask)] if k + 1 < len(shared) else np.uint64(0)
            own = mask & ~above
            self.levels.append((own, low & own))
        leaf = np.repeat(shared[0][0], LEAF)[: len(self.codes)]
        self.rest = ~leaf

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) index pairs at no more than ``most`` differing bits; codes in Gray order."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        mask, pattern = self.levels[-1]
        far = popcount((queries ^ pattern[0]) & mask[0])
        for level in range(len(self.levels) - 1, -1, -1):
            live = far <= most
            q, node, far = q[live], node[live], far[live]
            masks, patterns = self.levels[level - 1] if level else (self.rest, self.codes & self.rest)
            child = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            q, far, node = np.repeat(q, LEAF), np.repeat(far, LEAF), child
            if len(child) and child.max() >= len(masks):
                there = child < len(masks)
                q, far, node = q[there], far[there], child[there]
            far = far + popcount((queries[q] ^ patterns[node]) & masks[node])
        self.looked += len(q)
        live = far <= most
        return q[live], node[live]


def forest(index: GrayIndex, most: int) -> np.ndarray:
    """Enough links (rows of two codes) to connect all codes of the index that links within ``most`` bits connect."""
    codes = index.codes
    root = np.arange(len(codes))
    out = [np.zeros((0, 2), np.uint64)]
    for start in range(0, len(codes), 512):
        q, c = index.search(codes[start : start + 512], most)
        q = q + start
        q, c = q[q < c], c[q < c]
        while len(q):
            x, y = root[q], root[c]
            apart = x != y
            q, c, x, y = q[apart], c[apart], x[apart], y[apart]
            if not len(q):
                break
            # each root that has a smaller one beside it joins the smallest
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
            root[high[first]] = low[first]
            out.append(np.stack((codes[q[first]], codes[c[first]]), axis=1))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return np.concatenate(out)


def turned(code: np.ndarray, block: int, back: bool = False) -> np.ndarray:
    """The codes turned so that the block's bits are the highest, or turned back."""
    k = 64 - BLOCKS[block][1]
    k = (64 - k) % 64 if back else k
    return code if not k else code << np.uint64(k) | code >> np.uint64(64 - k)


def _links(most: int):
    """mapInPandas function: a partition's (block, code) to the links that connect its codes."""

    def run(batches):
        kept = [(b["block"].to_numpy(np.int8), b["code"].to_numpy(np.int64)) for b in batches]
        if not kept:
            return
        blocks, codes = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
        for block in np.unique(blocks):
            found = forest(GrayIndex(np.unique(codes[blocks == block]).view(np.uint64)), most)
            found = turned(found, int(block), back=True).view(np.int64)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return run


def _turned(code: Column, block: int) -> Column:
    k = 64 - BLOCKS[block][1]
    return F.shiftleft(code, k).bitwiseOR(F.shiftrightunsigned(code, 64 - k)) if k else code


def _top_rank(code: Column, block: int) -> Column:
    """The Gray rank of the block on top of a turned code."""
    low, high = BLOCKS[block]
    r = F.shiftrightunsigned(code, 64 - (high - low))
    for s in (1, 2, 4, 8, 16):
        r = r.bitwiseXOR(F.shiftright(r, s))
    return r


def _finer(block: int) -> list[int]:
    """Masks of turned codes: the block on top and two of four parts of the rest, of which two agree."""
    low, high = BLOCKS[block]
    n = 64 - (high - low)
    cuts = [n * i // 4 for i in range(5)]
    parts = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(4)]
    return [(FULL ^ ((1 << n) - 1)) | x | y for x, y in combinations(parts, 2)]


def fingerprint_links(codes: DataFrame, most: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``codes(fp)`` exactly as all links within ``most`` (0 to 2) bits do."""
    if not 0 <= most < len(BLOCKS):
        raise ValueError("three blocks are made for 0 to 2 differing bits")
    every = range(len(BLOCKS))
    turns = F.array(*[F.struct(F.lit(b).alias("block"), _turned(F.col("fp"), b).alias("code")) for b in every])
    rows = codes.select(F.explode(turns).alias("t")).select("t.block", "t.code")
    rank = F.when(F.col("block") == 0, _top_rank(F.col("code"), 0)).when(F.col("block") == 1, _top_rank(F.col("code"), 1)).otherwise(_top_rank(F.col("code"), 2))
    rows = rows.select("block", rank.alias("key"), "code")
    groups = rows.groupBy("block", "key").count()
    n = codes.count()
    hot = materialize(groups.where(F.col("count") > max(group_limit, 4 * n >> 21)).select("block", "key"), "hot")
    parts = max(shuffle_partitions(codes.sparkSession), -(-len(BLOCKS) * n // PART))

    def linked(dealt: DataFrame) -> DataFrame:
        return dealt.repartitionByRange(parts, "block", "key").select("block", "code").mapInPandas(_links(most), "a long, b long")

    if hot.isEmpty():
        return linked(rows)
    marked = small(hot)
    kept = rows.join(marked, ["block", "key"], "left_anti")
    # each hot row goes on to the six finer masks of its own block
    masks = F.array(*[F.array(*[F.lit(signed(m)) for m in _finer(b)]) for b in every])
    again = rows.join(marked, ["block", "key"], "left_semi").select("block", "code", F.posexplode(masks[F.col("block")]).alias("i", "mask"))
    again = again.select("block", F.struct("i", F.col("code").bitwiseAND(F.col("mask")).alias("bits")).alias("key"), "code")
    return linked(kept).unionByName(linked(again))


def simhash_components(docs: DataFrame, k: int = 3, most: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs(doc_id, text).

    A null or blank text has fingerprint zero and is linked like any other. Repeated rows stay, with one component.
    A row with a null doc_id takes part in links; component_id is the smallest doc_id that isn't null, or null if a
    component has none. Other columns of docs are ignored. An empty table gives an empty result.
    """
    prints = materialize(with_fingerprints(docs, k), "simhash")
    codes = prints.groupBy("fp").agg(F.min("doc_id").alias("m"))
    links = fingerprint_links(codes.select("fp"), most, group_limit)
    roots = components(links)
    rooted = materialize(codes.join(roots.withColumnRenamed("node", "fp"), "fp"), "rooted")
    lowest = materialize(rooted.groupBy("root").agg(F.min("m").alias("low")), "lowest")
    linked = materialize(rooted.join(small(lowest), "root").select("fp", "low"), "linked")
    classes = materialize(codes.join(linked, "fp", "left").select("fp", F.coalesce("low", "m").alias("component_id")), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
