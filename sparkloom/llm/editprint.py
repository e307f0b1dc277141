"""Fingerprints by randomised edit embedding.

All texts take the same random walk: at step j the walk writes the character it stands on and moves on or stays, as a bit
decides that depends on j and the character alone. Texts within a few edits of each other soon walk in step again, so edit
distance becomes Hamming distance of what is written. The fingerprint samples bits of that string at shared steps, as many
from each doubling of the walk's length as from the next, so one layout serves texts of every length. Bands of sampled bits
give candidates, the likeness of whole fingerprints verifies them, and verified links make classes.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, components, materialize, shuffle_partitions, small, table

#: The walk's bits repeat after PERIOD steps; characters count modulo CLASSES.
PERIOD, CLASSES = 4096, 512
BITS = 128  # sampled from each octave of steps
FIRST = 7  # the first octave holds steps below 2**FIRST
BLOCK = 64  # steps between two looks at which walks have ended
MOST_CHARS = 1 << 23  # of a batch, unless a single text is longer
_rng = np.random.default_rng(2718)
_moves = _rng.integers(0, 2, (PERIOD, CLASSES)).astype(np.int8)
_moves[:, 0] = 0  # class 0 is the mark behind a text's end
_marks = _rng.integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)


def octave_range(octave: int) -> tuple[int, int]:
    return (0 if octave == 0 else 1 << (FIRST + octave - 1)), 1 << (FIRST + octave)


@cache
def sampled_steps(octave: int) -> np.ndarray:
    """The sampled steps of an octave in ascending order, without repeats while it has enough."""
    low, high = octave_range(octave)
    rng = np.random.default_rng(1000 + octave)
    few = high - low < 1 << 20
    return low + np.sort(rng.choice(high - low, BITS, replace=False) if few else rng.integers(0, high - low, BITS))


def octaves_of(n_chars: int) -> int:
    """Octaves that hold three steps for each character; a walk needs about two."""
    octaves = 1
    while octave_range(octaves - 1)[1] < 3 * n_chars:
        octaves += 1
    return octaves


def walk(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled bits (a row for each text, BITS columns for each octave of the longest), octaves and code points of each text.

    Past the end of a text its walk stands on an end mark, so rows of unequal texts can be compared column by column.
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-sizes, kind="stable")
    n_oct = np.array([octaves_of(int(n)) for n in sizes])
    most = int(n_oct.max())
    marked = np.concatenate([sampled_steps(k) for k in range(most)])
    bits = np.repeat(_marks[marked % PERIOD, 0][None, :], len(texts), axis=0)  # in the order of length until the end
    end = np.zeros(1, np.int16)
    flat = np.concatenate([x for i in order for x in ((codes[i] % (CLASSES - 1) + 1).astype(np.int16), end)])
    ends = np.cumsum(sizes[order] + 1) - 1
    at = ends - sizes[order]
    stops = marked.tolist() + [-1]
    step, m, live = 0, 0, len(texts)
    while live and m < len(marked):
        pos = at[:live]
        for j in range(step, step + BLOCK):
            c = flat.take(pos)
            while stops[m] == j:
                bits[:live, m] = _marks[j % PERIOD].take(c)
                m += 1
            pos += _moves[j % PERIOD].take(c)
        step += BLOCK
        while live and at[live - 1] >= ends[live - 1]:  # the shortest walks end first, more or less
            live -= 1
    out = np.empty_like(bits)
    out[order] = bits
    return out, n_oct, sizes


def printed(bits: np.ndarray, octaves: np.ndarray) -> list[str]:
    packed = np.packbits(bits, axis=1)
    return [row[: k * BITS // 8].tobytes().hex() for row, k in zip(packed, octaves)]


def likeness(bits_a: np.ndarray, bits_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """For each pair of rows: 1 for equal bits, else about the share of the longer walk on which both stand on equal characters."""
    steps = np.maximum(2 * np.maximum(size_a, size_b), 1)
    differ = bits_a != bits_b
    total, off = np.zeros(len(steps)), np.zeros(len(steps))
    for o in range(bits_a.shape[1] // BITS):
        low, high = octave_range(o)
        used = sampled_steps(o)[None, :] < steps[:, None]
        share = (differ[:, o * BITS : (o + 1) * BITS] & used).sum(1) / np.maximum(used.sum(1), 1)
        w = np.where(used.any(1), np.clip(np.minimum(steps, high) - low, 0, None), 0)
        total += w
        off += w * share
    # bits of unequal characters agree half the time
    return np.where(differ.any(1), np.clip(1 - 2 * off / np.maximum(total, 1), 0, 1), 1.0)


#: Row k: 128 bits of which the first k are set, as two words.
_FIRST_BITS = np.packbits(np.arange(BITS) < np.arange(BITS + 1)[:, None], axis=1).view(np.uint64)


def packed_likeness(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """``likeness`` of packed bits: two words for each octave of a row."""
    steps = np.maximum(2 * np.maximum(size_a, size_b), 1)
    differ = a ^ b
    total, off = np.zeros(len(steps)), np.zeros(len(steps))
    for o in range(differ.shape[1] // 2):
        low, high = octave_range(o)
        used = np.searchsorted(sampled_steps(o), steps)
        share = np.bitwise_count(differ[:, 2 * o : 2 * o + 2] & _FIRST_BITS[used]).sum(1) / np.maximum(used, 1)
        w = np.where(used > 0, np.clip(np.minimum(steps, high) - low, 0, None), 0)
        total += w
        off += w * share
    return np.where(differ.any(1), np.clip(1 - 2 * off / np.maximum(total, 1), 0, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


SAMPLED = 64  # rows looked at for each partition to find the ranges' bounds
PART_BYTES = 1 << 26
#: The driver holds bounds of at most so many ranges and about so many rows of the sample; ranges of a larger table grow instead,
#: which their tasks read a batch at a time.
MOST_PARTS, MOST_SAMPLED = 1 << 16, 1 << 20
LONG = "cast(-9223372036854775808 as bigint)"


def _order_bytes(*columns: np.ndarray) -> np.ndarray:
    """Rows of longs as byte strings of the same order."""
    both = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1).astype(">u8")
    return np.ascontiguousarray(both).view(f"S{8 * len(columns)}").ravel()


def _bounds(rows: DataFrame) -> tuple[np.ndarray, tuple[int, ...]]:
    """The keys (ident, hash) of the rows that open the second and each further range, and the key of the first row."""
    state = rows.agg(F.count("*").alias("n"), F.sum(F.length("text") + 16).alias("size"), F.min(F.struct("ident", "hash")).alias("first")).first()
    if not state["n"]:
        return np.zeros((0, 2), np.int64), (0, 0)
    parts = min(MOST_PARTS, max(shuffle_partitions(rows.sparkSession), -(-state["size"] // PART_BYTES)))
    share = min(1.0, SAMPLED * parts / state["n"], MOST_SAMPLED / state["n"])
    sample = rows.select("ident", "hash", (F.length("text") + 16).alias("size")).sample(share, 3) if share < 1 else rows.select("ident", "hash", (F.length("text") + 16).alias("size"))
    sample = sample.toPandas().sort_values(["ident", "hash"], ignore_index=True)  # about MOST_SAMPLED rows at most
    sizes = sample["size"].to_numpy(np.int64)
    places = np.searchsorted(np.cumsum(sizes), sizes.sum() * np.arange(1, parts) / parts)
    return sample[["ident", "hash"]].to_numpy(np.int64)[np.unique(places[places < len(sample)])], tuple(state["first"])


def _slots(spark, n: int) -> np.ndarray:
    """For each of n partitions a number that hash partitioning puts there."""
    slots, start = np.full(n, -1, np.int64), 0
    while (slots < 0).any():
        ids = spark.range(start, start + 8 * n).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).toPandas()["p"].to_numpy()
        slots[ids] = np.arange(start, start + 8 * n)
        start += 8 * n
    return slots


def _print_rows(batches, per_batch: int):
    """Rows sorted by part, ahead and order; the rows ahead are only looked at, as what follows the part's last row."""
    held, unpack = None, zstandard.ZstdDecompressor()
    part, done = -1, 0

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        nonlocal part, done
        texts, ahead = pdf["text"].tolist(), pdf["ahead"].to_numpy()
        own = np.flatnonzero(~ahead[:-1])
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        bits, octaves, n = walk(texts + changed)
        prints = printed(bits, octaves)
        after = np.arange(len(texts), len(texts) + len(own))
        parts = pdf["part"].to_numpy()[own]
        numbers = np.arange(len(own)) - np.searchsorted(parts, parts)
        if len(own) and parts[0] == part:
            numbers[parts == part] += done
        if len(own):
            part, done = int(parts[-1]), int(numbers[-1]) + 1
        return pd.DataFrame({
            "row_id": (parts.astype(np.int64) << 40) + numbers, "doc_id": pdf["doc_id"].iloc[own].astype("Int64"), "n_chars": n[own],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [prints[i] for i in own], "edited_fingerprint": prints[len(texts) :],
            "near_edited": likeness(bits[own], bits[after], n[own], n[after]), "near_next": likeness(bits[own], bits[own + 1], n[own], n[own + 1]),
        })

    for pdf in batches:
        pdf["text"] = [unpack.decompress(x).decode("utf-8", "surrogatepass") for x in pdf["packed"]]
        pdf = pdf.drop(columns="packed")
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        lengths = pdf["text"].str.len().to_numpy()
        start = 0
        while len(pdf) - start > 1:
            stop = start + 2
            fits = np.searchsorted(np.cumsum(lengths[start:]), MOST_CHARS)
            stop = min(len(pdf), start + per_batch, max(stop, start + int(fits)))
            yield made(pdf.iloc[start:stop])
            start = stop - 1
        held = pdf.iloc[start:]


def edit_fingerprints(docs: DataFrame, per_batch: int = 2048) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs(doc_id, text),
    and row_id, which no other row has.

    Null texts are empty. The next document is the next row by doc_id, nulls first, and then by a hash of the text; after the
    last comes the first, and a single row is its own next. Repeated rows stay and have equal fingerprints. Other columns
    are ignored; an empty table gives an empty result. Rows are dealt out by ranges of that order, one to a partition and even
    if one id holds very many rows, and each range also gets the row that opens the next, so every text moves once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.expr(LONG)).alias("ident"), F.xxhash64("text").alias("hash"))
    cuts, first = _bounds(rows)
    n_parts = max(shuffle_partitions(spark), len(cuts) + 1)
    marks = spark.sparkContext.broadcast((_order_bytes(*cuts.T), _slots(spark, n_parts)))
    last = len(cuts)

    @F.pandas_udf("array<struct<slot:int,part:int,ahead:boolean>>")
    def place(ident: pd.Series, hashes: pd.Series) -> pd.Series:
        bounds, slots = marks.value
        keys = _order_bytes(ident.to_numpy(), hashes.to_numpy())
        high, low = (np.searchsorted(bounds, keys, side=side).tolist() for side in ("right", "left"))
        begins = ((ident == first[0]) & (hashes == first[1])).tolist()
        goes = lambda p, ahead: (int(slots[p]), p, ahead)
        out = []
        for i, (a, b, f) in enumerate(zip(low, high, begins)):
            # a key that opens several ranges is that of equal rows, which share these out and follow each other
            own = b if a == b else a + 1 + i % (b - a)
            ahead = {a} if a != b else set()
            ahead |= ({own} if own < b else set()) | ({last} if f else set())
            out.append([goes(own, False), *(goes(p, True) for p in sorted(ahead))])
        return pd.Series(out)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=1)
        return pd.Series([pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts])

    dealt = rows.select("doc_id", "ident", "hash", packed("text").alias("packed"), F.explode(place("ident", "hash")).alias("c"))
    dealt = dealt.select("c.*", "ident", "hash", "doc_id", "packed").repartition(n_parts, "slot")
    dealt = dealt.sortWithinPartitions("part", "ahead", "ident", "hash").select("part", "ahead", "doc_id", "packed")
    out = "row_id long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(lambda b: _print_rows(b, per_batch), out)


#: Texts are near at this likeness or more. A band is BAND_BITS sampled bits; at this likeness one of them agrees with a chance
#: of 0.95, a whole band of 0.19, and one of BANDS of 0.99.
NEAR, BANDS, BAND_BITS = 0.9, 20, 32
#: Members of a bucket that are paired at once; larger buckets are searched from member to member.
FEW = 16
#: Pairs whose sketches of 128 sampled bits differ in more bits aren't verified. Texts at NEAR differ in 6.4 of them, and in more
#: than 16 with a chance of 0.0002, so the threshold falls with ``at_least`` by as many standard deviations.
SKETCH = 128


def sketch_bound(at_least: float) -> int:
    apart = (1 - at_least) / 2
    return int(np.ceil(SKETCH * apart + 3.8 * np.sqrt(SKETCH * apart * (1 - apart))))


#: Buckets of more members first meet CENTRES of them; what those leave apart is dealt out again by SUB_BANDS bands of SUB_BITS
#: further bits, and buckets of those that are still larger in pairs of blocks of BIG // 2.
BIG, CENTRES, SUB_BANDS, SUB_BITS = 2048, 5, 16, 16


def unhexed(prints: list[str]) -> np.ndarray:
    """The bytes of fingerprints, a row each, with end marks behind the shorter ones."""
    most = max(map(len, prints)) // 2
    marked = np.concatenate([sampled_steps(o) for o in range(most * 8 // BITS)])
    ends = np.packbits(_marks[marked % PERIOD, 0]).tobytes()
    return np.frombuffer(b"".join(bytes.fromhex(p) + ends[len(p) // 2 :] for p in prints), np.uint8).reshape(len(prints), most)


def unprinted(prints: list[str]) -> np.ndarray:
    """The bits of fingerprints, a row each, with end marks behind the shorter ones."""
    return np.unpackbits(unhexed(prints), axis=1)


def level_of(n_chars: float) -> int:
    """The number of doublings of the about 2 * n_chars steps of a text's walk."""
    return max(3, int(np.ceil(np.log2(max(2 * n_chars, 1)))))


@cache
def band_picks(level: int, bands: int, bits: int, seed: int) -> np.ndarray:
    """Columns of sampled bits, a row for each band, drawn evenly from the steps below 2**level."""
    octaves = max(1, level - FIRST + 1)
    steps = np.concatenate([sampled_steps(o) for o in range(octaves)])
    weight = np.repeat([(octave_range(o)[1] - octave_range(o)[0]) / BITS for o in range(octaves)], BITS) * (steps < 1 << level)
    return np.random.default_rng(seed + level).choice(len(steps), (bands, bits), p=weight / weight.sum())


def _band_values(prints: list[str], levels: list[int], bands: int, bits: int, seed: int) -> np.ndarray:
    """For each row and band the band's bits as a number."""
    out = np.zeros((len(prints), bands), np.int64)
    for level in set(levels):
        rows = [i for i, x in enumerate(levels) if x == level]
        picks = band_picks(level, bands, bits, seed)
        x = unprinted([prints[i] for i in rows] + ["00" * (BITS // 8 * max(1, level - FIRST + 1))])[:-1]  # as wide as the level
        values = np.packbits(x[:, picks], axis=2)
        out[rows] = np.concatenate((np.zeros((*values.shape[:2], 8 - bits // 8), np.uint8), values), axis=2).view(">i8")[..., 0]
    return out


def near_classes(prints: DataFrame, at_least: float = NEAR) -> DataFrame:
    """(row_id, class_id) of every row of prints(row_id, doc_id, n_chars, fingerprint) whose class_id isn't its doc_id.

    A class is what links of ``at_least`` or more connect, and class_id its smallest doc_id (null if it has none). Texts whose
    walks agree in a band of sampled bits meet in a bucket; a text close below a doubling of its steps bands at that doubling's
    level, too. All pairs of a small bucket whose sketches are near are verified on whole fingerprints; a larger one is searched from member to member,
    each held against those not yet reached. In one of more than BIG texts all first meet a few centres; those that the best
    centre leaves are banded by further bits with the rest of the bucket, and what is still large is held against all of it in
    pairs of blocks, so no task holds more than BIG fingerprints of a bucket. Empty texts are one class. No rows give none.
    """
    nodes = prints.groupBy("fingerprint", "n_chars").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    nodes = materialize(nodes, "nodes", codec="zstd")

    @F.pandas_udf("array<struct<level:int,s1:long,s2:long,keys:array<long>>>")
    def bands(prints: pd.Series, sizes: pd.Series) -> pd.Series:
        levels = [level_of(n) for n in sizes]
        above = [level_of(1.05 * n / at_least) for n in sizes]
        prints = prints.tolist()
        more = [i for i, (a, b) in enumerate(zip(levels, above)) if a != b]

        def at(p: list[str], l: list[int]) -> list[tuple]:
            keys = _band_values(p, l, BANDS, BAND_BITS, 99) + ((np.array(l)[:, None] * BANDS + np.arange(BANDS)) << BAND_BITS)
            return [(x, y, z, k) for x, (y, z), k in zip(l, _band_values(p, l, 2, SKETCH // 2, 55).tolist(), keys.tolist())]

        out = [[x] for x in at(prints, levels)] if prints else []
        if more:
            for i, x in zip(more, at([prints[i] for i in more], [above[i] for i in more])):
                out[i].append(x)
        return pd.Series(out)

    banded = nodes.where("n_chars > 0").select("node", F.explode(bands("fingerprint", "n_chars")).alias("b")).select("node", "b.*")
    banded = materialize(banded, "bands", codec="zstd")
    rows = banded.select("node", F.explode("keys").alias("key"))
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    members = materialize(rows.join(shared, "key"), "members", codec="zstd")
    pairs = members.where(F.col("m") <= FEW).withColumn("level", F.expr(f"int(shiftright(key, {BAND_BITS}) div {BANDS})"))
    pairs = pairs.join(banded.select("node", "level", "s1", "s2"), ["node", "level"]).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("node", "s1", "s2"))).alias("s"))
    close = f"bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2) <= {sketch_bound(at_least)}"
    pairs = pairs.select(F.explode(F.expr(f"flatten(transform(s, (x, i) -> transform(filter(slice(s, i + 2, size(s)), y -> {close}), y -> struct(x.node as a, y.node as b))))")).alias("p"))
    pairs = materialize(pairs.select("p.a", "p.b").distinct(), "pairs")

    ends = [nodes.select(F.col("node").alias(x), F.col("fingerprint").alias(f), F.col("n_chars").alias(n)) for x, f, n in (("a", "f", "n"), ("b", "g", "m"))]
    links = pairs.join(ends[0], "a").join(ends[1], "b").where(_alike()("f", "g", "n", "m") >= at_least).select("a", "b")
    some = members.where(F.col("m").between(FEW + 1, BIG)).select("key", "node")
    links = links.unionByName(_forests(some, nodes, ["key"], at_least))
    if not shared.where(F.col("m") > BIG).isEmpty():
        links = links.unionByName(_large(members.where(F.col("m") > BIG), nodes, at_least))
    roots = components(links)
    rooted = materialize(nodes.join(roots, "node"), "rooted")
    lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("class_id")), "lows")
    classes = rooted.join(small(lows), "root").select("fingerprint", "n_chars", "class_id")
    alone = nodes.where("rows > 1").join(roots, "node", "left_anti").select("fingerprint", "n_chars", F.col("low").alias("class_id"))
    classes = materialize(classes.unionByName(alone), "classes")
    found = prints.select("row_id", "doc_id", "fingerprint", "n_chars").join(small(classes), ["fingerprint", "n_chars"])
    return found.where(~F.col("class_id").eqNullSafe(F.col("doc_id"))).select("row_id", "class_id")


def _alike():
    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        words = unhexed(a.tolist() + b.tolist()).view(np.uint64)
        return pd.Series(packed_likeness(words[: len(a)], words[len(a) :], n_a.to_numpy(), n_b.to_numpy()))

    return alike


def _forests(members: DataFrame, nodes: DataFrame, group: list[str], at_least: float, joined: str = "false") -> DataFrame:
    """Links (a, b) that connect what links of at_least or more connect in each group of members(*group, node).

    Members for which ``joined`` holds are known to be connected. A group should have at most BIG rows.
    """
    rows = members.select(*group, "node", F.expr(joined).alias("joined")).join(nodes.select("node", "fingerprint", "n_chars"), "node")
    dealt = rows.repartition(shuffle_partitions(nodes.sparkSession), *group).sortWithinPartitions(*group, "node")

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            at = pdf[group].to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()]
            held = pdf.iloc[cuts[-1] :]
            for a, b in zip(cuts, cuts[1:]):
                yield reached(pdf.iloc[a:b], at_least)
        if held is not None:
            yield reached(held, at_least)

    return dealt.mapInPandas(run, "a long, b long")


def _large(members: DataFrame, nodes: DataFrame, at_least: float) -> DataFrame:
    """As ``_forests`` for buckets of members(key, m, node) with any number of rows, but for links whose ends share none of SUB_BANDS bands.

    The members near one centre are connected by it, so only the others have to be held against all of their bucket.
    """
    large = materialize(members.join(nodes.select("node", "fingerprint", "n_chars"), "node"), "large", codec="zstd")
    picks = large.groupBy("key").agg(*[F.min_by(F.struct("node", "fingerprint", "n_chars"), F.xxhash64("node", F.lit(i))).alias(f"c{i}") for i in range(CENTRES)])
    picks = picks.select("key", F.explode(F.array_distinct(F.array(*[f"c{i}" for i in range(CENTRES)]))).alias("c"))
    picks = materialize(picks.select("key", F.col("c.node").alias("centre"), F.col("c.fingerprint").alias("g"), F.col("c.n_chars").alias("n")), "centres")
    star = large.join(small(picks), "key").where(_alike()("fingerprint", "g", "n_chars", "n") >= at_least)
    star = materialize(star.select("key", "m", "node", "centre"), "star")
    best = star.groupBy("key", "m", "centre").agg(F.count("*").alias("n")).groupBy("key", "m")
    best = materialize(best.agg(F.max_by("centre", F.struct("n", "centre")).alias("centre"), F.max("n").alias("n")), "best")
    near = star.join(small(best.select("key", "centre")), ["key", "centre"]).select("key", "node", F.lit(True).alias("near"))
    left = large.join(small(best.where("n < m").select("key")), "key").join(near, ["key", "node"], "left")

    @F.pandas_udf("array<long>")
    def finer(keys: pd.Series, prints: pd.Series) -> pd.Series:
        levels = ((keys.to_numpy() >> BAND_BITS) // BANDS).tolist()
        values = _band_values(prints.tolist(), levels, SUB_BANDS, SUB_BITS, 7) + (np.arange(SUB_BANDS) << SUB_BITS) if len(keys) else np.zeros((0, SUB_BANDS), np.int64)
        return pd.Series(values.tolist())

    dealt = left.select("key", "node", F.coalesce("near", F.lit(False)).alias("near"), F.explode(finer("key", "fingerprint")).alias("sub"))
    dealt = materialize(dealt, "finer", codec="zstd")
    sizes = dealt.groupBy("key", "sub").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("r")).where("r > 0 and n > 1")
    dealt = dealt.join(materialize(sizes, "sizes"), ["key", "sub"])
    whole = dealt.where(F.col("n") <= BIG)
    # each block of those left meets each block of all
    half, place = max(1, BIG // 2), lambda blocks: F.pmod(F.xxhash64("node", F.lit(5)), blocks)
    rows, ranks = F.ceil(F.col("r") / half), F.ceil(F.col("n") / half)
    both = dealt.where(F.col("n") > BIG).select("key", "sub", "node", "near", rows.alias("rows"), ranks.alias("ranks"))
    one = both.where("not near").select("key", "sub", "node", "near", place(F.col("rows")).alias("i"), F.explode(F.expr("sequence(0, ranks - 1)")).alias("j"))
    other = both.select("key", "sub", "node", "near", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), place(F.col("ranks")).alias("j"))
    blocks = one.unionByName(other.select(*one.columns))
    links = star.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    links = links.unionByName(_forests(whole, nodes, ["key", "sub"], at_least, "near"))
    return links.unionByName(_forests(blocks, nodes, ["key", "sub", "i", "j"], at_least, "near"))


def reached(pdf: pd.DataFrame, at_least: float) -> pd.DataFrame:
    """A forest of one group's links: each member reached is held against all those not reached yet. Repeated members count once."""
    pdf = pdf.drop_duplicates("node")
    words, sizes, nodes = unhexed(pdf["fingerprint"].tolist()).view(np.uint64), pdf["n_chars"].to_numpy(), pdf["node"].to_numpy()
    joined = pdf["joined"].to_numpy(bool)
    left, out, queue = np.flatnonzero(~joined), [np.zeros((0, 2), np.int64)], np.flatnonzero(joined).tolist()
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        x = queue.pop()
        near = packed_likeness(words[x], words[left], np.full(len(left), sizes[x]), sizes[left]) >= at_least
        hit = left[near]
        out.append(np.stack((np.full(len(hit), nodes[x]), nodes[hit]), axis=1))
        queue += hit.tolist()
        left = left[~near]
    found = np.concatenate(out)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def edit_classes(docs: DataFrame, at_least: float = NEAR) -> DataFrame:
    """All columns of ``edit_fingerprints`` but row_id, and class_id, the smallest doc_id of the row's near class."""
    prints = materialize(edit_fingerprints(docs), "prints", codec="zstd")
    moved = materialize(near_classes(prints, at_least), "moved").withColumn("moved", F.lit(True))
    out = prints.join(small(moved), "row_id", "left").withColumn("class_id", F.when(F.col("moved"), F.col("class_id")).otherwise(F.col("doc_id")))
    return out.drop("row_id", "moved")


def op8_editprint(spark, sf_dir: str) -> DataFrame:
    return edit_classes(table(spark, sf_dir, "documents"))
