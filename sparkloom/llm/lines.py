"""Line dedup by pairwise alignment: delete what a later document repeats, in order, from an earlier one.

A line's words are hashed; long lines are wrapped at places that their own words choose, so a passage inside a line aligns
as well as whole lines do. Documents that share a line are paired: a line's every later holder with its first holder and,
unless the line is very frequent, with the holder before it, so the few holders of a rare line are all linked. Each pair
is aligned by patience diff: the longest chain of lines that are unique in both, in rising order, grown over the equal lines
beside them; the blocks of all pairs go. Where that leaves MIN_WORDS words or more in lines that all have been seen before, every
least run of lines with so many words is looked up by one hash among all documents' runs, so a block goes whichever earlier
document has it, also if its lines were first seen in others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from operator import lt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import bound_batches, materialize, small, table
from .words import _STEP, mix, words_in

REACH = 4  # words to either side that a word must be below, in hash order, for its line to be wrapped before it
WRAP = 12  # words that a wrapped line has at most
#: Wrapped lines beside a block whose words are held against the earlier document's. In both documents a passage is wrapped alike
#: but for 4 words at its end, and before the first place that its own words choose, so more lines than these aren't cut apart.
BESIDE = 4
#: Words in whole lines that an aligned block must have.
MIN_WORDS = 24
#: Lines that a sample of one in SAMPLE rows shows more often than this are dealt with by a grouped minimum and a join.
SAMPLE, HOT = 16, 64
BATCH = 1 << 17  # bytes of short texts that are taken together
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Asked runs are broadcast up to so many and joined by shuffle beyond.
BROADCAST_RUNS = 1 << 20
_POWERS = np.array([pow(_STEP, i, 1 << 64) for i in range(WRAP)], np.uint64)


def _wrapped(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: the byte at which each (wrapped) line's first word starts, its hash and its words."""
    starts, _, h = words_in(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), starts)
    opens = np.ones(len(h), bool)
    for o in range(1, REACH + 1):
        same = line[o:] == line[:-o]
        opens[o:] &= ~same | (h[o:] < h[:-o])
        opens[:-o] &= ~same | (h[:-o] <= h[o:])
    opens[0] = True
    opens[1:] |= line[1:] != line[:-1]
    # runs without such a word, of one word repeated say, are wrapped by count
    opens |= (np.arange(len(h)) - np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))) % WRAP == 0
    first = np.flatnonzero(opens)
    sizes = np.diff(np.append(first, len(h)))
    at = np.arange(len(h)) - np.repeat(first, sizes)
    return starts[first], mix(np.add.reduceat(h * _POWERS[at], first)), sizes


def lines_of_many(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the wrapped lines of all texts in order: the text's number, start byte, hash and words.

    Short texts are taken together up to BATCH bytes, longer ones whole.
    """
    found, batch, size = [], [], 0

    def flush():
        nonlocal batch, size
        if batch:
            offsets = np.cumsum([0, *(len(d) + 1 for _, d in batch[:-1])])
            starts, h, w = _wrapped(b"\n".join([d for _, d in batch]))
            which = np.searchsorted(offsets, starts, side="right") - 1
            found.append((np.array([i for i, _ in batch], np.int64)[which], starts - offsets[which], h, w))
        batch, size = [], 0

    for i, t in enumerate(texts):
        d = t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")
        if size + len(d) > BATCH:
            flush()
        batch.append((i, d))
        size += len(d)
    flush()
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else none


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Start bytes, hashes and word counts of a text's wrapped lines, and its bytes."""
    _, starts, hashes, words = lines_of_many([text])
    return starts, hashes, words, (text or "").encode("utf-8", "surrogatepass")


def starts_of(texts: list[str | bytes | None]) -> list[np.ndarray]:
    """The start bytes of each text's wrapped lines."""
    number, starts, _, _ = lines_of_many(texts)
    return np.split(starts, np.searchsorted(number, np.arange(1, len(texts))))


def beside(text: str | bytes | None, line: int, after: bool, starts: np.ndarray | None = None) -> str:
    """The words of the BESIDE wrapped lines before a wrapped line, or of those behind it, joined by single spaces."""
    starts = starts_of([text])[0] if starts is None else starts
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    low, high = (line + 1, min(line + 1 + BESIDE, len(starts))) if after else (max(line - BESIDE, 0), line)
    low, high = (int(starts[x]) if x < len(starts) else len(data) for x in (low, high))
    return b" ".join(data[low:high].split()).decode("utf-8", "surrogatepass")


def without(text: str | None, runs: list[tuple[int, int, str, str]], starts: np.ndarray | None = None) -> str:
    """The text without runs of lines (from, up to, what the earlier document has before the run, and behind it).

    A run that begins or ends amid a physical line is grown over the words of the BESIDE wrapped lines beside it, within that
    physical line, that the earlier document has there too. White space behind what goes goes with it, but for the end of a line that is cut short.
    """
    starts = starts_of([text])[0] if starts is None else starts
    data = (text or "").encode("utf-8", "surrogatepass")
    edges = np.append(starts, len(data))
    edges[0] = 0  # what stands before the first line goes with it
    kept, at = [], 0
    for a, b, before, behind in sorted(runs):
        low, high = int(edges[a]), int(edges[b])
        left = data[int(edges[max(a - BESIDE, 0)]) : low].rpartition(b"\n")[2]
        words, known = left.split(), before.encode("utf-8", "surrogatepass").split()
        k = 0
        while k < min(len(words), len(known)) and words[-1 - k] == known[-1 - k]:
            k += 1
        if k:
            low -= len(left) - [m.start() for m in _WORD.finditer(left)][-k]
        if high < len(data) and b"\n" not in data[len(data[low:high].rstrip()) + low : high]:
            right = data[high : int(edges[min(b + BESIDE, len(starts))])].partition(b"\n")[0]
            known = behind.encode("utf-8", "surrogatepass").split()
            spans = [m.span() for m in _WORD.finditer(right)]
            k = 0
            while k < min(len(spans), len(known)) and right[slice(*spans[k])] == known[k]:
                k += 1
            if k:
                high += spans[k][0] if k < len(spans) else len(right)
        if low > at:
            kept.append(data[at:low])
        at = max(at, high)
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by patience sorting."""
    if all(map(lt, values, values[1:])):
        return list(range(len(values)))
    tops: list[int] = []
    piles: list[int] = []
    below = [0] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
        below[i] = piles[k - 1] if k else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def common_blocks(at: np.ndarray, owner: np.ndarray, place: np.ndarray, once: np.ndarray, words: np.ndarray, min_words: int, live: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """Runs of a document's lines to delete; the rows are its repeated lines in order of ``at``.

    A run is (from, up to, the earlier document and line of its first line, and those of its last line).

    at: the line's number; owner and place: the earlier document that has it first, and where; once: whether the line is
    unique in both. Lines between two aligned ones on one diagonal belong to the block if each repeats some earlier line.
    A block that the document has more than once goes each time. ``live``: the rows, by number, whose owner may have a block, all by default.
    """
    covered = dict(zip(at.tolist(), words.tolist()))
    doomed: dict[int, tuple[int, int]] = {}

    def doom(owner: int, here: dict[int, int], low: int, high: int) -> None:
        if sum(covered[x] for x in range(low, high + 1)) >= min_words:
            for x in range(low, high + 1):
                doomed.setdefault(x, (owner, here[low] + x - low))

    by_owner: dict[int, list[int]] = {}
    live = np.arange(len(at)) if live is None else live
    for k, o in zip(live.tolist(), owner[live].tolist()):
        by_owner.setdefault(o, []).append(k)
    for o, rows in by_owner.items():
        here = {int(at[k]): int(place[k]) for k in rows}
        anchors = [k for k in rows if once[k]] or rows
        chain = [int(at[anchors[j]]) for j in rising([int(place[k]) for k in anchors])]
        k = 0
        while k < len(chain):
            low = high = chain[k]
            diagonal = here[low] - low
            k += 1
            while True:
                if k < len(chain) and here[chain[k]] - chain[k] == diagonal and all(x in covered for x in range(high + 1, chain[k])):
                    high = chain[k]
                    k += 1
                elif here.get(high + 1, -1) - high - 1 == diagonal and high + 1 in here:
                    high += 1
                    while k < len(chain) and chain[k] <= high:
                        k += 1
                else:
                    break
            while low - 1 in here and here[low - 1] - low + 1 == diagonal:
                low -= 1
            doom(o, here, low, high)
        # what repeats a block once more, or out of order, goes as well: runs of left lines on one diagonal
        run: list[int] = []
        for x in [*(y for y in here if y not in doomed), None]:
            if run and (x is None or here[x] - x != here[run[-1]] - run[-1] or any(y not in covered or y in doomed for y in range(run[-1] + 1, x))):
                doom(o, here, run[0], run[-1])
                run = []
            if x is not None:
                run.append(x)
    return _merged(doomed)


def least_runs(hashes: np.ndarray, words: np.ndarray, opens: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From, up to and hash of every least run of ``min_words`` words or more, of those that start at a line and that end at one.

    ``opens`` holds the first line of each part; no run crosses from one to the next. Whatever block of at least so many
    words two texts share, its lines are all in least runs within it, and these have equal hashes in both texts.
    """
    n = len(hashes)
    sums = np.concatenate(([0], np.cumsum(words)))
    edges = np.append(opens, n)
    part = np.searchsorted(opens, np.arange(n), side="right") - 1
    low = np.arange(n)
    high = np.searchsorted(sums, sums[:-1] + min_words)
    fits = high <= edges[part + 1]
    stop = np.arange(1, n + 1)
    start = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
    ends = start >= edges[part]
    low, high = np.concatenate((low[fits], start[ends])), np.concatenate((high[fits], stop[ends]))
    both = np.sort(low * (n + 1) + high)
    low, high = np.divmod(both[_changes(both)], n + 1)
    power, inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_STEP, pow(_STEP, -1, 1 << 64)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * power[:n], dtype=np.uint64)))
    return low, high, mix((total[high] - total[low]) * inverse[low]).view(np.int64)


def live_rows(doc: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Whether ``common_blocks`` may find a block with the row's owner; the rows are many documents' in order of doc and at.

    A block begins and ends in lines of one owner on one diagonal, with repeated lines alone between them. Owners without two
    such lines (or one) that far apart have none, so most rows need no alignment.
    """
    if not len(at):
        return np.zeros(0, bool)
    opens = _changes(doc, at)
    line = np.cumsum(opens) - 1
    sums = np.concatenate(([0], np.cumsum(words[opens])))
    stretch = np.cumsum(_changes(doc[opens]) | (np.diff(at[opens], prepend=-2) != 1))[line]
    pair = np.lexsort((owner, doc))
    number = np.empty(len(at), np.int64)
    number[pair] = np.cumsum(_changes(doc[pair], owner[pair])) - 1
    rows = np.flatnonzero(np.bincount(stretch[opens], words[opens])[stretch] >= min_words)
    if not len(rows):
        return np.zeros(len(at), bool)
    rows = rows[np.lexsort((rows, place[rows] - at[rows], stretch[rows], number[rows]))]
    first = np.flatnonzero(_changes(number[rows], stretch[rows], place[rows] - at[rows]))
    last = np.append(first[1:], len(rows)) - 1
    long = sums[line[rows[last]] + 1] - sums[line[rows[first]]] >= min_words
    some = np.zeros(number.max() + 1, bool)
    some[number[rows[first[long]]]] = True
    return some[number]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def asked_runs(doc: np.ndarray, at: np.ndarray, hashes: np.ndarray, words: np.ndarray, gone: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last row and hash of the least runs of repeated lines that hold a line of a stretch of ``min_words`` words or
    more, all repeated and none gone. The rows are many documents' repeated lines, one for each, in order of doc and at."""
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    opens = _changes(doc) | (np.diff(at, prepend=-2) != 1)
    stretch = np.cumsum(opens | _changes(gone)) - 1
    left = ~gone & (np.bincount(stretch, words)[stretch] >= min_words)
    part = np.cumsum(opens) - 1
    rows = np.flatnonzero(np.bincount(part, left)[part] > 0)  # no run leaves its part
    if not len(rows):
        return none, none, none
    low, high, h = least_runs(hashes[rows].view(np.uint64), words[rows], np.flatnonzero(opens[rows]), min_words)
    sums = np.concatenate(([0], np.cumsum(left[rows])))
    some = sums[high] > sums[low]
    return rows[low[some]], rows[high[some] - 1], h[some]


def aligned_many(doc: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray, once: np.ndarray, words: np.ndarray, hashes: np.ndarray, n: int, min_words: int):
    """Of n documents, whose rows are in order of doc and at: each one's runs, its number of asked runs, and of all asked runs the first and last row.

    Last comes the hash of each asked run. The rows of a run that are the first of their line make up its lines.
    """
    cuts = np.searchsorted(doc, np.arange(n + 1))
    live = live_rows(doc, at, owner, place, words, min_words)
    runs: list[list[tuple[int, ...]]] = [[] for _ in range(n)]
    own = np.flatnonzero(_changes(doc, at))  # a line has a row for each owner
    lines, gone = at[own], np.zeros(len(own), bool)
    own_cuts = np.searchsorted(own, cuts)
    for k in np.unique(doc[live]).tolist():
        rows = slice(cuts[k], cuts[k + 1])
        runs[k] = common_blocks(at[rows], owner[rows], place[rows], once[rows], words[rows], min_words, np.flatnonzero(live[rows]))
        for a, b, *_ in runs[k]:
            low = own_cuts[k] + np.searchsorted(lines[own_cuts[k] : own_cuts[k + 1]], a)
            gone[low : low + b - a] = True  # a block's lines are all repeated
    low, high, h = asked_runs(doc[own], lines, hashes[own], words[own], gone, min_words)
    return runs, np.bincount(doc[own][low], minlength=n), own, low, high, h


def runs_in_many(hashes: np.ndarray, words: np.ndarray, sizes: np.ndarray, min_words: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many least runs each document (of so many lines) has, the first line of each within its document, and their hashes.

    With ``known``, sorted hashes, only the runs in it.
    """
    starts = np.cumsum(sizes) - sizes
    low, _, w = least_runs(hashes.view(np.uint64), words, starts, min_words)
    if known is not None:
        # most runs are in no bin of a known hash, and need no search
        mask = (1 << max(10, len(known).bit_length() + 4)) - 1
        bins = np.zeros(mask + 1, bool)
        bins[known & mask] = True
        maybe = np.flatnonzero(bins[w & mask])
        hit = maybe[known[np.minimum(np.searchsorted(known, w[maybe]), len(known) - 1)] == w[maybe]]
        low, w = low[hit], w[hit]
    doc = np.searchsorted(starts, low, side="right") - 1
    return np.bincount(doc, minlength=len(sizes)), low - starts[doc], w


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def joined_runs(runs: list[tuple[int, ...]], found: list[tuple], min_words: int) -> list[tuple[int, ...]]:
    """``runs`` and the found ones (from, up to, earlier document, its line, words of each line), joined where they touch.

    A stretch of found lines that aren't in ``runs`` goes if it has ``min_words`` words, whichever documents have its parts.
    """
    doomed: dict[int, tuple[int, int]] = {}
    for a, b, first, first_line, last, last_line in runs:
        for x in range(a, b):
            doomed[x] = (first, first_line + x - a)
        doomed[b - 1] = (last, last_line)
        doomed[a] = (first, first_line)
    more: dict[int, tuple[int, int]] = {}
    sizes: dict[int, int] = {}
    for a, b, owner, line, words in sorted(found):
        for x in range(a, b):
            if x not in doomed:
                more.setdefault(x, (owner, line + x - a))
                sizes[x] = words[x - a]
    for a, b, *_ in _merged(more):
        if sum(sizes[x] for x in range(a, b)) >= min_words:
            doomed.update((x, more[x]) for x in range(a, b))
    return _merged(doomed)


def _merged(doomed: dict[int, tuple[int, int]]) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = []
    for x in sorted(doomed):
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1, *out[-1][2:4], *doomed[x])
        else:
            out.append((x, x + 1, *doomed[x], *doomed[x]))
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """(key, ord, hashes, facts) of every row with words; facts are words * 2, and 1 more if the line is unique in its document."""

    @F.arrow_udf("hashes array<long>, facts array<int>")
    def found(texts: pa.Array) -> pa.Array:
        number, _, h, w = lines_of_many(texts.cast(pa.binary()).to_pylist())
        order = np.argsort(h, kind="stable")  # of equal lines, those of one text stay together
        same = (h[order][1:] == h[order][:-1]) & (number[order][1:] == number[order][:-1])
        once = np.ones(len(h), bool)
        once[order[1:]] &= ~same
        once[order[:-1]] &= ~same
        sizes = np.bincount(number, minlength=len(texts))
        lists = _listed(sizes, pa.array(h.view(np.int64))), _listed(sizes, pa.array((w * 2 + once).astype(np.int32)))
        return pa.StructArray.from_arrays(lists, ["hashes", "facts"])

    rows = _keyed(docs).withColumn("l", found("text"))
    return rows.select("key", "ord", "l.hashes", "l.facts").where(F.size("hashes") > 0)


def _keyed(docs: DataFrame) -> DataFrame:
    """key tells rows of one doc_id with different texts apart; ord puts null ids last."""
    text = F.col("text").cast("string")
    ident = F.col("doc_id").cast("long")
    return docs.select("*", F.xxhash64(ident, text).alias("key"), F.coalesce(ident, F.lit((1 << 63) - 1)).alias("ord")).withColumn("text", text)


def repeats(lines: DataFrame) -> DataFrame:
    """(key, ord, at, owner, place, once, words, h) of every line that an earlier document has, with the first that has it and the one before."""
    rows = lines.select("key", "ord", "facts", F.posexplode("hashes").alias("at", "h"))
    rows = rows.select("h", "ord", "key", "at", F.get("facts", "at").alias("f"))
    # Which lines are hot only decides the path: they are paired with their first holder alone.
    sample = rows.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(SAMPLE)) == 0)
    hot = materialize(sample.groupBy("h").count().where(F.col("count") > HOT).select("h"), "hot-lines")
    first = F.struct("ord", "key", "at", "f")

    def told(df: DataFrame) -> DataFrame:
        df = df.where("o.key <> key and o.ord <> ord")
        once = (F.col("f").bitwiseAND(1) == 1) & (F.col("o.f").bitwiseAND(1) == 1)
        return df.select("key", "ord", "at", "late", F.col("o.key").alias("owner"), F.col("o.at").alias("place"), once.alias("once"), F.shiftright("f", 1).alias("words"), "h")

    def rest(df: DataFrame) -> DataFrame:
        # column by column: a struct would be made below the shuffle and sorted with each line
        w = Window.partitionBy("h").orderBy("ord", "key", "at")
        upto, names = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), ("ord", "key", "at", "f")
        df = df.select("*", *[F.first(c).over(upto).alias(f"o_{c}") for c in names], *[F.lag(c).over(w).alias(f"p_{c}") for c in names])
        o, p = (F.struct(*[F.col(f"{x}_{c}").alias(c) for c in names]) for x in "op")
        both = F.when((F.col("p_key") != F.col("o_key")) & (F.col("p_key") != F.col("key")), F.array(o, p)).otherwise(F.array(o))
        return told(df.where("o_key <> key").select("key", "ord", "at", "f", "h", F.posexplode(both).alias("late", "o")))

    if hot.isEmpty():
        return rest(rows)
    marked = small(hot)
    heads = materialize(rows.join(marked, "h", "left_semi").groupBy("h").agg(F.min(first).alias("o")), "heads")  # a row for each hot line
    return rest(rows.join(marked, "h", "left_anti")).unionByName(told(rows.join(small(heads), "h").withColumn("late", F.lit(0))))


def deletions(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, ord, runs) of every document that loses lines."""

    @F.arrow_udf(f"runs {RUNS}, asks array<struct<a:int,b:int,w:long,words:array<int>>>")
    def blocks(at: pa.Array, owner: pa.Array, place: pa.Array, once: pa.Array, words: pa.Array, h: pa.Array) -> pa.Array:
        n = len(at)
        doc = np.repeat(np.arange(n), at.value_lengths().to_numpy())
        at, owner, place, once, words, h = map(_flat, (at, owner, place, once, words, h))
        runs, sizes, own, low, high, w = aligned_many(doc, at, owner, place, once, words, h, n, min_words)
        flat = np.array([r for one in runs for r in one], np.int64).reshape(-1, 6)
        lasts = pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()
        runs = _listed(np.array([len(r) for r in runs], np.int64), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat.T, lasts)], RUN))
        long = high - low + 1
        inside = np.repeat(low - np.cumsum(long) + long, long) + np.arange(long.sum())
        of_lines = _listed(long, pa.array(words[own[inside]], pa.int32()))
        asks = [pa.array(at[own[low]], pa.int32()), pa.array(at[own[high]] + 1, pa.int32()), pa.array(w, pa.int64()), of_lines]
        asks = _listed(sizes, pa.StructArray.from_arrays(asks, ["a", "b", "w", "words"]))
        return pa.StructArray.from_arrays([runs, asks], ["runs", "asks"])

    @F.pandas_udf(RUNS)
    def joined(runs: pd.Series, found: pd.Series) -> pd.Series:
        plain = lambda rows, names: [] if rows is None else [tuple(list(r[c]) if c == "words" else r[c] for c in names) for r in rows]
        return pd.Series([joined_runs(plain(r, RUN), plain(f, ("a", "b", "owner", "line", "words")), min_words) for r, f in zip(runs, found)])

    names = ["at", "owner", "place", "once", "words", "h"]
    rows = repeats(lines).groupBy("key", "ord").agg(F.sort_array(F.collect_set(F.struct("at", "late", *names[1:]))).alias("r"), F.sum("words").alias("n"))
    rows = rows.where(F.col("n") >= min_words).select("key", "ord", blocks(*[F.col(f"r.{c}") for c in names]).alias("x"))
    rows = materialize(rows.select("key", "ord", "x.*").where("size(runs) > 0 or size(asks) > 0"), "aligned")
    asks = rows.select("key", "ord", F.explode("asks").alias("x")).select("key", "ord", "x.*")
    found = answered(asks, lines, min_words)
    if found is None:
        return rows.select("key", "ord", "runs").where(F.size("runs") > 0)
    found = found.groupBy("key").agg(F.collect_list(F.struct("a", "b", "owner", "line", "words")).alias("found"))
    rows = rows.join(found, "key", "left").select("key", "ord", F.when(F.col("found").isNull(), F.col("runs")).otherwise(joined("runs", "found")).alias("runs"))
    return rows.where(F.size("runs") > 0)


def answered(asks: DataFrame, lines: DataFrame, min_words: int) -> DataFrame | None:
    """(key, a, b, owner, line, words) of the asked runs (key, ord, a, b, w, words) that an earlier document has, with the first that has it.

    Only documents' runs of an asked hash are kept: those in the broadcast hashes, or beyond BROADCAST_RUNS of these by a
    join. None if nothing is asked.
    """
    wanted = materialize(asks.select("w").distinct(), "wanted-runs")
    n = wanted.count()
    if not n:
        return None
    few = n <= BROADCAST_RUNS
    known = lines.sparkSession.sparkContext.broadcast(np.sort(np.array([r["w"] for r in wanted.collect()], np.int64)) if few else None)

    @F.arrow_udf("array<struct<w:long,line:int>>")
    def runs_of(hashes: pa.Array, facts: pa.Array) -> pa.Array:
        sizes, line, w = runs_in_many(_flat(hashes), _flat(facts) >> 1, hashes.value_lengths().to_numpy(), min_words, known.value)
        return _listed(sizes, pa.StructArray.from_arrays([pa.array(w, pa.int64()), pa.array(line, pa.int32())], ["w", "line"]))

    have = lines.select("key", "ord", F.explode(runs_of("hashes", "facts")).alias("x")).select("ord", "key", F.col("x.line").alias("line"), F.col("x.w").alias("w"))
    if not few:
        have = have.join(wanted, "w", "left_semi")
    first = materialize(have.groupBy("w").agg(F.min(F.struct("ord", "key", "line")).alias("o")), "first-runs")
    rows = asks.join(small(first), "w").where("o.ord < ord")
    return rows.select("key", "a", "b", F.col("o.key").alias("owner"), F.col("o.line").alias("line"), "words")


RUN = ["a", "b", "first", "first_line", "last", "last_line"]
RUNS = "array<struct<a:int,b:int,first:long,first_line:int,last:long,last_line:int>>"


def with_edges(gone: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, ord, runs) of gone with what the earlier documents have beside each run; docs are keyed rows with text.

    Only distinct places are looked up, so a passage that very many documents repeat costs one.
    """
    runs = gone.select("key", "ord", F.explode("runs").alias("r")).select("key", "ord", "r.*")
    asks = runs.select(F.col("first").alias("owner"), F.col("first_line").alias("line"), F.lit(False).alias("after"))
    asks = asks.unionByName(runs.select(F.col("last").alias("owner"), F.col("last_line").alias("line"), F.lit(True).alias("after"))).distinct()
    asks = materialize(asks.groupBy("owner").agg(F.collect_list(F.struct("line", "after")).alias("asks")), "asks")

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series, asks: pd.Series) -> pd.Series:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]  # once, however many places are asked for
        return pd.Series([[beside(t, x["line"], x["after"], s) for x in a] for t, a, s in zip(data, asks, starts_of(data))])

    found = docs.select("key", "text").join(small(asks), docs["key"] == asks["owner"]).dropDuplicates(["owner"])
    found = found.select("owner", F.explode(F.arrays_zip("asks", words("text", "asks").alias("words"))).alias("x"))
    found = materialize(found.select("owner", "x.asks.line", "x.asks.after", "x.words"), "edges")
    sides = [found.where(F.col("after") == after).select(F.col("owner").alias(o), F.col("line").alias(n), F.col("words").alias(w)) for after, o, n, w in ((False, "first", "first_line", "before"), (True, "last", "last_line", "behind"))]
    runs = runs.join(small(sides[0]), ["first", "first_line"]).join(small(sides[1]), ["last", "last_line"])
    return runs.groupBy("key", "ord").agg(F.array_sort(F.collect_list(F.struct("a", "b", "before", "behind"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) with each text freed of the blocks it repeats from earlier documents; all rows and columns stay.

    Earlier means a smaller doc_id; null ids come last and don't delete from each other. A block has at least ``min_words``
    words. Null, empty and wordless texts stay as they are; a text all of whose lines go becomes empty. Rows that
    repeat one doc_id don't delete from each other, so repeated rows stay equal. Columns of docs keep their names
    (n_removed, if added by the caller, too). An empty table gives an empty result.
    """
    names = docs.columns
    bound_batches(docs.sparkSession)
    plain = docs.select("doc_id", "text")
    gone = materialize(deletions(materialize(line_table(plain), "lines"), min_words), "deletions")
    gone = materialize(with_edges(gone, _keyed(plain)).withColumnsRenamed({"key": "_key", "ord": "_ord"}), "runs")
    gone = small(gone)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        starts = starts_of(texts.tolist())
        return pd.Series([without(t, [(x["a"], x["b"], x["before"], x["behind"]) for x in r], s) for t, r, s in zip(texts, runs, starts)], dtype=object)

    # both names: the key is a hash, so the id is compared as well
    ident = [F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_ord")]
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *ident)
    # only documents that lose lines go through Python
    whole = wide.join(gone, ["_key", "_ord"], "left_anti").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
    some = wide.join(gone, ["_key", "_ord"]).withColumn("_text", cut(F.col("_row.text").cast("string"), F.col("runs")))
    return whole.unionByName(some.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names]))


def op3_lines(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("before"))
    out = dedup_lines(docs)
    return out.select("doc_id", "text", (F.coalesce("before", F.lit(0)) - F.coalesce(F.length("text"), F.lit(0))).alias("n_removed"))
