"""Periodic runs of words: every stretch that repeats a period at least three times.

Suffix array and LCP of a text's words give its longest previous factors and so its LZ blocks. A run either touches a
boundary of blocks, where extensions to both sides find it (Main), or lies within a block and is the copy of a run within
the block's earlier occurrence, from which it is taken in order of starts. All texts of a batch are handled at once in numpy;
the suffix classes of doubled windows answer extension queries to the left as well as to the right.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, give_back, table

#: A run has at least so many words and repeats its period so often.
LEAST, TIMES = 24, 3
#: Within a run of period q some LEAST - LEAST // TIMES words or more occur again q words later, so a text in which no so many words repeat has none.
REPEATED = LEAST - LEAST // TIMES
#: Words of the texts taken at once (one text may have more), and extension queries answered at once.
WORDS, QUERIES = 1 << 18, 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def classes_of(doc: np.ndarray, word: np.ndarray, most: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The classes of windows of 1, 2, 4, ... words, as long as any are alike, the suffix array, and the slots still alike.

    A class is the place of its first member in the order of windows, so windows of that length are alike exactly if their
    classes are equal; windows never reach over the end of a document. ``most`` ends the doubling at that length.
    """
    n = len(doc)
    order = np.lexsort((word, doc))
    new = np.ones(n, bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (word[order][1:] != word[order][:-1])
    rank, size = np.empty(n + 1, np.int64), 1
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [rank]
    alike = lambda first: np.flatnonzero(~first | np.append(~first[1:], False))
    slots = alike(new)
    while len(slots) and (most is None or size < most):
        some = order[slots]
        group, after = rank[some], rank[np.minimum(some + size, n)]
        by = np.lexsort((after, group))
        some, group, after = some[by], group[by], after[by]
        order[slots] = some
        first = np.ones(len(slots), bool)
        first[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        rank = rank.copy()
        rank[some] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        levels.append(rank)
        slots, size = slots[alike(first)], size * 2
    return levels, order, slots


def forward(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x and from y on are alike, for x <> y."""
    x, start = x.copy(), x
    y = y.copy()
    for h in range(len(levels) - 1, -1, -1):
        step = (levels[h][x] == levels[h][y]).astype(np.int64) << h
        x += step
        y += step
    return x - start


def backward(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words before x and before y are alike, for x < y."""
    x, start = x.copy(), x
    y = y.copy()
    for h in range(len(levels) - 1, -1, -1):
        i, j = x - (1 << h), y - (1 << h)
        step = ((i >= 0) & (levels[h][np.maximum(i, 0)] == levels[h][np.maximum(j, 0)])).astype(np.int64) << h
        x -= step
        y -= step
    return start - x


def longest_previous(suffixes: list[int], common: list[int]) -> tuple[list[int], list[int]]:
    """For each position the length of the longest factor that also begins earlier, and such a beginning (-1 if there is none).

    ``common`` has the length that each suffix shares with the one before it in the array.
    """
    longest, source, stack = [0] * len(suffixes), [-1] * len(suffixes), []
    for at, shared in zip([*suffixes, -1], [*common, 0]):
        while stack and at < stack[-1][0]:
            top, below = stack.pop()
            if below >= shared:
                longest[top], source[top] = below, stack[-1][0] if below else -1
            else:
                longest[top], source[top] = shared, at
            shared = min(shared, below)
        stack.append((at, shared))
    return longest, source


def lz_blocks(longest: list[int]) -> list[int]:
    """The beginnings of the blocks, and the end of the text: each is a longest previous factor or a new word."""
    cuts = [0]
    while cuts[-1] < len(longest):
        cuts.append(cuts[-1] + max(1, longest[cuts[-1]]))
    return cuts


def at_boundaries(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray, cuts: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(start, end, period) of every stretch of LEAST words and TIMES periods that touches a boundary of blocks.

    ``cuts`` are boundaries in documents from ``low`` to ``high``, with the lengths of the blocks before and after. A run that
    ends in the block after one boundary has less than before + period words to the left of it, else the block before were a
    longer previous factor; so its period is less than half of both blocks together, and shorter blocks need no look.
    """
    ends = (before + after) // 2
    use = (before + after >= REPEATED) & (ends > 0)
    low, high, cuts, ends = low[use], high[use], cuts[use], ends[use]
    found, a = [np.zeros((0, 3), np.int64)], 0
    total = np.cumsum(ends)
    while a < len(cuts):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + QUERIES, "right")))
        n = ends[a:z]
        at, lo, hi = (np.repeat(c[a:z], n) for c in (cuts, low, high))
        period = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + 1
        for left in (False, True):
            x, y = (at - period, at) if left else (at, at + period)
            ok = (x >= lo) & (y <= hi)
            x, y, p = x[ok], y[ok], period[ok]
            right = forward(levels, x, y)
            # what lies to the left can only matter where it completes a stretch, which needs a look where the right side doesn't
            start, end = x - backward(levels, x, y), y + right
            hit = end - start >= np.maximum(LEAST, TIMES * p)
            found.append(np.stack((start[hit], end[hit], p[hit]), axis=1))
        a = z
    return np.concatenate(found)


def copied(first: list[tuple[int, int, int]], cuts: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """All runs of a text: those at boundaries, and copies of runs within the earlier occurrences of blocks, bucketed by start."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    starts: list[int] = []

    def put(start: int, end: int, period: int) -> None:
        if start not in buckets:
            buckets[start] = []
            insort(starts, start)
        buckets[start].append((end, period))

    for start, end, period in first:
        put(start, end, period)
    for b, e in zip(cuts, cuts[1:]):
        if e - b < LEAST + 2 or source[b] < 0:
            continue
        shift = b - source[b]
        i = bisect_right(starts, source[b])
        while i < len(starts) and starts[i] + shift < e:
            for end, period in list(buckets[starts[i]]):
                if end + shift < e:
                    put(starts[i] + shift, end + shift, period)
            i += 1
    return [(s, e, p) for s in starts for e, p in sorted(buckets[s], key=lambda r: r[1])]


def runs_in(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, end, period) of each text's words, given as numbers, by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    doc = np.repeat(np.arange(len(texts)), sizes)
    # four doublings tell in which texts any REPEATED words occur twice; the others have no run
    _, order, alike = classes_of(doc, np.concatenate(texts), REPEATED)
    some = np.unique(doc[order[alike]])
    if not len(some):
        return out
    texts, sizes = [texts[i] for i in some], sizes[some]
    doc, begins = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    levels, order, _ = classes_of(doc, np.concatenate(texts))
    common = np.zeros(len(order), np.int64)
    common[1:] = forward(levels, order[:-1], order[1:])
    every, sources = [], []
    for i, (b, n) in enumerate(zip(begins.tolist(), sizes.tolist())):
        longest, source = longest_previous((order[b : b + n] - b).tolist(), common[b : b + n].tolist())
        every.append(lz_blocks(longest))
        sources.append(source)
    bounds = [(b, b + n, b + c[k], c[k] - c[k - 1], (c[k + 1] - c[k]) if k + 1 < len(c) else 0) for b, n, c in zip(begins.tolist(), sizes.tolist(), every) for k in range(1, len(c))]
    hits = at_boundaries(levels, *np.array(bounds, np.int64).T)
    # of the periods of one stretch, all multiples of the smallest, that one counts
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    hits = hits[np.append(True, (hits[1:, :2] != hits[:-1, :2]).any(1))] if len(hits) else hits
    cut = np.searchsorted(hits[:, 0], np.append(begins, len(doc)))
    for i, k in enumerate(some.tolist()):
        mine = hits[cut[i] : cut[i + 1]] - [begins[i], begins[i], 0]
        out[k] = copied([tuple(r) for r in mine.tolist()], every[i], sources[i])
    return out


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: a run drops all its words after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, end, period in runs:
        change[start + period] += 1
        change[end] -= 1
    return np.cumsum(change)[:n] == 0


def _best(runs: list[tuple[int, int, int]]) -> int | None:
    """The place of the run of greatest exact length / period, ties to the smallest start and period."""
    exact = lambda r: ((r[1] - r[0]) // r[2], (r[1] - r[0]) % r[2] / r[2])  # noqa: E731  two fractions of periods below 2^25 are never one double
    return min(range(len(runs)), key=lambda i: (*(-x for x in exact(runs[i])), runs[i][0], runs[i][2])) if runs else None


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every row of docs(doc_id, text); other columns don't matter.

    ``runs`` holds structs (start, length, period) by start and period, ``best`` the one of greatest length / period (null if
    there is none), and ``collapsed`` the words that no run repeats, joined by one space. A null or wordless text has no runs
    and an empty ``collapsed``; null ids and repeated rows stay; an empty table gives an empty result. A text is held by one
    task, with about 100 bytes for each word and doubling.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a, z in _shares([len(t or "") for t in texts]):
                words = [words_of(t) for t in texts[a:z]]
                number: dict[bytes, int] = {}
                coded = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in words]
                rows = []
                for i, ws, runs in zip(ids[a:z], words, runs_in(coded)):
                    stays = ws if not runs else [ws[k] for k in np.flatnonzero(kept(len(ws), runs)).tolist()]
                    items = [(s, e - s, p) for s, e, p in runs]
                    best = _best(runs)
                    rows.append((i, len(ws), items, None if best is None else items[best], b" ".join(stays).decode("utf-8", "surrogatepass")))
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(r[0]) else int(r[0]) for r in rows], dtype="Int64")} | {c: [r[k] for r in rows] for k, c in enumerate(("n_words", "runs", "best", "collapsed"), 1)})
        give_back()

    run_type = "struct<start: long, length: long, period: long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id long, n_words long, runs array<{run_type}>, best {run_type}, collapsed string")


def _shares(sizes: list[int]):
    """Bounds of consecutive texts of about WORDS words (six characters each) together; one alone may have more."""
    a, held = 0, 0
    for i, n in enumerate(sizes):
        if i > a and held + n > 6 * WORDS:
            yield a, i
            a, held = i, 0
        held += n
    if len(sizes) > a:
        yield a, len(sizes)


def planted(doc_id: int, text: str) -> str:
    """The text with its end made periodic, as the id's hash says."""
    g, words = zlib.crc32(str(doc_id).encode()) // 10, words_of(text)
    n = len(words)
    if not n:
        return ""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return b" ".join(words[:a] + (tail * (-(-(n - a) // p)))[: n - a]).decode("utf-8", "surrogatepass")


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """A row without an id isn't changed before its runs are found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))

    @F.pandas_udf("string")
    def repeated(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else planted(int(i), t) for i, t in zip(ids, texts)], dtype=object)

    one = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    some = F.when(one, F.col("text"))  # only the texts that change go to Python for it
    docs = docs.select("doc_id", F.coalesce(repeated(F.coalesce("doc_id", F.lit(0)), some), "text").alias("text"))
    found = find_runs(docs)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
