"""Exact search, periodic runs and conversation repair against plain versions of themselves."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import pivots, runs, turns

# -- exact search ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def vectors_of(spark, rows):
    return pivots.quantised(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumns({"q": F.lit(1), "id": F.lit(2), "score": F.lit(3)}), "vec_id", "embedding")


def plain_search(rows, k):
    """Every query against every other row, in Python's integers."""
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, q) in enumerate(whole):
        if i is not None and i % 50 == 0:
            others = [(-sum(a * b for a, b in zip(q, v)), (j is None, j or 0), j) for m, (j, v) in enumerate(whole) if m != n]
            out.update((i, rank, j, -s) for rank, (s, _, j) in enumerate(heapq.nsmallest(k, others, key=lambda x: x[:2]), 1))
    return out


def searched(spark, rows, k=5):
    df = vectors_of(spark, rows)
    return Counter(tuple(r) for r in pivots.top_k(df.where(f"id % 50 = 0 and id <> {pivots.NO_ID}"), df, k).collect())


def test_top_k_on_hard_rows(spark):
    rng = random.Random(5)
    v = lambda: [rng.gauss(0, 0.3) for _ in range(12)]
    one, two = v(), v()
    rows = [(i, v()) for i in range(300)] + [(1000 + i, one) for i in range(150)] + [(50, one), (50, one), (100, two), (100, two), (None, two), (None, v())]
    rows += [(2000, None), (2050, [0.1, None] * 6), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, [0.0] * 12), (2250, []), (2300, one[:5]), (2350, [-x for x in one]), (-50, v())]
    assert searched(spark, rows) == plain_search(rows, 5)


def test_top_k_of_few_rows_and_large_values(spark):
    assert searched(spark, []) == Counter()
    assert searched(spark, [(50, [1.0, 2.0])]) == Counter()
    assert searched(spark, [(50, [1.0, 2.0]), (7, [3.0, 1.0])]) == Counter({(50, 1, 7, 256 * 256 * 5): 1})
    rows = [(50 * i, [1e6 + i / 512, -3e6]) for i in range(4)] + [(i, [-1e6, 2e6 + i]) for i in (1, 2, 3)]
    assert searched(spark, rows, 3) == plain_search(rows, 3)


def test_pivots_spare_most_rows_of_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (40, 16))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 16))).astype(np.int64)
    p = pivots.farthest(x[:500], 16)
    q = x[:60]
    ids, scores, evaluated = pivots.search(q, pivots.distances(q, p), [None] * 60, x, pivots.distances(x, p), np.arange(4000), 6)
    want = q @ x.T
    for i in range(60):
        order = np.lexsort((np.arange(4000), -want[i]))[:6]
        assert ids[i].tolist() == order.tolist() and scores[i].tolist() == want[i][order].tolist()
    assert evaluated < 0.2 * want.size


# -- runs -----------------------------------------------------------------------------------------------------------------


def plain_runs(w):
    """All stretches by each period in turn; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def mixed_words(rng, n):
    k, w = rng.choice([1, 2, 3, 5, 50]), []
    while len(w) < n:
        kind = rng.random()
        if kind < 0.4:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 12))]
        elif kind < 0.8:
            w += ([rng.randrange(k) for _ in range(rng.randrange(1, 14))] * rng.randrange(2, 12))[: rng.randrange(1, 120)]
        elif w:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randrange(1, 100)]
    return w


def test_all_runs_are_found():
    rng, total = random.Random(8), 0
    for _ in range(15):
        batch = [mixed_words(rng, rng.choice([0, 20, 100, 400])) for _ in range(20)] + [[]]
        want = [plain_runs(b) for b in batch]
        assert runs.runs_in([np.array(b, np.int64) for b in batch]) == want
        total += sum(map(len, want))
    assert total > 300


def test_runs_at_edges_and_within_blocks():
    unit = [*"abc"] * 8
    for w in (unit, [*"x", *unit], [*unit, "x"], [*"xy", *unit, *"zw", *"xy", *unit, *"zw", *"xy", *unit], ["a"] * 24, ["a"] * 23, [*"ab"] * 500, [*([*"ab"] * 12), "c"] * 6):
        number = {}
        coded = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
        assert runs.runs_in([coded]) == [plain_runs(w)]
    fib = ["a", "b"]
    while len(fib) < 600:
        fib = [x for y in fib for x in (("a", "b") if y == "a" else ("a",))]
    assert runs.runs_in([np.array([x == "a" for x in fib], np.int64)]) == [plain_runs(fib)]


def test_find_runs_rows(spark):
    rng = random.Random(2)
    texts = [(1, " ".join(map(str, mixed_words(rng, 300)))), (2, ""), (3, None), (None, "a b " * 20), (4, " \n\t "), (5, "tie " * 30), (5, "tie " * 30), (6, "é x  \r\n y" * 40), (7, "w " * 30_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"runs": F.lit(1), "best": F.lit(2), "n_words": F.lit(3)})
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), tuple(r["best"]) if r["best"] else None, r["collapsed"]) for r in runs.find_runs(df).collect())
    want = Counter()
    for i, t in texts:
        w = (t or "").encode().split()
        if i == 7:
            found = [(0, 30_000, 1)]
        else:
            found = plain_runs(w)
        gone = {k for s, e, q in found for k in range(s + q, e)}
        best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
        want[(i, len(w), tuple((s, e - s, q) for s, e, q in found), best and (best[0], best[1] - best[0], best[2]), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())] += 1
    assert got == want
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op12_against_plain(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(str(rng.randrange(60)) for _ in range(rng.randrange(0, 150)))) for i in range(120)] + [(None, "a " * 40), (7, "a " * 40), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in runs.op12_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    want, some = Counter(), 0
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, some = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], some + 1
        found = plain_runs(w)
        gone = {k for s, e, q in found for k in range(s + q, e)}
        best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
        top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(i, len(found), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    assert got == want and some > 5


# -- conversations --------------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """Cheapest first over (turns done, state), one edit at a time; rows are (initial, fault)."""
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, k, state = heapq.heappop(queue)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in (0, 3):
            return cost, audit
        for r in "ua":
            for i, j in turns.STEPS[r]:
                if i == state:
                    heapq.heappush(queue, (cost + 3, audit + "I", k, j))
        if k < len(rows):
            initial, fault = rows[k]
            heapq.heappush(queue, (cost + 4, audit + "D", k + 1, state))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for i, j in turns.STEPS.get(initial, ()):
                    if i == state:
                        heapq.heappush(queue, (cost + more, audit + "K", k + 1, j))
                for r in "ua":
                    for i, j in turns.STEPS[r]:
                        if i == state:
                            heapq.heappush(queue, (cost + more + 3, audit + "R", k + 1, j))


def enumerated(rows):
    """All edits of a short conversation with at most two inserted turns in a row, by hand."""
    best = None

    def go(k, roles, cost, audit, row_inserts):
        nonlocal best
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if row_inserts < 2:
            for r in "ua":
                go(k, roles + r, cost + 3, audit + "I", row_inserts + 1)
        if k < len(rows):
            initial, fault = rows[k]
            go(k + 1, roles, cost + 4, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                go(k + 1, roles + initial, cost + more, audit + "K", 0)
                for r in "ua":
                    go(k + 1, roles + r, cost + more + 3, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_matrices_against_plain():
    rng = random.Random(3)
    for n in [*range(4)] * 6:
        rows = [(rng.choice("suat"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(n)]
        assert plain_repair(rows) == enumerated(rows)
    for _ in range(2000):
        rows = [(rng.choice("suat"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(0, 12))]
        every = [turns.TURNS[i if i in turns.ROLES else "", f] for i, f in rows]
        assert turns.repair_of(turns.product(every)) == plain_repair(rows)
        cut = rng.randrange(len(rows) + 1)
        assert turns.times(turns.product(every[:cut]), turns.product(every[cut:])) == turns.product(every)


def plain_conversations(rows):
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired role:text lines)."""
    out, every = {}, {}
    for c, t, r, x in rows:
        every.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    for c, own in every.items():
        own.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.sha256(y[2].encode()).hexdigest()))
        seen, kinds = set(), []
        for _, r, x in own:
            bare = x.strip(" \t\n\r\x0b\x0c")
            kinds.append((r[:1], "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((r, x))
        cost, audit = plain_repair(kinds)
        lines, n, now = [], 0, "user"
        for e in audit:
            _, r, x = own[n] if e != "I" else (None, None, "")
            n += e != "I"
            if e == "D":
                continue
            if e == "K" and r.startswith("s"):
                lines.append(f"{r}:{x}")
                continue
            lines.append(f"{r if e == 'K' else now}:{x}")
            now = "assistant" if now == "user" else "user"
        ts = [t for t, _, _ in own if t is not None]
        out[c] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *(sum(f == k for _, f in kinds) for k in ("blank", "duplicate", "truncated")), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])), cost, audit, lines)
    return out


def random_conversation(rng, c, n):
    say = lambda: rng.choice(["yes.", "no!", "why", "", " \n", None, "ok?", "hm. ", f"number {rng.randrange(99)}."])
    return [(c, rng.choice([None, rng.randrange(2 * n + 1)]) if rng.random() < 0.1 else k, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), say()) for k in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_of_hard_conversations(spark):
    rng = random.Random(6)
    rows = [r for c in range(40) for r in random_conversation(rng, c, rng.randrange(1, 9))] + random_conversation(rng, None, 5) + random_conversation(rng, 77, 700) + [(78, 1, "user", "same.")] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"row": F.lit(1), "at": F.lit(2), "audit": F.lit("x"), "code": F.lit("y")})
    found, fixed = turns.repair(df)
    lines = {}
    for r in sorted(fixed.collect(), key=lambda r: (r["at"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    got = {r["conv_id"]: (*tuple(r)[1:], lines.get(r["conv_id"], [])) for r in found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()}
    assert got == plain_conversations(rows)


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    """Pieces of tasks are joined in rounds of two."""
    rng = random.Random(1)
    rows = random_conversation(rng, 5, 400) + random_conversation(rng, 6, 3)
    monkeypatch.setattr(turns, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        laid = turns.faults(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, " + SCHEMA).fillna(" ", ["role", "text"]))
        parts = turns.pieces(laid)
        assert parts.where("conv_id = 5").count() > 3
        whole = {r["conv_id"]: r for r in turns.tree(parts).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for c, want in plain_conversations(rows).items():
        r = whole[c]
        assert ((r["high"] or 0) - (r["low"] or 0) + 1 - r["turns"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == want[:5]
        assert turns.repair_of(tuple(x and (x["cost"], x["audit"]) for x in r["matrix"])) == want[5:7]


def test_empty_conversations(spark):
    found, fixed = turns.repair(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and fixed.count() == 0


def test_op13_with_nulls_and_dropped_conversations(spark, tmp_path):
    rng = random.Random(4)
    rows = [r for c in range(60) for r in random_conversation(rng, c, rng.randrange(1, 4))] + [(None, 1, "user", "a."), (None, None, None, None)] + [(100 + c, 0, "user", "gone.") for c in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    left = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        left += [(c, t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x)] * (0 if h == 0 else 2 if h == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", []) for c, *_ in rows} | plain_conversations(left)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.op13_turns(spark, str(tmp_path)).collect()}
    assert got == {c: (*v[:7], hashlib.sha256("\n".join(v[7]).encode()).hexdigest()) for c, v in want.items()}
    assert any(len(v[6]) == 0 for v in want.values())


@pytest.mark.parametrize("audit, initials, want", [("KKKI", "sua", ["Ks", "Ku", "KaIu"]), ("", "", []), ("DIK", "xa", ["D-", "IuKa"]), ("IIDD", "uu", ["IuIaD-", "D-"])])
def test_codes(audit, initials, want):
    assert turns.coded(audit, initials) == want
