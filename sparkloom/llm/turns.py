"""Conversation structure repair as a scan of min-plus matrices.

A conversation is sound if its role initials are nothing, or an optional s and then pairs of u and a. Its states are: nothing
yet, after s, after u, after a. Each turn is a 4x4 matrix whose elements are the cheapest (cost, audit) that lead from state to
state by inserted turns and then the turn's own edit. The product of matrices takes the least sum, ties to the smaller audit;
it is associative, so the turns of a conversation are multiplied in a tree, within a task and then across partitions.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import bound_batches, materialize, table

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States are 0 nothing, 1 after s, 2 after u, 3 after a; the steps (from, to) that a role's initial allows.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ROLES = {"s": "system", "u": "user", "a": "assistant"}
SPACE = r"\x20\x09-\x0D"
#: Pieces of one conversation that are multiplied at once, when it reaches over partitions.
FAN = 16
Matrix = tuple[tuple[int, str] | None, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    out: list[tuple[int, str] | None] = [None] * 16
    for i in range(0, 16, 4):
        for k in range(4):
            if (x := a[i + k]) is None:
                continue
            for j in range(4):
                if (y := b[4 * k + j]) is None:
                    continue
                cost, best = x[0] + y[0], out[i + j]
                if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                    out[i + j] = (cost, x[1] + y[1])
    return tuple(out)


def _edits(entries) -> Matrix:
    out: list[tuple[int, str] | None] = [None] * 16
    for i, j, cost, edit in entries:
        if out[4 * i + j] is None or (cost, edit) < out[4 * i + j]:
            out[4 * i + j] = (cost, edit)
    return tuple(out)


UNIT = _edits((i, i, 0, "") for i in range(4))
_ONE = _edits([(i, i, 0, "") for i in range(4)] + [(i, j, INSERT, "I") for r in "ua" for i, j in STEPS[r]])
#: All that inserted turns can do: a chain of more than three of them returns to where it was.
INSERTS = times(times(_ONE, _ONE), _ONE)


def _turn(initial: str, fault: str) -> Matrix:
    edits = [(i, i, DELETE, "D") for i in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        edits += [(i, j, more, "K") for i, j in STEPS.get(initial, ())]
        edits += [(i, j, REROLE + more, "R") for r in "ua" for i, j in STEPS[r]]
    return times(INSERTS, _edits(edits))


#: The matrices of all kinds of turns; an initial that no step allows is written as "".
TURNS = {(r, f): _turn(r, f) for r in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


def product(matrices: list[Matrix]) -> Matrix:
    """Multiplied pairwise, level by level, so an audit is copied once for each level."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else UNIT


def repair_of(whole: Matrix) -> tuple[int, str]:
    """The cheapest (cost, audit) that makes a conversation sound."""
    closed = times(whole, INSERTS)
    return min(x for x in (closed[0], closed[3]) if x is not None)


def coded(audit: str, initials: str) -> list[str]:
    """For each turn its inserted turns and its own edit, each with the initial of the role that it gives; those at the end stand with the last turn.

    Roles follow from the audit: an s is kept first or never, then u and a take turns.
    """
    out, now, role, at = [], "", "u", 0
    for edit in audit:
        own = "-" if edit == "D" else "s" if edit == "K" and initials[at] == "s" else role
        now += edit + own
        if own in "ua":
            role = "a" if own == "u" else "u"
        if edit != "I":
            out.append(now)
            now, at = "", at + 1
    if now and out:
        out[-1] += now
    return out


def faults(rows: DataFrame) -> DataFrame:
    """(at, conv_id, turn, initial, fault, row) of rows(row, conv_id, turn, role, text), whose row is unique, in the shared folder.

    ``at`` follows conversations and their turns, nulls first; rows of one turn go by role, then by a hash of the text. A
    turn's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated. The texts of one
    conversation are dealt out over as many partitions as they fill.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1).alias("last")
    slim = rows.select("row", "conv_id", "turn", "role", digest, last)
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row")).alias("f")).select(F.col("f.row").alias("row"), F.lit(True).alias("new"))
    slim = slim.join(first, "row", "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "row")]
    laid = slim.withColumn("fault", fault).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(laid.select(F.monotonically_increasing_id().alias("at"), "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "row"), "turns")


PIECE = "conv_id long, first long, n long, low long, high long, nulls long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, head_turn long, tail_turn long, initials string, matrix array<struct<cost: long, audit: string>>"
_SUMS = ("n", "nulls", "turns", "blank", "duplicate", "truncated", "illegal")


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def joined(pieces: list[dict]) -> dict:
    """One piece of consecutive pieces of a conversation."""
    out = dict(pieces[0])
    for p in pieces[1:]:
        for c in _SUMS:
            out[c] += p[c]
        out["illegal"] += not legal(out["tail"], p["head"])
        # a turn number that goes on over the boundary is one
        out["turns"] -= out["tail_turn"] is not None and out["tail_turn"] == p["head_turn"]
        out["low"] = min((x for x in (out["low"], p["low"]) if x is not None), default=None)
        out["high"] = max((x for x in (out["high"], p["high"]) if x is not None), default=None)
        out["tail"], out["tail_turn"] = p["tail"], p["tail_turn"]
    out["initials"] = "".join(p["initials"] for p in pieces)
    out["matrix"] = product([p["matrix"] for p in pieces])
    return out


def piece(conv_id, at: list[int], turns: list, initials: list[str], found: list[str]) -> dict:
    """The piece of some consecutive turns of a conversation."""
    known = [t for t in turns if t is not None]
    return {
        "conv_id": conv_id, "first": at[0], "n": len(at), "low": min(known, default=None), "high": max(known, default=None), "nulls": len(turns) - len(known), "turns": len(set(known)),
        **{f: found.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(not legal(a, b) for a, b in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1],
        "head_turn": turns[0], "tail_turn": turns[-1], "initials": "".join(i if i in ROLES else "x" for i in initials), "matrix": product([TURNS[i if i in ROLES else "", f] for i, f in zip(initials, found)]),
    }


def _frame(pieces: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in PIECE.split(", matrix")[0].split(", ")]
    whole = {"initials", "head", "tail"}
    out = pd.DataFrame({c: pd.Series([p[c] for p in pieces], dtype=object if c in whole else "Int64") for c in names})
    out["matrix"] = [[None if x is None else {"cost": x[0], "audit": x[1]} for x in p["matrix"]] for p in pieces]
    return out


def _piece_of(row: dict) -> dict:
    row = {c: None if not isinstance(v, (str, list)) and not hasattr(v, "__len__") and pd.isna(v) else v for c, v in row.items()}
    row["matrix"] = tuple(None if x is None else (x["cost"], x["audit"]) for x in row["matrix"])
    return row


def pieces(turns: DataFrame) -> DataFrame:
    """A piece for each stretch of turns of one conversation that a task reads in order."""

    def run(batches):
        held = None  # conversation, places, turns, initials and faults of the piece that may go on
        for pdf in batches:
            out = []
            null = lambda c: [None if pd.isna(x) else int(x) for x in pdf[c].array]
            for conv_id, at, turn, initial, fault in zip(null("conv_id"), pdf["at"].tolist(), null("turn"), pdf["initial"].tolist(), pdf["fault"].tolist()):
                if held is None or held[0] != conv_id or at != held[1][-1] + 1:
                    if held is not None:
                        out.append(piece(*held))
                    held = (conv_id, [], [], [], [])
                for kept, x in zip(held[1:], (at, turn, initial, fault)):
                    kept.append(x)
            if out:
                yield _frame(out)
        if held is not None:
            yield _frame([piece(*held)])

    return turns.select("conv_id", "at", "turn", "initial", "fault").mapInPandas(run, PIECE)


def tree(parts: DataFrame) -> DataFrame:
    """One piece for each conversation: pieces are joined FAN at a time, round by round. A round has as many rows of one conversation as tasks held it."""
    whole = None
    while True:
        counts = Window.partitionBy("conv_id")
        numbered = parts.withColumns({"m": F.count("*").over(counts), "k": F.row_number().over(counts.orderBy("first"))})
        numbered = materialize(numbered, "pieces")
        done = numbered.where("m = 1").drop("m", "k")
        whole = done if whole is None else whole.unionByName(done)
        many = numbered.where("m > 1")
        if many.isEmpty():
            return whole

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            return _frame([joined([_piece_of(r) for r in pdf.sort_values("first").drop(columns=["m", "k", "g"]).to_dict("records")])])

        parts = many.withColumn("g", F.floor((F.col("k") - 1) / FAN)).groupBy("conv_id", "g").applyInPandas(join, PIECE)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with conversations(conv_id, turn, role, text) and their repaired turns; other columns don't matter.

    The first table has for each conv_id with rows: gaps, blank, duplicate, truncated, illegal, cost and audit. The second has
    (conv_id, at, place, role, text) of every turn of the repaired conversations, by at and place. Null roles and texts count as
    one space, null turns come first and aren't counted in gaps, and rows with a null conv_id are one conversation. Rows of
    one turn go by role and text; repeated rows are duplicates. An empty table gives two empty ones.

    A conversation may reach over any number of partitions; what one task holds of it is its audit (a byte for each turn and
    matrix element), as the audit is one value of the result.
    """
    bound_batches(conversations.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")
    turns = faults(rows)
    parts = materialize(pieces(turns), "parts")
    whole = tree(parts)
    firsts = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("firsts"))  # as many as tasks held the conversation

    @F.pandas_udf("cost long, audit string")
    def repaired(matrices: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair_of(tuple(None if x is None else (x["cost"], x["audit"]) for x in m)) for m in matrices], columns=["cost", "audit"])

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    fixed = whole.withColumn("r", repaired("matrix")).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "r.cost", "r.audit", "initials")
    fixed = materialize(fixed, "fixed")

    def codes(batches):
        ats, every = [], []
        for pdf in batches:
            for audit, initials, places in zip(pdf["audit"], pdf["initials"], pdf["firsts"]):
                ats += [a for p in places for a in range(p["first"], p["first"] + p["n"])]
                every += coded(audit, initials)
                if len(ats) >= 1 << 14:
                    for i in range(0, len(ats), 1 << 16):
                        yield pd.DataFrame({"at": ats[i : i + (1 << 16)], "code": every[i : i + (1 << 16)]})
                    ats, every = [], []
        if ats:
            yield pd.DataFrame({"at": ats, "code": every})

    same = F.col("f.conv_id").eqNullSafe(F.col("g.conv_id"))
    code = fixed.alias("f").join(firsts.alias("g"), same).select("f.audit", "f.initials", "g.firsts").mapInPandas(codes, "at long, code string")
    edited = turns.select("at", "conv_id", "row").join(code, "at").join(rows.select("row", "role", "text"), "row")
    items = F.transform(F.sequence(F.lit(1), F.length("code") - 1, F.lit(2)), lambda i: F.substring(F.col("code"), i, F.lit(2)))
    named = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    turn = lambda e: F.struct(
        F.when(F.startswith(e, F.lit("K")), F.col("role")).otherwise(F.element_at(named, F.substring(e, 2, 1))).alias("role"),
        F.when(F.startswith(e, F.lit("I")), "").otherwise(F.col("text")).alias("text"),
    )
    made = F.transform(F.filter(items, lambda e: ~F.endswith(e, F.lit("-"))), turn)
    out = edited.select("conv_id", "at", F.posexplode(made).alias("place", "t"))
    return fixed.drop("initials"), out.select("conv_id", "at", "place", "t.role", "t.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the hash of conversation and turn says."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("_h")).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_turns(spark, sf_dir: str) -> DataFrame:
    """The digest needs a whole repaired conversation as one value, which bounds one conversation to what a row can hold; ``repair`` itself has no such bound."""
    given = table(spark, sf_dir, "conversations")
    found, fixed = repair(damaged(given))
    lines = F.struct("at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    texts = fixed.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), "\n").cast("binary"), 256).alias("sha"))
    ids = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    rows = ids.alias("i").join(found.alias("f"), same("i", "f"), "left").join(texts.alias("t"), same("i", "t"), "left")
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(F.col("i.conv_id").alias("conv_id"), *counts, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("t.sha", empty).alias("repaired_sha256"))


def oracle() -> str:
    """The same by a dynamic programme over the turns, and CRC-32 bit by bit."""
    steps = lambda r: ", ".join(f"('{r}', {i}, {j})" for i, j in STEPS[r])
    trim = r"'[\x20\x09-\x0D]+$'"
    return f"""WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
h AS (SELECT g.*, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, octet_length(k) + 1), lambda i: ascii(decode(k)[i])::UBIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT) % 20 AS h FROM g),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, right(regexp_replace(text, {trim}, ''), 1) AS last FROM d),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM n),
s(r, i, j) AS (VALUES {steps("s")}, {steps("u")}, {steps("a")}),
e(edit, ini, i, j, cost) AS (SELECT 'K', r, i, j, 0 FROM s UNION ALL SELECT 'R', '', i, j, {REROLE} FROM s WHERE r <> 's' UNION ALL SELECT 'D', '', i, i, {DELETE} FROM range(4) t(i)),
c(i, j, cost, audit) AS (SELECT i, i, 0, '' FROM range(4) t(i) UNION ALL SELECT i, j, {INSERT}, 'I' FROM s WHERE r <> 's' UNION ALL SELECT i, 3, {2 * INSERT}, 'II' FROM s WHERE r = 'u' AND i <> 3),
b AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0::BIGINT AS st, {{'c': 0::BIGINT, 'a': ''}} AS v FROM d
  UNION ALL SELECT b.conv_id, b.k + 1, e.j, min({{'c': b.v.c + c.cost + e.cost + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN {TRUNCATED} ELSE 0 END, 'a': b.v.a || c.audit || e.edit}})
  FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.k = b.k + 1 JOIN c ON c.i = b.st JOIN e ON e.i = c.j AND e.ini IN ('', f.ini) AND (e.edit <> 'K' OR e.ini = f.ini) AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.conv_id, b.k + 1, e.j),
w AS (SELECT b.conv_id, min({{'c': b.v.c + c.cost, 'a': b.v.a || c.audit}}) AS v FROM b JOIN (SELECT conv_id, max(k) AS k FROM f GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.k = b.k JOIN c ON c.i = b.st WHERE c.j IN (0, 3) GROUP BY 1),
p AS (SELECT conv_id, v.a AS audit, unnest(range(1, len(v.a) + 1)) AS p FROM w),
q AS (SELECT conv_id, p, audit[p] AS edit, len(replace(audit[1:p], 'I', '')) AS k, len(replace(audit[1:p - 1], 'D', '')) AS made FROM p),
o AS (SELECT q.*, f.role, f.text, max(CASE WHEN q.edit = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS sys FROM q LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.k = q.k AND q.edit <> 'I'),
t AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (made - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS sha FROM o WHERE edit <> 'D' GROUP BY 1),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (k > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.v.c, 0) AS cost, coalesce(w.v.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""
