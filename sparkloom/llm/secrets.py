"""Secret scans over a content-addressed ledger of text versions.

Every version of a text is addressed by its SHA-256. Only pairs of a text and a rule version that the ledger hasn't
are scanned, each text once however many paths hold it, and the findings are joined back to all paths. The main path is
DataFrame functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize, scratch, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules. A match counts if its group has at least so many characters.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, base=True),
    Rule("hex", r"[0-9a-f]+", 0, 24, base=True),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", 0, 1),
)
RULES = BASE + EXTRA
LEDGER = "blob string, rule string, spans array<struct<at:bigint,end:bigint>>"
#: A cheaper test of whether a rule can match at all, where one is equivalent.
SCREEN = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}


def _parts(text: Column, rule: Rule) -> Column:
    """Lengths of the gap before each match, of the match and of its group; the last entry is the gap at the end."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("hit"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("inner"),
    )
    return F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["hit"].alias("hit"), z["inner"].alias("inner")))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule, spans) of every blob of blobs(blob, text, todo) and rule in its todo; code points, end exclusive."""
    each = []
    for rule in rules:
        can = F.col("text").rlike(SCREEN.get(rule.kind, rule.pattern))
        parts = F.when(can, _parts(F.col("text"), rule))
        each.append(F.when(F.array_contains("todo", rule.key), F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), parts.alias("parts"))))
    rows = blobs.select("blob", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r"))
    # a rule that can't match has no parts, and what stands behind the last match is a part without one: each keeps a row
    rows = rows.select("blob", "r.rule", "r.least", F.posexplode_outer("r.parts").alias("i", "p"))
    order = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("p.gap") + F.coalesce("p.hit", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("blob", "rule", "p.hit", "p.inner", "least", end.cast("long").alias("end"))
    span = F.when(F.col("inner") >= F.col("least"), F.struct((F.col("end") - F.col("hit")).alias("at"), "end"))
    return rows.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def addressed(versions: DataFrame) -> DataFrame:
    """(doc_id, blob, text) of versions(doc_id, text); a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return versions.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("text"))


def unseen(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(blob, rule, spans array<struct<at,end>>) of every text of versions(doc_id, text) and rule version that the ledger hasn't.

    There is a row where nothing was found, too, so that no later call scans that text by that rule version again.
    """
    blobs = addressed(versions).select("blob", "text").dropDuplicates(["blob"])
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return scan(blobs.withColumn("todo", every), rules)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    return scan(todo.where(F.size("todo") > 0), rules)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The ledger (blob, rule, spans) with the rows that versions(doc_id, text) add; rows of the ledger given stay as they are."""
    new = unseen(versions, ledger, rules)
    return new if ledger is None else ledger.select("blob", "rule", "spans").unionByName(new)


def keep_ledger(versions: DataFrame, folder: str, rules=RULES) -> DataFrame:
    """The ledger in a folder that all executors share, after the rows that versions(doc_id, text) add were appended to it.

    The first call makes the folder. A call that dies leaves the ledger as it was, as Spark shows appended files only once
    all are written; two calls at a time would both scan what both find unseen, which repeats rows but changes no finding.
    """
    spark = versions.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    known = spark.read.schema(LEDGER).parquet(folder) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None
    unseen(versions, known, rules).write.mode("append").option("compression", "zstd").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def by_blob(ledger: DataFrame, rules=RULES) -> DataFrame:
    """One row for each text with findings: counts of the base kinds, the digest of the base spans, and all spans."""
    kinds = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    names = F.array(*[F.lit(r.kind) for r in rules])
    n_base = sum(r.base for r in rules)
    rows = ledger.where(F.size("spans") > 0).dropDuplicates(["blob", "rule"]).select("blob", kinds[F.col("rule")].alias("k"), F.explode("spans").alias("s"))
    rows = rows.where("k is not null").select("blob", "k", F.col("s.at").alias("at"), F.col("s.end").alias("end"))
    counts = [F.count_if(F.col("k") == i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    grouped = rows.groupBy("blob").agg(*counts, F.array_sort(F.collect_list(F.struct("at", "k", "end"))).alias("all"))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["k"]], s["at"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("all", lambda s: s["k"] < n_base)
    return grouped.select("blob", *[f"n_{r.kind}" for r in rules if r.base], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))


def secret_scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, folder: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of versions(doc_id, text).

    Texts and rule versions in ``ledger``, or in the one kept in ``folder``, aren't scanned; a ledger in a folder keeps
    what this call scans. Null and empty texts have no spans; base_sha256 is then the digest of an empty string. Rows with
    a null or a repeated doc_id stay, each with the findings of its own text. Other columns are ignored. An empty table gives
    an empty result.
    """
    after = keep_ledger(versions, folder, rules) if folder else update_ledger(versions, ledger, rules)
    found = materialize(by_blob(after, rules), "found")
    paths = addressed(versions).select("doc_id", "blob")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules if r.base]
    none = F.sha2(F.lit(""), 256)
    return paths.join(found, "blob", "left").select("doc_id", *counts, F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """The ledger lies in a folder of this call's own, so the rows don't depend on earlier calls."""
    return secret_scan(table(spark, sf_dir, "documents"), folder=scratch(spark, "secrets-ledger"))


def oracle() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    kinds = "\nUNION ALL\n".join(
        f"SELECT n, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, unnest(range(1, len(h) + 1)) AS i, unnest(list_transform(p[1:len(h)], lambda x: length(x))) AS gap, "
        f"unnest(list_transform(h, lambda x: length(x))) AS hit, unnest(list_transform(g, lambda x: length(x))) AS inn "
        f"FROM (SELECT n, regexp_split_to_array(t, {quoted(r.pattern)}) AS p, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS h, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g FROM d WHERE regexp_matches(t, {quoted(r.pattern)}))"
        for i, r in enumerate(RULES)
    )
    n_base = len(BASE)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
e AS (SELECT *, sum(gap + hit) OVER (PARTITION BY n, k ORDER BY i) AS stop FROM m),
s AS (SELECT n, k, stop - hit AS pos, kind || ':' || (stop - hit)::BIGINT || ':' || stop::BIGINT AS span FROM e WHERE inn >= least),
f AS (SELECT n, {', '.join(f"count(*) FILTER (WHERE k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
 sha256(coalesce(string_agg(span, ',' ORDER BY pos, k) FILTER (WHERE k < {n_base}), '')) AS base_sha256, string_agg(span, ',' ORDER BY pos, k) AS spans FROM s GROUP BY n)
SELECT doc_id, {counts}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (n)"""
