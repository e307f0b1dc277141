"""What the operators of this subpackage share: table access, shared storage and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A local one is made only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _own_dirs[app]


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage so that a lost executor costs a re-read, not a re-run of everything before. The folder is
    removed when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses, removed when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


BATCH_ROWS = 1000


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on at most so many rows of the session go to Python at a time, as whole texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers outlive their tasks and the next stage needs the room."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in edges; root is the smallest node that can be reached.

    Alternates large-star and small-star steps, each a grouped minimum and a join back. The minima are written before
    they are joined, so both sides of a join are dealt out for it alone and a node with very many edges can be split. The
    edges are written between rounds, of which there are about as many as a component's size has digits. Self loops and repeated edges are allowed, edges with a null end are ignored, and no edges give no rows.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    cur = materialize(cur.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every row now points from a larger node to a smaller one
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        cur = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        # Done when every larger node has one edge and no root is itself a larger node.
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = (state["n"], state["h"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components were not settled after {max_rounds} rounds")
    roots = cur.select("v").distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def fold(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, held: int, per_class: dict[int, int], max_chars: int):
    """A bounded sample of labelled texts as pandas: text, lang, y; never a row whose fold of n is ``held``.

    Of each class it takes the ``per_class`` rows lowest in hash order whose text has at most ``max_chars`` characters
    (longer ones and rows without a text are left out of the fit alone). Of rows that share an id the text lowest in hash order
    counts. Null ids and labels that aren't 0 or 1 are ignored.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(f"doc_id is not null and y in (0, 1) and {label} is not null")
    known = known.where(fold("doc_id", n) != held)
    order = F.xxhash64(F.lit(17), "doc_id")
    picks = None
    for y, most in per_class.items():
        part = known.where(F.col("y") == y).distinct().withColumn("h", order).orderBy("h", "doc_id").limit(most).select("doc_id", "y")
        picks = part if picks is None else picks.unionByName(part)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.length("text") <= max_chars).join(F.broadcast(picks), "doc_id")  # the picks are bounded by per_class
    rows = rows.groupBy("doc_id", "y").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text")).alias("r"))
    return rows.select("doc_id", "r.text", "r.lang", "y").toPandas().sort_values(["doc_id", "y"], ignore_index=True)


def small(df: DataFrame, most_rows: int = 500_000, most_bytes: int = 1 << 26) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and characters in them, else as it is, for a join by shuffle.

    df should be cheap to read twice.
    """
    if df.count() > most_rows:
        return df
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]))))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df
