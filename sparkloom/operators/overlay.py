"""What is visible: the tracked tree with dirty files laid over it, and the joins that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_files(tree: DataFrame, dirty: DataFrame) -> DataFrame:
    """(path, hash, place) of tree(path, blob_hash) with dirty(path, content_hash) over it.

    place orders tracked paths first and dirty-only ones after them, each by path.
    """
    t = tree.select(F.col("path").alias("t_path"), "blob_hash")
    d = dirty.select(F.col("path").alias("d_path"), "content_hash")
    both = t.join(d, F.col("t_path") == F.col("d_path"), "full")
    path = F.coalesce("t_path", "d_path")
    place = F.struct(F.col("t_path").isNull().alias("dirty_only"), path.alias("path"))
    return both.select(path.alias("path"), F.coalesce("content_hash", "blob_hash").alias("hash"), place.alias("place"))


def aliases(visible: DataFrame) -> DataFrame:
    """(hash, path): the first visible path of each content."""
    return visible.where("hash is not null").groupBy("hash").agg(F.min_by("path", "place").alias("path"))


def resolve_candidates(candidates: DataFrame, visible: DataFrame) -> DataFrame:
    """Candidates(path, blob_hash, ...) under the path at which they can be seen; those that can't be seen go.

    Its own path stands if that is visible with the same content, or with any if the candidate has no blob; else the first
    path of the same content. With nothing visible at all every candidate stays.
    """
    if visible.isEmpty():
        return candidates
    own = visible.select(F.col("path").alias("_p"), F.col("hash").alias("_h"))
    first = aliases(visible).select(F.col("hash").alias("_b"), F.col("path").alias("_a"))
    no_blob = F.coalesce("blob_hash", F.lit("")) == ""
    rows = candidates.join(own, F.col("path") == F.col("_p"), "left").join(first, F.col("blob_hash") == F.col("_b"), "left")
    seen = F.when(F.col("_p").isNotNull() & (no_blob | (F.col("_h") == F.col("blob_hash"))), F.col("path")).otherwise(F.when(~no_blob, F.col("_a")))
    return rows.withColumn("path", seen).drop("_p", "_h", "_b", "_a").where("path is not null")


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between before(path, hash) and after(path, hash): added, modified, deleted or same."""
    b = before.select(F.col("path").alias("b_path"), F.col("hash").alias("b_hash"))
    a = after.select(F.col("path").alias("a_path"), F.col("hash").alias("a_hash"))
    change = F.when(F.col("b_path").isNull(), "added").when(F.col("a_path").isNull(), "deleted").when(F.col("b_hash").eqNullSafe(F.col("a_hash")), "same").otherwise("modified")
    return b.join(a, F.col("b_path") == F.col("a_path"), "full").select(F.coalesce("a_path", "b_path").alias("path"), change.alias("change"))


def new_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row of files(path, blob_hash, ...) for each content that blobs(blob_hash) doesn't have: the first by path."""
    unseen = files.join(blobs.select("blob_hash"), "blob_hash", "left_anti")
    low = unseen.groupBy("blob_hash").agg(F.min("path").alias("path"))
    return unseen.join(low, ["blob_hash", "path"], "left_semi")


def referenced_ids(blobs: DataFrame, dirty: DataFrame) -> DataFrame:
    """The distinct chunk ids that blobs(chunk_ids) and dirty(chunk_ids) name; empty ones aside."""
    ids = blobs.select(F.explode("chunk_ids").alias("id")).unionByName(dirty.select(F.explode("chunk_ids").alias("id")))
    return ids.where("id is not null and cast(id as string) <> ''").distinct()


def consistency(stored: DataFrame, referenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that are referenced and not stored, and ids that are stored and not referenced."""
    s, r = stored.select("id").distinct(), referenced.select("id").distinct()
    return r.join(s, "id", "left_anti"), s.join(r, "id", "left_anti")


def unreferenced_blobs(blobs: DataFrame, tree: DataFrame, dirty: DataFrame) -> DataFrame:
    """Blobs that no tracked or dirty file has."""
    used = tree.select("blob_hash").unionByName(dirty.select(F.col("content_hash").alias("blob_hash"))).distinct()
    return blobs.join(used, "blob_hash", "left_anti")


def known_ids(*tables: DataFrame) -> DataFrame:
    """The union of the first columns, distinct, without empty ones."""
    out = None
    for t in tables:
        ids = t.select(F.col(t.columns[0]).alias("id"))
        out = ids if out is None else out.unionByName(ids)
    return out.where("id is not null and cast(id as string) <> ''").distinct()


def reference_counts(blob: str, tree: DataFrame, dirty: DataFrame) -> DataFrame:
    """How many tracked and dirty files have a content."""
    one = tree.where(F.col("blob_hash") == blob).agg(F.count("*").alias("n")).unionByName(dirty.where(F.col("content_hash") == blob).agg(F.count("*").alias("n")))
    return one.agg(F.sum("n").alias("n"))


def scrub_ids(table: DataFrame, gone: list[str]) -> DataFrame:
    """chunk_ids without those that are gone."""
    return table.withColumn("chunk_ids", F.array_except("chunk_ids", F.array(*[F.lit(x) for x in gone]).cast("array<string>")))
