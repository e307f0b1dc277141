"""A versioned table store on Parquet: merge-on-read changes over a base, in buckets, with marker files that say what counts.

A table is a folder of versions. A version is a base (all rows) or a change: new rows, and tombstones of groups whose earlier
rows go. A read lays the changes since the last base over it: of each group the rows of its last version count. So a change
writes its own rows alone, whatever the table holds, and compaction folds changes into a new base.

Rows lie in buckets by a hash of one column and are sorted by it within each, so a question with that column reads a bucket
and skips row groups by their least and greatest values.

An empty marker file says that a version is whole. Making it is one step and nothing is deleted or renamed for it, so
readers see the old or the new table wherever a write dies. A version's folder is never written twice: a second writer
that takes the same number fails, and leaves what is marked as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKERS, CHANGE = "_whole", "_change"
#: Changes over a base before they are folded, and the share of the base's bytes that they may have.
MOST_CHANGES, MOST_SHARE = 8, 0.5


class Spec(NamedTuple):
    """Columns; the key by which upserts replace; the group of rows that one change replaces together; the column of the buckets."""

    columns: str
    key: tuple[str, ...]
    group: tuple[str, ...]
    bucket: str


def _spec(columns: str, key: str = "", group: str = "", bucket: str = "") -> Spec:
    key_ = tuple(key.split())
    group_ = tuple(group.split()) or key_
    return Spec(columns, key_, group_, bucket or group_[-1])


#: The stored tables, their columns and keys.
TABLES = {
    "chunks": _spec("id string, vector array<float>, content string, file_path string, start_line int, end_line int, symbol_name string, symbol_kind string, language string, repo_id string, worktree_id string", "id"),
    "chunk_blobs": _spec("chunk_id string, blob_hash string", "chunk_id blob_hash", "blob_hash", "chunk_id"),
    "blobs": _spec("blob_hash string, chunk_ids array<string>", "blob_hash"),
    "contents": _spec("blob_hash string, content string", "blob_hash"),
    "tree_entries": _spec("worktree_id string, path string, blob_hash string", "worktree_id path"),
    "dirty_files": _spec("worktree_id string, path string, content_hash string, chunk_ids array<string>", "worktree_id path"),
    "changed_at": _spec("worktree_id string, path string, modified timestamp", "worktree_id path"),
    "symbols": _spec("name string, kind string, file_path string, start_line int, end_line int, chunk_id string, repo_id string, worktree_id string", "worktree_id name file_path start_line", "worktree_id file_path"),
    "docs_chunks": _spec("url string, chunk_index int, title string, content string, updated_at timestamp", "url chunk_index", "url"),
    "index_state": _spec("key string, value string", "key"),
    "commits": _spec("commit string, short_commit string, author string, date_raw string, message string, files array<string>, repo_path string, repo_id string, branch string, ts timestamp", "repo_id commit", "repo_id commit"),
    "import_edges": _spec("worktree_id string, source_file string, raw_specifier string, imported_names array<string>, resolved_target string, edge_kind string, level int, confidence string, unresolved_reason string, lang string", "", "worktree_id source_file"),
    "import_keys": _spec("key string, kind string, worktree_id string, source_file string, raw_specifier string", "", "worktree_id source_file", "key"),
}
DEFAULTS = {"worktree_id": "default-worktree", "symbol_name": "", "symbol_kind": ""}


class Store:
    """Tables by name under one folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, root: str, dimensions: int | None = None, buckets: int = 8):
        """``dimensions``: the length that vectors of chunks must have; a write of others fails. ``buckets``: of each table, for good."""
        self.spark, self.root, self.dimensions, self.buckets = spark, root.rstrip("/"), dimensions, buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, path: str) -> list[int]:
        """The numbers of the entries v1, v2, ... of a folder."""
        fs, top = self._fs(path)
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(x[1:]) for x in names if x.startswith("v") and x[1:].isdigit())

    def version(self, name: str) -> int:
        """The version that counts; 0 before the first write."""
        return max(self._versions(f"{self.root}/{name}/{MARKERS}"), default=0)

    def _parts(self, name: str, upto: int | None = None) -> list[int]:
        """The base that counts and the changes over it, in order; empty before the first write."""
        out = []
        for v in reversed([v for v in self._versions(f"{self.root}/{name}/{MARKERS}") if upto is None or v <= upto]):
            out.append(v)
            if not self._exists(f"{self.root}/{name}/v{v}/{CHANGE}"):
                break
        return out[::-1]

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(TABLES[name].columns)

    def read(self, name: str, only: Sequence[str] | None = None) -> DataFrame:
        """The table; an empty one before the first write. Columns that an older version lacks have their defaults.

        With ``only``, the rows whose bucket column has one of these values: their buckets alone are read.
        """
        spec, schema, parts = TABLES[name], self.schema(name), self._parts(name)
        if not parts:
            return self.spark.createDataFrame([], schema)
        wanted = [F.coalesce(f.name, F.lit(DEFAULTS[f.name])).alias(f.name) if f.name in DEFAULTS else F.col(f.name) for f in schema.fields]
        whole = StructType.fromDDL(f"{spec.columns}, _gone boolean, _bucket int")

        def version(v: int) -> DataFrame:
            return self.spark.read.schema(whole).parquet(f"{self.root}/{name}/v{v}")

        def mine(df: DataFrame) -> DataFrame:
            if only is None:
                return df
            numbers = sorted({xxhash.xxh64_intdigest(x.encode(), 42) for x in only})  # what xxhash64 gives, unsigned
            numbers = sorted({(n - (1 << 64) if n >> 63 else n) % self.buckets for n in numbers})
            return df.where((F.col("_bucket").isin(numbers) | F.col("_bucket").isNull()) & F.col(spec.bucket).isin(sorted(set(only))))

        base, *changes = parts
        rows = mine(version(base)).select(*wanted)
        if not changes:
            return rows
        laid = reduce(DataFrame.unionByName, [version(v).withColumn("_v", F.lit(v)) for v in changes])
        # tombstones of a group may lie in any bucket; they are as many as the changes have groups, which compaction bounds
        last = laid.groupBy(*spec.group).agg(F.max("_v").alias("_last"))
        new = mine(laid).where("not coalesce(_gone, false)").join(last, list(spec.group)).where("_v = _last")
        return rows.join(last, list(spec.group), "left_anti").select(*schema.names).unionByName(new.select(*wanted))

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value.cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, df: DataFrame, change: bool, files: int | None = None) -> int:
        top, spec = f"{self.root}/{name}", TABLES[name]
        v = max([*self._versions(top), *self._versions(f"{top}/{MARKERS}")], default=0) + 1
        laid = df.withColumn("_bucket", self._bucket(F.col(spec.bucket)))
        laid = laid.repartition(files or self.buckets, "_bucket") if not change else laid.coalesce(1) if files == 1 else laid
        laid.sortWithinPartitions("_bucket", spec.bucket).write.mode("error").partitionBy("_bucket").parquet(f"{top}/v{v}")
        if change:
            fs, p = self._fs(f"{top}/v{v}/{CHANGE}")
            fs.create(p, False).close()
        self._mark(name, v)
        return v

    def replace(self, name: str, df: DataFrame) -> int:
        """Write df as the next base and mark it."""
        return self._write(name, self._complete(name, df), False)

    def change(self, name: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """The groups of ``rows``, and those in ``gone``, lose their earlier rows, and rows come in: one version, as large as the two.

        Groups have no nulls. The first change of a table is its base.
        """
        spec, schema = TABLES[name], self.schema(name)
        new = self._complete(name, rows) if rows is not None else self.spark.createDataFrame([], schema)
        if not self.version(name):
            return self._write(name, new, False)
        new = new.withColumn("_gone", F.lit(False))
        if gone is not None:
            left = gone.select(*spec.group).distinct()
            new = new.unionByName(left.select(*[(F.col(f.name) if f.name in spec.group else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields], F.lit(True).alias("_gone")))
        v = self._write(name, new, True)
        self._fold(name)
        return v

    def _fold(self, name: str) -> None:
        """Compact a table that has many changes or large ones."""
        base, *changes = self._parts(name)
        large = len(changes) % 4 == 0 and sum(self.bytes_of(name, v) for v in changes) > max(MOST_SHARE * self.bytes_of(name, base), 1 << 20)  # looked at now and then
        if len(changes) > MOST_CHANGES or large:
            self.compact(name)
            self.vacuum(name, keep=2)

    def bytes_of(self, name: str, v: int) -> int:
        """Bytes on storage of a version."""
        fs, p = self._fs(f"{self.root}/{name}/v{v}")
        return int(fs.getContentSummary(p).getLength())

    def _complete(self, name: str, df: DataFrame, *extra: str) -> DataFrame:
        """The table's columns and the extra ones, missing ones by their defaults."""
        have = set(df.columns)
        cols = {f.name: (F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType) for f in self.schema(name).fields}
        if "vector" in cols and self.dimensions:
            v = cols["vector"]
            wrong = F.concat(F.lit(f"a vector must have {self.dimensions} values, one has "), F.size(v).cast("string"))
            cols["vector"] = F.when(v.isNull() | (F.size(v) == self.dimensions), v).otherwise(F.raise_error(wrong).cast("array<float>"))
        return df.select(*[c.alias(k) for k, c in cols.items()], *extra)

    def _mark(self, name: str, v: int) -> None:
        """Fails if another writer has marked that version."""
        fs, p = self._fs(f"{self.root}/{name}/{MARKERS}/v{v}")
        fs.create(p, False).close()

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> int:
        """Rows replace those of the same key; of several new ones the last by ``order`` wins."""
        spec = TABLES[name]
        keys = list(spec.key)
        rows = self._complete(name, rows, *([order] if order else []))
        if order:
            last = Window.partitionBy(*keys).orderBy(F.desc(order))
            rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)
        else:
            rows = rows.dropDuplicates(keys)
        if spec.key != spec.group and self.version(name):  # others of the group stay
            groups = rows.select(*spec.group).distinct()
            kept = self.read(name).join(groups, list(spec.group), "left_semi").join(rows.select(*keys), keys, "left_anti")
            rows = rows.unionByName(kept.select(rows.columns))
        return self.change(name, rows)

    def append(self, name: str, rows: DataFrame) -> int:
        """Rows are added as they are; the caller sees to keys."""
        spec = TABLES[name]
        rows = self._complete(name, rows)
        if self.version(name):
            rows = rows.unionByName(self.read(name).join(rows.select(*spec.group).distinct(), list(spec.group), "left_semi").select(rows.columns))
        return self.change(name, rows)

    def delete(self, name: str, gone: DataFrame) -> int:
        """Rows whose columns of ``gone`` match one of its rows go."""
        spec, there = TABLES[name], self.read(name)
        hit = there.join(gone.distinct(), gone.columns, "left_semi").select(*spec.group).distinct()
        kept = there.join(hit, list(spec.group), "left_semi").join(gone.distinct(), gone.columns, "left_anti") if set(gone.columns) - set(spec.group) else None
        return self.change(name, kept, hit)

    def replace_group(self, name: str, rows: DataFrame, by: str) -> int:
        """All rows of the groups in ``rows`` go, then rows come in; the two at once."""
        hit = self.read(name).join(rows.select(by).distinct(), by, "left_semi")
        return self.change(name, rows, hit)

    def compact(self, name: str, files: int | None = None) -> int:
        """The same rows as a new base, in so many tasks; as many as buckets by default."""
        return self._write(name, self.read(name), False, files)

    def recover(self, name: str) -> list[str]:
        """Remove versions that aren't marked: writes that died before that.

        Where no version is marked, the last one that was written to its end counts from now on, so the only whole copy of a
        table never goes.
        """
        top = f"{self.root}/{name}"
        found, marked = self._versions(top), set(self._versions(f"{top}/{MARKERS}"))
        if not marked:
            whole = [n for n in found if self._exists(f"{top}/v{n}/_SUCCESS")]
            if whole:
                self._mark(name, whole[-1])
                marked = {whole[-1]}
        return self._drop(name, [n for n in found if n not in marked])

    def vacuum(self, name: str, keep: int = 1) -> list[str]:
        """Remove versions that none of the last ``keep`` (at least 1) reads; the one that counts stays."""
        marked = self._versions(f"{self.root}/{name}/{MARKERS}")
        kept = marked[-max(1, keep) :]
        least = min(self._parts(name, kept[0])) if kept else 0
        return self._drop(name, [n for n in self._versions(f"{self.root}/{name}") if n < least])

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _drop(self, name: str, versions: list[int]) -> list[str]:
        """A marker goes before its folder, so nothing marked is ever incomplete."""
        for v in versions:
            for path in (f"{self.root}/{name}/{MARKERS}/v{v}", f"{self.root}/{name}/v{v}"):
                fs, p = self._fs(path)
                fs.delete(p, True)
        return [f"v{v}" for v in versions]

    def state(self, key: str, default: str | None = None) -> str | None:
        row = self.read("index_state").where(F.col("key") == key).first()
        return row["value"] if row else default

    def put_state(self, **values: str) -> int:
        return self.upsert("index_state", self.spark.createDataFrame(list(values.items()), "key string, value string"))
