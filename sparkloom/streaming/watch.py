"""Watching file trees: snapshot differences, coalescing and debouncing, as batch operators and as a stateful stream."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import IGNORED
from ..operators.rounds import settle

POLL_MS, DEBOUNCE_MS = 750, 250
LEAST_POLL_MS, LEAST_DEBOUNCE_MS = 50, 25


def snapshot_changes(snapshots: DataFrame, path: str, poll: str, signature: str) -> DataFrame:
    """(path, poll, kind) between successive full snapshots(path, poll, signature): added, modified or deleted.

    The first poll only sets the scene. Polls are numbered once, so a path is compared with its own last sight alone. A null
    poll is the last one, and what it lists isn't known.
    """
    # numbered within ranges of polls; only the ranges' sizes, a row each, are summed in one task
    ranges = int(snapshots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(poll).asc_nulls_last()
    polls = settle(snapshots.select(poll).distinct().repartitionByRange(ranges, order).withColumn("_part", F.spark_partition_id()))
    sizes = polls.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    numbers = polls.withColumn("_within", within).join(F.broadcast(before), "_part").select(poll, (F.col("_within") + F.col("_before")).alias("_n"))
    w = Window.partitionBy(path).orderBy("_n")
    rows = snapshots.join(numbers, poll).select("*", F.lag("_n").over(w).alias("_was"), F.lag(signature).over(w).alias("_old"), F.lead("_n").over(w).alias("_next"))
    fresh = F.col("_was").isNull() | (F.col("_was") < F.col("_n") - 1)
    seen = rows.where((F.col("_n") > 1) & (fresh | (F.col("_old") != F.col(signature)))).select(path, poll, F.when(fresh, "added").otherwise("modified").alias("kind"))
    left = rows.where(F.col("_next").isNull() | (F.col("_next") > F.col("_n") + 1)).select(path, (F.col("_n") + 1).alias("_n"))
    gone = left.join(numbers, "_n").select(path, poll, F.lit("deleted").alias("kind"))
    return seen.unionByName(gone)


def coalesce_changes(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest kind of each key."""
    return changes.groupBy(*key).agg(F.max_by("kind", F.struct(*order)).alias("kind"))


def debounced_batches(changes: DataFrame, root: str, ts: str, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(root, started, ended, n): runs of changes with less than ``quiet_ms`` between one and the next."""
    quiet = max(LEAST_DEBOUNCE_MS, quiet_ms)
    rows = changes.groupBy(root, F.session_window(ts, f"{quiet} milliseconds").alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))
    return rows.drop("w")


def scan_tree(roots: list[str]) -> Iterator[tuple[str, str, str]]:
    """(root, path, signature) of every regular file; links and ignored names are left out."""
    for root in roots:
        for folder, names, files in os.walk(root):
            names[:] = sorted(x for x in names if x not in IGNORED and not os.path.islink(os.path.join(folder, x)))
            for f in sorted(files):
                full = os.path.join(folder, f)
                if f in IGNORED or os.path.islink(full):
                    continue
                try:
                    s = os.stat(full)
                except OSError:  # gone meanwhile
                    continue
                yield root, os.path.relpath(full, root).replace(os.sep, "/"), f"{s.st_mtime_ns}:{s.st_size}"


class TreeSource(DataSource):
    """A stream of full snapshots: ``spark.readStream.format("tree_poll").option("roots", "a;b")``."""

    @classmethod
    def name(cls) -> str:
        return "tree_poll"

    def schema(self) -> str:
        return "poll long, root string, path string, signature string"

    def simpleStreamReader(self, schema):
        return TreeReader(self.options["roots"].split(";"))


class TreeReader(SimpleDataSourceStreamReader):
    """Each read walks the roots once. A row without a path marks a poll of a root, so that deletions show even in empty trees."""

    def __init__(self, roots: list[str]):
        self.roots, self.kept = roots, {}

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def read(self, start: dict):
        poll = start["poll"] + 1
        rows = [(poll, r, "", "") for r in self.roots] + [(poll, *x) for x in scan_tree(self.roots)]
        self.kept = {k: v for k, v in self.kept.items() if k >= poll - 4} | {poll: rows}
        return iter(rows), {"poll": poll}

    def readBetweenOffsets(self, start: dict, end: dict):
        for poll in range(start["poll"] + 1, end["poll"] + 1):
            yield from self.kept.get(poll) or [(poll, r, "", "") for r in self.roots] + [(poll, *x) for x in scan_tree(self.roots)]


class TreeDiff(StatefulProcessor):
    """Keyed by root: keeps each path's signature and gives out what a poll changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "path string", "signature string")
        self.polls = handle.getValueState("polls", "poll long")

    def handleInputRows(self, key, rows, timerValues):
        frames = list(rows)
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        out = []
        for poll in sorted(pdf["poll"].unique()):
            now = {p: s for p, s in zip(*(pdf.loc[pdf["poll"] == poll, c] for c in ("path", "signature"))) if p}
            first = not self.polls.exists()
            before = {} if first else {k[0]: v[0] for k, v in self.known.iterator()}
            if not first:
                kinds = {p: "added" if p not in before else "modified" for p, s in now.items() if before.get(p) != s} | {p: "deleted" for p in before if p not in now}
                out += [(int(poll), key[0], p, kinds[p]) for p in sorted(kinds)]
            for p in before.keys() - now.keys():
                self.known.removeKey((p,))
            for p, s in now.items():
                if before.get(p) != s:
                    self.known.updateValue((p,), (s,))
            self.polls.update((int(poll),))
        yield pd.DataFrame(out, columns=["poll", "root", "path", "kind"])

    def close(self) -> None:
        pass


def stream_changes(snapshots: DataFrame) -> DataFrame:
    """(poll, root, path, kind) from a stream of full snapshots(poll, root, path, signature); needs the RocksDB state store."""
    return snapshots.groupBy("root").transformWithStateInPandas(TreeDiff(), "poll long, root string, path string, kind string", "append", "None")


class Watcher:
    """Runs ``on_batch(changes)`` for each batch of changes, one at a time, sorted by path; start and stop may be called again.

    A batch ends once ``quiet_ms`` have passed without a change, looked at after each poll; of several changes of a path the
    last counts. What waits when the watcher stops is given out then.
    """

    def __init__(self, spark: SparkSession, roots: list[str], on_batch: Callable[[list[tuple[str, str, str]]], None], checkpoint: str, poll_ms: int = POLL_MS, quiet_ms: int = DEBOUNCE_MS):
        self.spark, self.roots, self.on_batch, self.checkpoint, self.query = spark, roots, on_batch, checkpoint, None
        self.poll_ms, self.quiet_ms = max(LEAST_POLL_MS, poll_ms), max(LEAST_DEBOUNCE_MS, quiet_ms)
        self.waiting, self.changed = {}, 0.0

    def start(self) -> None:
        if self.query is not None and self.query.isActive:
            return
        self.spark.dataSource.register(TreeSource)
        rows = self.spark.readStream.format("tree_poll").option("roots", ";".join(self.roots)).load()

        self.query = stream_changes(rows).writeStream.foreachBatch(lambda df, _: self.polled(df)).option("checkpointLocation", self.checkpoint).trigger(processingTime=f"{self.poll_ms} milliseconds").start()

    def polled(self, changes: DataFrame) -> None:
        """Take in what a poll changed, and give out what waits after a poll without changes and enough quiet."""
        found = coalesce_changes(changes, ["root", "path"], ["poll"]).select("root", "path", "kind").collect()  # one poll's changes
        self.waiting |= {(r["root"], r["path"]): r["kind"] for r in found}
        if found:
            self.changed = time.monotonic()
        elif time.monotonic() - self.changed >= self.quiet_ms / 1000:
            self._give_out()

    def _give_out(self) -> None:
        if self.waiting:
            batch, self.waiting = sorted(((*k, kind) for k, kind in self.waiting.items()), key=lambda x: (x[1], x[0])), {}
            self.on_batch(batch)

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
            self._give_out()
