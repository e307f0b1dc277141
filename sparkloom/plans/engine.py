"""The engine: builds and refreshes the index from source trees, answers the tools' questions, and reports on itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import embed, imports, nearest, overlay, references, reverse, search, summaries, symbols, tables
from ..operators.nearest import TREE
from ..operators.rounds import settle
from ..operators.store import TABLES, Store
from ..sources import documents, files, projects
from ..streaming import watch

SYMBOL_SCHEMA = "2"
#: Names that files which came or went may answer to, up to which their buckets alone are read.
MOST_KEYS = 2000
#: The files that steer how imports resolve.
STEERING = ("go.mod", "tsconfig.json", "jsconfig.json")


@dataclass
class Engine:
    """One index under ``root_dir``. ``now_ms`` and the embedder are arguments, so answers can be repeated."""

    spark: SparkSession
    root_dir: str
    config: projects.Config = field(default_factory=projects.Config)
    now_ms: int = 0
    samples: list[tuple[str, float, str, bool]] = field(default_factory=list)

    def __post_init__(self):
        self.embedder, self.warning = embed.provider(self.config.embedding, dimensions=self.config.dimensions)
        self.store = Store(self.spark, self.root_dir, self.embedder.dimensions)
        self.content: DataFrame | None = None
        self.commits: DataFrame | None = None

    def attach(self, content: DataFrame | None = None, commits: DataFrame | None = None) -> None:
        """Live files(path, content) and commits that questions read in place of those that the index holds."""
        self.content = content if content is not None else self.content
        self.commits = commits if commits is not None else self.commits

    # -- writing ----------------------------------------------------------------------------------------------------------

    def index(self, trees: DataFrame, head: DataFrame | None = None, commits: DataFrame | None = None) -> dict:
        """Bring the index up to files(worktree_id, repo_id, path, content_hash, language, content, ...); says what changed.

        Only what changed is scanned, embedded and written. Trees may hold different files at one path; imports resolve within
        their tree, by its own TypeScript projects and Go modules, and a chunk that several contents share belongs to each.
        A file that came or went has the files resolved again whose imports it can concern. With head(worktree_id, path,
        blob_hash), the last commits, files that differ from theirs are dirty ones over the tracked ones; trees that head doesn't
        have are tracked as they are. The newest of a file's modification and of the ``commits`` that name it is kept.
        """
        whole = self.store.state("symbol_schema") != SYMBOL_SCHEMA
        slim = [F.col(c) if c in trees.columns else F.lit(None).cast("timestamp").alias(c) for c in (TREE, "repo_id", "path", "content_hash", "language", "modified")]
        now = settle(trees.select(*slim))
        was = self.visible().select(TREE, "path", F.col("hash").alias("old"))
        both = now.select(TREE, "path", F.col("content_hash").alias("new")).join(was, [TREE, "path"], "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "same").otherwise("modified")
        diff = settle(both.withColumn("change", change).where(F.lit(True) if whole else F.col("change") != "same"))
        counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
        report = {k: counts.get(k, 0) for k in ("added", "modified", "deleted")}
        settings = P.extension(F.col("path")).isin("json") | (P.basename(F.col("path")) == "go.mod")
        facts = now.agg(F.count("*").alias("n"), F.count_if(settings).alias("settings")).first()
        report["same"] = facts["n"] - report["added"] - report["modified"]
        report_changes = sum(report[k] for k in ("added", "modified", "deleted"))
        if head is None and not whole and not self.store.version("dirty_files"):  # the tracked files are all there are, so the difference is known
            writes = [lambda: self.store.change("tree_entries", diff.where("new is not null").withColumnRenamed("new", "blob_hash"), diff.where("new is null"))] if report_changes else []
        else:
            writes = self._overlay(now, head)
        if commits is not None:
            writes.append(lambda: self.store.replace("commits", commits))
        if whole or report_changes:
            writes += self._contents(trees, now, diff, whole, report, facts["settings"] > 0) + [lambda: self._changed_at(now, diff, commits)]
        with ThreadPoolExecutor(max(1, len(writes))) as pool:
            for done in [pool.submit(w) for w in writes]:
                done.result()
        self._name_dirty()
        if writes:
            self.store.put_state(symbol_schema=SYMBOL_SCHEMA, indexed_at=str(self.now_ms))
        return report

    def _contents(self, trees: DataFrame, now: DataFrame, diff: DataFrame, whole: bool, report: dict, settings: bool) -> list[Callable]:
        """The writes of contents, chunks, symbols and edges that a diff(worktree_id, path, old, new, change) of the trees asks for."""
        store = self.store
        key = [TREE, "path"]
        changed = settle(trees.select(TREE, "repo_id", "path", "content_hash", "language", "content").join(diff.where("new is not null").select(*key), key, "left_semi"))
        known = store.read("blobs").select(F.col("blob_hash").alias("content_hash"))
        fresh = changed if whole else changed.join(known, "content_hash", "left_anti")
        holder = fresh.groupBy("content_hash").agg(F.min(F.struct(*key)).alias("h")).select("content_hash", "h.*")
        fresh = settle(fresh.join(holder, ["content_hash", *key], "left_semi"))
        langs = {r["language"] for r in changed.select("language").distinct().collect()}
        names = settle(_together(symbols.symbol_rows(_apart(changed), langs)))
        mine = names.join(fresh.select(*key), key, "left_semi")
        parts = _together(symbols.route_rows(_apart(fresh), _apart(mine))).join(fresh.select(*key, "repo_id", "language", "content_hash"), key)
        parts = settle(self.embedder.embed(symbols.chunk_ids(parts), "chunk"))
        posted = parts.select("chunk_id", F.col("content_hash").alias("blob_hash")).distinct()
        dead = orphans = None
        if whole or report["modified"] or report["deleted"]:  # contents that no file has any more, and chunks that no content has
            dead = settle(diff.where("old is not null").select(F.col("old").alias("blob_hash")).distinct().join(now.select(F.col("content_hash").alias("blob_hash")), "blob_hash", "left_anti"))
            stored = store.read("chunk_blobs")
            left = stored.join(dead, "blob_hash", "left_semi").select("chunk_id").distinct()
            held = stored.join(dead, "blob_hash", "left_anti").select("chunk_id").unionByName(posted.select("chunk_id"))
            orphans = left.join(held, "chunk_id", "left_anti").select(F.col("chunk_id").alias("id"))
        chunks = parts.dropDuplicates(["chunk_id"]).select(
            F.col("chunk_id").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("chunk").alias("content"), F.col("path").alias("file_path"), "start_line", "end_line",
            F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), "language", "repo_id", TREE,
        )
        ids = fresh.select(F.col("content_hash").alias("blob_hash")).join(posted.groupBy("blob_hash").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids")), "blob_hash", "left")
        ids = ids.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
        touched = diff.select(TREE, F.col("path").alias("file_path"))
        both = symbols.merged_symbols(_apart(symbols.chunk_ids(names)), symbols.extracted_symbols(_apart(changed), langs))
        named = _together(both).join(changed.select(*key, "repo_id"), key).withColumnRenamed("path", "file_path")
        writes = [
            lambda: store.change("contents", fresh.select(F.col("content_hash").alias("blob_hash"), "content"), dead),
            lambda: store.change("chunks", chunks, orphans),
            lambda: store.change("chunk_blobs", posted, dead),
            lambda: store.change("blobs", ids, dead),
            lambda: store.change("symbols", named, touched),
        ]
        todo, edges, configs = self._resolved(changed, now, diff, whole, langs, report, settings)
        again = todo.select(TREE, F.col("path").alias("source_file")).unionByName(touched.withColumnRenamed("file_path", "source_file")).distinct()
        writes.append(lambda: store.change("import_edges", edges, again))
        writes.append(lambda: store.change("import_keys", reverse.import_keys(edges, configs, self.config.import_aliases), again))
        return writes

    def _resolved(self, changed: DataFrame, now: DataFrame, diff: DataFrame, whole: bool, langs: set[str], report: dict, settings: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """The files whose imports are resolved again, their edges, and the trees' TypeScript projects.

        ``langs`` are the languages of the changed files; the plans of others aren't made. ``settings`` says whether any tree has
        files that may be a project's.
        """
        key = [TREE, "path"]
        todo = changed.select(*key, "language", "content")
        texts = todo.select(*key, "content").limit(0)
        if settings:
            texts = self._settings(changed, now)
        if not whole and self.store.version("import_keys") and (settings or report["added"] or report["deleted"]):
            again = self._again(changed, now, diff, report, settings)
            more = {r["language"] for r in again.select("language").distinct().collect()}
            if more:
                old, langs = self.store.read("contents").withColumnRenamed("blob_hash", "content_hash"), langs | more
                todo = settle(todo.unionByName(again.join(old, "content_hash").select(*key, "language", "content")))
        configs = settle(nearest.ts_configs(texts)) if settings else nearest.given_configs(now.limit(0), [])
        scans = []
        if langs & {"python", "text"}:  # stubs have no language of their own
            scans.append(imports.python_edges(todo, self.config.import_aliases, now))
        if langs & {"typescript", "javascript", "text"}:
            scans.append(imports.ts_edges(todo, configs, now))
        if langs & {"go", *imports.LINE_IMPORTS}:
            scans.append(imports.other_edges(todo, nearest.go_modules(texts)))
        edges = reduce(DataFrame.unionByName, [x.drop("conditional") for x in scans]) if scans else self.store.read("import_edges").limit(0)
        return todo, settle(edges), configs if langs & {"typescript", "javascript", "text"} else None

    def _settings(self, changed: DataFrame, now: DataFrame) -> DataFrame:
        """(worktree_id, path, content) of the trees' go.mod files and TypeScript configurations."""
        key = [TREE, "path"]
        named = now.where(P.extension(F.col("path")).isin("json") | (P.basename(F.col("path")) == "go.mod"))
        texts = self.store.read("contents").withColumnRenamed("blob_hash", "content_hash").join(named.select("content_hash").distinct(), "content_hash", "left_semi")
        texts = texts.unionByName(changed.join(named.select(*key), key, "left_semi").select("content_hash", "content")).dropDuplicates(["content_hash"])
        steering = P.basename(F.col("path")).isin(*STEERING) | F.contains("content", F.lit("compilerOptions"))
        return settle(named.join(texts, "content_hash").where(steering).select(*key, "content"))

    def _again(self, changed: DataFrame, now: DataFrame, diff: DataFrame, report: dict, settings: bool) -> DataFrame:
        """The unchanged files whose imports may resolve otherwise: those that asked for a file that came or went, and all of a tree whose settings changed."""
        key = [TREE, "path"]
        again = now.select(*key).limit(0)
        if report["added"] or report["deleted"]:
            moved = settle(diff.where("change in ('added', 'deleted')").select(*key))
            wanted = [r["key"] for r in reverse.answers(moved).select("key").distinct().limit(MOST_KEYS + 1).collect()]
            again = reverse.concerned(self.store.read("import_keys", wanted if len(wanted) <= MOST_KEYS else None), moved)
        lost = F.col("new").isNull() & (P.extension(F.col("path")) == "json")  # it may have been one that others extend
        steered = diff.where(P.basename(F.col("path")).isin(*STEERING) | lost).select(TREE)
        if settings:
            steered = steered.unionByName(changed.where((P.extension(F.col("path")) == "json") & F.contains("content", F.lit("compilerOptions"))).select(TREE))
        again = again.unionByName(now.join(steered.distinct(), TREE, "left_semi").select(*key)).distinct()
        return settle(now.join(again, key, "left_semi").join(changed.select(*key), key, "left_anti").select(*key, "language", "content_hash"))

    def _overlay(self, now: DataFrame, head: DataFrame | None) -> list[Callable]:
        """The writes that bring the tracked and the dirty files to what they are now; those that are the same stay as they are."""
        tree, dirty = _over_head(now, head)
        out = []
        for name, rows, h in (("tree_entries", tree, "blob_hash"), ("dirty_files", dirty, "content_hash")):
            old = self.store.read(name).select(TREE, "path", F.col(h).alias("old"))
            both = rows.select(TREE, "path", h).join(old, [TREE, "path"], "full")
            both = settle(both.where(~F.col(h).eqNullSafe(F.col("old"))))
            if not both.isEmpty():
                out.append(lambda name=name, both=both, h=h: self.store.change(name, both.where(F.col(h).isNotNull()).drop("old"), both.where(F.col(h).isNull())))
        return out

    def _name_dirty(self) -> None:
        """Dirty files name the chunks of their content; those that don't yet get them."""
        unnamed = self.store.read("dirty_files").where("chunk_ids is null")
        if not unnamed.isEmpty():
            ids = self.store.read("blobs").withColumnRenamed("blob_hash", "content_hash")
            self.store.change("dirty_files", settle(unnamed.drop("chunk_ids").join(ids, "content_hash", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))))

    def _changed_at(self, now: DataFrame, diff: DataFrame, commits: DataFrame | None) -> int:
        rows = now.select(TREE, "repo_id", "path", "modified")
        if commits is None:
            rows = rows.join(diff.select(TREE, "path"), [TREE, "path"], "left_semi")
        else:
            said = tables.last_changes(commits).withColumnRenamed("modified", "committed")
            rows = rows.join(said, ["repo_id", "path"], "left").withColumn("modified", F.greatest("modified", "committed"))
        return self.store.change("changed_at", rows.where("modified is not null"), diff.where("new is null"))

    def index_docs(self, pages: DataFrame) -> int:
        """Replace the chunks of the pages(url, content_type, body) given; others stay."""
        return self.store.replace_group("docs_chunks", documents.chunked(documents.readable(pages)), "url")

    # -- questions --------------------------------------------------------------------------------------------------------

    def visible(self, worktree_id: str | None = None) -> DataFrame:
        """(worktree_id, path, hash, place) of the files that can be seen, in one tree or in all."""
        tree, dirty = self.store.read("tree_entries"), self.store.read("dirty_files")
        if worktree_id:
            tree, dirty = (t.where(F.col(TREE) == worktree_id) for t in (tree, dirty))
        both = overlay.visible_files(_keyed(tree, "blob_hash"), _keyed(dirty, "content_hash"))
        own, path = F.substring_index("path", "\x1f", 1), F.substring_index("path", "\x1f", -1)
        return both.select(own.alias(TREE), path.alias("path"), "hash", F.struct("place.dirty_only", path.alias("path"), F.col("path").alias("key")).alias("place"))

    def files(self, worktree_id: str | None = None, paths: DataFrame | None = None) -> DataFrame:
        """(path, content, language) of the files that can be seen, with ``paths`` of those alone; from what is attached, else from the index."""
        if self.content is not None:
            rows = self.content.join(paths, "path", "left_semi") if paths is not None else self.content
            return rows.select("path", "content", P.language(F.col("path")).alias("language"))
        if not self.store.version("contents"):
            raise ValueError("no files are indexed or attached")
        seen = self.visible(worktree_id)
        seen = seen.join(paths, "path", "left_semi") if paths is not None else seen
        return seen.join(self.store.read("contents").withColumnRenamed("blob_hash", "hash"), "hash").select("path", "content", P.language(F.col("path")).alias("language"))

    def semantic_search(self, query: str, limit: int = 10, worktree_id: str | None = None, **filters) -> DataFrame:
        """Keys and vectors are scanned; what else a chunk has is read for the nearest alone, from their buckets."""
        vector = embed._hashed(query, self.embedder.dimensions).tolist() if isinstance(self.embedder, embed.HashEmbedder) else self.embedder.embed(self.spark.createDataFrame([(query,)], "q string"), "q").first()["vector"]
        wanted = search.knn(self.store.read("chunks").select("id", "vector"), vector, max(100, 10 * max(1, limit)), "id").select("id")
        ids = [r["id"] for r in wanted.collect()] if query.strip() else []  # at most ten for each result
        chunks = self.store.read("chunks", ids).withColumnsRenamed({"id": "chunk_id", "file_path": "path"})
        at = self.store.read("changed_at").groupBy("path").agg(F.max("modified").alias("modified")) if not worktree_id else self.store.read("changed_at").where(F.col(TREE) == worktree_id).select("path", "modified")
        chunks = chunks.join(at, "path", "left")
        return search.semantic_search(chunks, query, vector, limit, self.now_ms, self.visible(worktree_id), self.store.read("chunk_blobs", ids), **filters)

    def find_files(self, pattern: str, limit: int = 200, worktree_id: str | None = None) -> DataFrame:
        return self.visible(worktree_id).where(P.matches(F.col("path"), pattern)).select("path").distinct().orderBy("path").limit(limit)

    def get_symbols(self, worktree_id: str | None = None, **arguments) -> DataFrame:
        return tables.get_symbols(self._of("symbols", worktree_id), **arguments)

    def search_docs(self, query: str, limit: int = 10) -> DataFrame:
        return tables.search_docs(self.store.read("docs_chunks"), query, limit)

    def get_recent_changes(self, commits: DataFrame | None = None, query: str | None = None, limit: int = 20, since: str | None = None) -> DataFrame:
        """Of the commits given, else of those attached or indexed; ``since`` is a date or time in ISO 8601 and counts before any limit."""
        commits = commits if commits is not None else self.commits if self.commits is not None else self.store.read("commits")
        if since:
            start = datetime.fromisoformat(since)
            commits = commits.where(F.col("ts") >= F.timestamp_micros(F.lit(int((start if start.tzinfo else start.replace(tzinfo=timezone.utc)).timestamp() * 1e6))))
        return tables.recent_commits(commits, query, limit, self.config.most_commits)

    def get_dependencies(self, path: str, recursive: bool = True, most_files: int = 50, worktree_id: str | None = None) -> DataFrame:
        """A file's dependencies by group, or those of each file in a folder."""
        path = P.jailed(path, self.config.roots)
        start = time.monotonic()
        is_file = not self._of("tree_entries", worktree_id, [path]).isEmpty() or not self._of("dirty_files", worktree_id, [path]).isEmpty()
        edges = self._edges(worktree_id, [path] if is_file else None)
        out = imports.dependency_groups(edges) if is_file else imports.directory_dependencies(edges, path, recursive, most_files)
        self._record("get_dependencies", start, "edges", False)
        return out

    def _postings(self, worktree_id: str | None) -> reverse.Read:
        return lambda keys: self._of("import_keys", worktree_id, keys)

    def find_importers(self, target: str, limit: int = 100, worktree_id: str | None = None) -> tuple[DataFrame, int]:
        """From the postings of the target's spellings; no edge of another target is read."""
        start = time.monotonic()
        out = reverse.find_importers(self._postings(worktree_id), target, self.config.include_self, self.config.importer_excludes, limit)
        self._record("find_importers", start, "postings", False)
        return out

    def suggest(self, path: str, worktree_id: str | None = None) -> DataFrame:
        """Files that a path which isn't there may have meant."""
        return imports.suggest_paths(self.visible(worktree_id), path)

    def find_references(self, content: DataFrame | None, symbol: str, anchor: str | None = None, limit: int = 50, worktree_id: str | None = None, **options) -> tuple[DataFrame, dict]:
        """Over files(path, content), else over those attached or indexed.

        With an anchor in Python, only that file and its importers are read; the report's ``files`` says how many.
        """
        start = time.monotonic()
        python = (anchor or "").endswith((".py", ".pyi"))
        if content is None and python:
            users = reverse.postings(self._postings(worktree_id), anchor)
            paths = settle(references.candidate_files(self.visible(worktree_id), anchor, users).select("path").distinct())
            content, scanned = self.files(worktree_id, paths), paths.count()
        else:
            content, scanned = content if content is not None else self.files(worktree_id), None
        edges = self._edges(worktree_id) if anchor and not python else None
        rows, note = references.find_references(content, symbol, anchor, edges, self._of("symbols", worktree_id), limit, **options)
        self._record("find_references", start, note["actual"], note["actual"] == "heuristic")
        return rows, note | {"files": scanned}

    def in_context(self, rows: DataFrame, n: int = 2, worktree_id: str | None = None) -> DataFrame:
        """References with the n lines around each."""
        return references.with_context(rows, self.files(worktree_id, rows.select("path").distinct()), n)

    def _of(self, name: str, worktree_id: str | None, only: Sequence[str] | None = None) -> DataFrame:
        rows = self.store.read(name, only)
        return rows.where(F.col(TREE) == worktree_id) if worktree_id else rows

    def _edges(self, worktree_id: str | None = None, only: Sequence[str] | None = None) -> DataFrame:
        return self._of("import_edges", worktree_id, only).withColumn("conditional", F.contains(F.coalesce("unresolved_reason", F.lit("")), F.lit("in a condition")))

    def _record(self, tool: str, start: float, backend: str, fallback: bool) -> None:
        self.samples = [*self.samples, (tool, (time.monotonic() - start) * 1000, backend, fallback)][-200:]

    def file_summary(self, path: str, content: str | None = None, worktree_id: str | None = None) -> dict:
        """State, chunks, symbols, imports, leading comment and package of one file; one that isn't indexed is described by its content alone."""
        path = P.jailed(path, self.config.roots)
        tracked, dirty = (self._of(n, worktree_id, [path]).orderBy(TREE).first() for n in ("tree_entries", "dirty_files"))
        blob = dirty["content_hash"] if dirty else tracked["blob_hash"] if tracked else None
        held = self.store.read("blobs", [blob]).first() if blob else None
        n_chunks = len(held["chunk_ids"]) if held else 0
        names = self._of("symbols", worktree_id, [path]).orderBy("start_line", "name").limit(8).collect()
        edges = self._edges(worktree_id, [path]).select("raw_specifier").distinct().orderBy("raw_specifier").limit(8).collect()
        if content is None and blob:
            row = self.store.read("contents", [blob]).first()
            content = row["content"] if row else None
        state = index_state(tracked is not None, dirty is not None, n_chunks > 0, bool(names))
        told = {"doc": None, "package": None}
        if content is not None:
            one = self.spark.createDataFrame([(path, content)], "path string, content string")
            told = summaries.described(one).first().asDict()
        return {"path": path, "state": state, "chunks": n_chunks, "symbols": [f"{r['kind']} {r['name']}:{r['start_line']}" for r in names], "imports": [r[0] for r in edges], "lines": len(content.split("\n")) if content else None, "doc": told["doc"], "package": told["package"]}

    def status(self) -> dict:
        """Counts, the graph's rates, latencies and backend shares of the last samples, and what can't be offered here."""
        tree = self.store.read("tree_entries").select("path", P.language(F.col("path")).alias("language"))
        langs = {r["language"]: r["n"] for r in tables.language_counts(tree).orderBy(F.desc("n"), "language").collect()}
        graph = imports.graph_stats(self._edges()).first().asDict()
        timing = {}
        if self.samples:
            df = self.spark.createDataFrame([(i, *s) for i, s in enumerate(self.samples)], "n long, tool string, ms double, backend string, fallback boolean")
            timing = {r["tool"]: {"n": r["n"], "p50": r["p50"], "p95": r["p95"]} for r in tables.latency_percentiles(df, "tool", "n", "ms").collect()}
        n = len(self.samples)
        return {
            "files": sum(langs.values()), "languages": langs, "chunks": self.store.read("chunks").count(), "symbols": self.store.read("symbols").count(), "graph": graph, "latency": timing,
            "fallback_rate": sum(s[3] for s in self.samples) / n if n else 0.0, "warning": self.warning, "capabilities": {"semantic_references": False, "embedding": self.config.embedding},
        }

    def doctor(self, fix: bool = False) -> dict:
        """Ids that blobs name and chunks lack, and the other way round; with ``fix`` half-written versions and orphans go."""
        chunks = self.store.read("chunks")
        missing, orphan = overlay.consistency(chunks, overlay.referenced_ids(self.store.read("blobs"), self.store.read("dirty_files")))
        report = {"missing": missing.count(), "orphan": orphan.count(), "removed": []}
        if fix:
            if report["orphan"]:
                self.store.delete("chunks", orphan)
            for name in TABLES:
                report["removed"] += [f"{name}/{v}" for v in self.store.recover(name)]
        return report


def _keyed(rows: DataFrame, h: str) -> DataFrame:
    """(path, hash) with the working tree before the path, so that trees don't meet."""
    return rows.select(F.concat_ws("\x1f", "worktree_id", "path").alias("path"), h)


def _over_head(trees: DataFrame, head: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The tracked tree_entries(worktree_id, path, blob_hash) and the dirty(worktree_id, path, content_hash) of files over head."""
    key = ["worktree_id", "path"]
    files_now = trees.select(*key, "content_hash")
    if head is None:
        return files_now.withColumnRenamed("content_hash", "blob_hash"), files_now.limit(0)
    ours = head.select("worktree_id").distinct()
    there = head.select(*key, "blob_hash").join(files_now.select(*key), key, "left_semi")  # a tracked file that is gone can't be seen
    tracked = there.unionByName(files_now.join(ours, "worktree_id", "left_anti").withColumnRenamed("content_hash", "blob_hash"))
    changed = files_now.join(ours, "worktree_id", "left_semi").join(head.select(*key, F.col("blob_hash").alias("content_hash")), [*key, "content_hash"], "left_anti")
    return tracked, changed


def _apart(files: DataFrame) -> DataFrame:
    """Files under paths with their tree in front, so that equal paths of two trees are two files to a scanner."""
    return files.withColumn("path", F.concat_ws("\x1f", TREE, "path"))


def _together(rows: DataFrame) -> DataFrame:
    """Rows of a scanner under their own paths, with the tree beside them."""
    return rows.withColumns({TREE: F.substring_index("path", "\x1f", 1), "path": F.substring_index("path", "\x1f", -1)})


def index_state(tracked: bool, dirty: bool, has_chunks: bool, has_symbols: bool) -> str:
    if dirty:
        return "dirty-overlay" if has_chunks and has_symbols else "dirty-overlay-incomplete" if has_chunks or has_symbols else "dirty-overlay-unstructured"
    if tracked:
        return "indexed" if has_chunks and has_symbols else "indexed-incomplete" if has_chunks or has_symbols else "manifest-only"
    return "live-file-not-indexed"


def bake_off(evaluate, candidates: dict[str, dict]) -> list[tuple[str, dict]]:
    """Candidates by what ``evaluate(options)`` measures, best first: by mrr, then ndcg, then name. One that fails has an error."""
    out = []
    for name, options in candidates.items():
        try:
            out.append((name, evaluate(options)))
        except Exception as e:  # one that can't be loaded mustn't end the comparison
            out.append((name, {"error": str(e)}))
    return sorted(out, key=lambda x: (-x[1].get("mrr", -1), -x[1].get("ndcg", -1), x[0]))


def scan_roots(spark: SparkSession, roots: list[str], config: projects.Config) -> DataFrame:
    """All files of the roots with their repository and working tree."""
    out = None
    for root in roots:
        info = files.worktree_info(root) or {"repo_id": "", "worktree_id": f"root:{root}"}
        df = files.scan_files(spark, root, config.include, config.exclude, info["repo_id"], info["worktree_id"])
        out = df if out is None else out.unionByName(df)
    return out


def head_trees(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The last commits' tree_entries of the roots that are in a repository."""
    known = [(root, info["worktree_id"]) for root in roots if (info := files.worktree_info(root))]
    empty = spark.createDataFrame([], "worktree_id string, path string, blob_hash string")
    return reduce(DataFrame.unionByName, [files.head_tree(spark, *x) for x in known], empty)


def histories(spark: SparkSession, roots: list[str], most: int) -> DataFrame | None:
    """The newest commits of the roots that are in a repository; None if none is."""
    known = [files.git_history(spark, root, most) for root in roots if files.worktree_info(root)]
    return reduce(DataFrame.unionByName, known) if known else None


def watched(engine: Engine, roots: list[str], checkpoint: str, poll_ms: int = watch.POLL_MS, quiet_ms: int = watch.DEBOUNCE_MS) -> watch.Watcher:
    """A watcher that brings the index up to the roots after each batch of changes; the caller starts and stops it."""

    def refresh(changes) -> None:
        engine.index(scan_roots(engine.spark, roots, engine.config), head_trees(engine.spark, roots), histories(engine.spark, roots, engine.config.most_commits) if engine.config.history else None)

    return watch.Watcher(engine.spark, roots, refresh, checkpoint, poll_ms, quiet_ms)
