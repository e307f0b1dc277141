"""The import graph from its targets' side: posting lists from every name that an import may answer to, to the files that import it.

A lookup reads the buckets of its own keys. The same lists say which files a new or a removed file can concern, so that
only those are resolved again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .imports import TS_EXTENSIONS, TS_VARIANTS, module_of
from .nearest import TREE, candidates, scoped

#: What a key is: the target of an edge, its specifier, a tail of the target, or a module or path that was tried for it.
KINDS = ("target", "spec", "suffix", "module", "path")
_JS = r"\.(m|c)?jsx?$"


def tails(path: Column) -> Column:
    """The proper tails of a path, each from a slash on."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))


def tried_modules(aliases: dict[str, str]) -> Column:
    """The absolute modules that a Python edge's names may stand for, by its own name and by aliases; path hints only put more in front."""
    package = F.filter(F.split(F.regexp_replace("source_file", r"(^|/)[^/]+$", ""), "/"), lambda x: x != "")
    base = F.array_join(F.slice(package, 1, F.greatest(F.size(package) - (F.col("level") - 1), F.lit(0))), ".")
    bare = F.regexp_replace("raw_specifier", r"^\.+", "")
    full = F.when(F.col("level") > 0, F.concat_ws(".", F.when(base != "", base), F.when(bare != "", bare))).otherwise(bare)
    every = F.concat(F.array(full), F.transform(F.filter(F.coalesce("imported_names", F.array()), lambda n: n != "*"), lambda n: F.concat_ws(".", F.when(full != "", full), n)))
    for old, new in sorted(aliases.items()):
        every = F.concat(every, F.array_compact(F.transform(every, _renamed(old, new))))
    return every


def _renamed(old: str, new: str) -> Callable[[Column], Column]:
    return lambda m: F.when((m == old) | m.startswith(old + "."), F.concat(F.lit(new), F.substring(m, F.lit(len(old) + 1), F.length(m))))


def import_keys(edges: DataFrame, configs: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """(key, kind, worktree_id, source_file, raw_specifier): the postings of edges. ``configs`` are the trees' TypeScript projects."""
    edges = scoped(edges)
    kind = lambda k, x: F.transform(x, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("key")))
    target = F.array_compact(F.array("resolved_target"))
    folder = F.when(F.col("resolved_target").startswith("pkg:"), F.array().cast("array<string>")).otherwise(F.coalesce(tails(F.col("resolved_target")), F.array().cast("array<string>")))
    modules = F.when(F.col("lang") == "python", tried_modules(aliases or {})).otherwise(F.array().cast("array<string>"))
    every = F.concat(kind("target", target), kind("spec", F.array("raw_specifier")), kind("suffix", folder), kind("module", modules))
    own = [TREE, "source_file", "raw_specifier"]
    out = edges.select(*own, F.explode(every).alias("k")).select("k.key", "k.kind", *own)
    if configs is not None:
        specs = edges.where("lang = 'typescript'").select(TREE, F.col("source_file").alias("path"), F.col("raw_specifier").alias("spec")).distinct()
        tried = candidates(specs, configs).select(F.explode(F.array_distinct(F.array("candidate", F.regexp_replace("candidate", _JS, "")))).alias("key"), F.lit("path").alias("kind"), TREE, F.col("path").alias("source_file"), F.col("spec").alias("raw_specifier"))
        out = out.unionByName(tried)
    return out.where("key <> ''").distinct()


def spellings(target: str) -> tuple[set[str], set[str]]:
    """The names that a path, module or package may go by in an edge, and its proper tails."""
    stem = re.sub(r"\.[A-Za-z0-9]+$", "", target)
    names = {target, stem, module_of(target), module_of(target).removeprefix("src."), f"pkg:{target}", re.sub(r"/(index|__init__)$", "", stem)}
    parts = target.split("/")
    return names, {"/".join(parts[n:]) for n in range(1, len(parts))}


Read = Callable[[Sequence[str]], DataFrame]


def postings(read: Read, target: str) -> DataFrame:
    """(worktree_id, source_file, raw_specifier, kind) of the edges that lead to a target, or name it: what the scan of all edges finds."""
    names, ends = spellings(target)
    rows = read([*names, *ends])
    hit = F.col("kind").isin("target", "spec") & F.col("key").isin(*names) | (F.col("kind") == "suffix") & (F.col("key") == target)
    if ends:
        hit = hit | (F.col("kind") == "target") & F.col("key").isin(*ends)
    return rows.where(hit)


def find_importers(read: Read, target: str, include_self: bool = False, excluded: tuple[str, ...] = (".md", ".txt", ".rst"), limit: int = 100) -> tuple[DataFrame, int]:
    """``imports.find_importers`` from the postings; ``read`` gives those of some keys."""
    rows = postings(read, target)
    if not include_self:
        rows = rows.where(F.col("source_file") != target)
    for ext in excluded:
        rows = rows.where(~F.lower("source_file").endswith(ext))
    rows = rows.groupBy("source_file").agg(F.min("raw_specifier").alias("via"))
    return rows.orderBy("source_file").limit(max(1, limit)), rows.count()


def ranked_importers(read: Read, variants: list[str]) -> DataFrame:
    """Importers of the first of several spellings that has any."""
    rank = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("key"))
    rows = read(variants).where((F.col("kind") == "target") & F.col("key").isin(*variants)).withColumn("k", rank)
    first = rows.agg(F.min("k").alias("k"))
    return rows.join(F.broadcast(first), "k").select("source_file", F.col("key").alias("resolved_target")).distinct()  # one row


#: Which way an importer was found, in order of trust.
BACKENDS = ("python-graph", "typescript-graph", "graph", "namespace", "static")


def importers_by_backend(edges: DataFrame, target: str) -> DataFrame:
    """(source_file, backend, backends): the union of what the graphs, namespaces and the specifiers themselves say about a target's importers.

    A graph edge leads to the target, or to a path of which one is the tail of the other. A namespace edge is a Python import
    of a folder above the target. A static one only names it, whatever it was resolved to. ``backend`` is the first of
    BACKENDS that knows the importer, ``backends`` all of them in that order. The target itself isn't among them.
    """
    names, _ = spellings(target)
    resolved = F.col("resolved_target")
    graph = F.coalesce(resolved.isin(*names) | P.same_or_suffix(resolved, F.lit(target)), F.lit(False))
    above = [target.rsplit("/", n)[0] for n in range(1, target.count("/") + 1)]
    space = (F.col("lang") == "python") & F.coalesce(resolved.isin(*above), F.lit(False)) if above else F.lit(False)
    by_lang = F.when(F.col("lang") == "python", "python-graph").when(F.col("lang") == "typescript", "typescript-graph").otherwise("graph")
    found = F.array_compact(F.array(F.when(graph, by_lang), F.when(space, F.lit("namespace")), F.when(F.col("raw_specifier").isin(*names), F.lit("static"))))
    rows = edges.where(F.col("source_file") != target).select("source_file", F.explode(found).alias("b"))
    place = F.array_position(F.array(*[F.lit(b) for b in BACKENDS]), F.col("b"))
    rows = rows.groupBy("source_file").agg(F.array_sort(F.collect_set(F.struct(place.alias("n"), "b"))).alias("s"))
    return rows.select("source_file", F.col("s")[0]["b"].alias("backend"), F.transform("s", lambda x: x["b"]).alias("backends"))


def answers(files: DataFrame) -> DataFrame:
    """(worktree_id, key, kind): what files(path) can be to an import, so what a lookup of them concerns.

    A Python file is its module and, through path hints, any tail of it; so are the folders above it as namespaces. A
    TypeScript file is its path and what its ending leaves of it.
    """
    files = scoped(files).select(TREE, "path")
    py = files.where(P.extension(F.col("path")).isin("py", "pyi"))
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), r"(^|/)__init__$", ""), "/"), lambda x: x != "")
    py = py.select(TREE, parts.alias("p")).where(F.size("p") > 0)
    ups = F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", 1, n)))
    py = py.select(TREE, ups.alias("p")).select(TREE, F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", n, F.size("p")), "."))).alias("key"), F.lit("module").alias("kind"))
    ts = files.where(P.extension(F.col("path")).isin(*TS_EXTENSIONS))
    cut = lambda v: F.when(F.col("path").endswith(v), F.expr(f"substring(path, 1, length(path) - {len(v)})"))
    ts = ts.select(TREE, F.explode(F.array_compact(F.array(F.col("path"), *[cut(v) for v in TS_VARIANTS]))).alias("key"), F.lit("path").alias("kind"))
    return py.unionByName(ts).distinct()


def concerned(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(worktree_id, path) of the files whose imports may resolve otherwise once files(path) came or went."""
    return keys.join(answers(files), [TREE, "key", "kind"], "left_semi").select(TREE, F.col("source_file").alias("path")).distinct()
