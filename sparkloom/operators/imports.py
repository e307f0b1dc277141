"""The import graph: statements of Python, TypeScript and others as edges, their resolution, and lookups in both directions."""

from __future__ import annotations

import ast
import os
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .nearest import TREE, candidates, given_configs, go_targets, scoped
from .rounds import settle
from .symbols import blank_literals

#: Top-level modules of the running Python; what counts as standard library.
STDLIB = tuple(sorted(sys.stdlib_module_names))
_STDLIB_SQL = ", ".join(f"'{m}'" for m in STDLIB)
TS_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
TS_VARIANTS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
LOWER = {"high": "medium", "medium": "low", "low": "low"}
EDGES = "source_file string, raw_specifier string, imported_names array<string>, resolved_target string, edge_kind string, level int, conditional boolean, confidence string, unresolved_reason string, lang string"


def in_stdlib(module: str) -> Column:
    """Whether the first part of a module, an SQL expression, is in the standard library; one expression, so that building it is one call."""
    return F.expr(f"substring_index({module}, '.', 1) IN ({_STDLIB_SQL})")


#: Rows that a scanner holds before it gives them out, however many a batch of files has.
FRAME_ROWS = 2000


def frames(rows: Iterable[tuple], columns: list[str], most: int = FRAME_ROWS) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most ``most`` of them; memory that is freed between frames serves the next one."""
    rows = iter(rows)
    while some := list(islice(rows, most)):
        yield pd.DataFrame(some, columns=columns)


# -- Python ---------------------------------------------------------------------------------------------------------------


def module_of(path: str) -> str:
    """The dotted module of a path; a package is named by its folder, and one at the root keeps the name of its file."""
    stem = re.sub(r"\.pyi?$", "", path)
    if stem.endswith("/__init__"):
        stem = stem[: -len("/__init__")]
    return stem.replace("/", ".")


_FROM = re.compile(r"^(\s*)from\s+(\.*)([\w.]*)\s+import\s+(.+)$")
_IMPORT = re.compile(r"^(\s*)import\s+(.+)$")
_HINT = re.compile(r"sys\.path\.(?:append|insert)\s*\((?:\s*\d+\s*,)?[^)]*?[\"']([^\"']+)[\"']")


def python_statements(content: str) -> list[tuple[str, int, list[str], bool, str]]:
    """(module, level, names, conditional, kind) of every import; from the syntax tree, or line by line where there is none."""
    out = []
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        for line in content.split("\n"):
            if m := _FROM.match(line):
                names = [x.split(" as ")[0].strip() for x in m[4].strip("() \\").split(",")]
                out.append((m[3], len(m[2]), [x for x in names if x], bool(m[1]), "from"))
            elif m := _IMPORT.match(line):
                out += [(x.split(" as ")[0].strip(), 0, [], bool(m[1]), "import") for x in m[2].split(",") if x.strip()]
        return out
    stack: list[tuple[ast.AST, bool]] = [(tree, False)]
    while stack:
        node, inside = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                out += [(a.name, 0, [], inside, "import") for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out.append((child.module or "", child.level, [a.name for a in child.names], inside, "from"))
            else:
                branch = isinstance(child, (ast.If, ast.Try, ast.With, ast.For, ast.While, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.Match, ast.ExceptHandler))
                stack.append((child, inside or branch))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def python_imports(files: DataFrame) -> DataFrame:
    """(worktree_id, source_file, module, level, names, conditional, edge_kind, mutates_path, hints) of Python files(path, content)."""

    def found(batches):
        for pdf in batches:
            for tree, path, content in zip(pdf[TREE], pdf["path"], pdf["content"]):
                hints = _HINT.findall(content or "")
                yield from ((tree, path, m, lv, n, c, k, "sys.path" in content, hints) for m, lv, n, c, k in python_statements(content or ""))

    def run(batches):
        yield from frames(found(batches), [TREE, "source_file", "module", "level", "names", "conditional", "edge_kind", "mutates_path", "hints"])

    python = scoped(files).where(P.extension(F.col("path")).isin("py", "pyi")).select(TREE, "path", "content")
    return python.mapInPandas(run, f"{TREE} string, source_file string, module string, level int, names array<string>, conditional boolean, edge_kind string, mutates_path boolean, hints array<string>")


def python_modules(files: DataFrame) -> DataFrame:
    """(worktree_id, module, target) of every Python file, also without a leading ``src.``; of several files a plain one comes before a package."""
    py = scoped(files).where(P.extension(F.col("path")).isin("py", "pyi")).select(TREE, "path")
    stem = F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), r"/__init__$", "")
    rows = py.select(TREE, F.replace(stem, F.lit("/"), F.lit(".")).alias("module"), "path", F.col("path").rlike(r"(^|/)__init__\.pyi?$").alias("package"))
    rows = rows.unionByName(rows.where(F.col("module").startswith("src.")).withColumn("module", F.expr("substring(module, 5)")))
    return rows.groupBy(TREE, "module").agg(F.min_by("path", F.struct("package", "path")).alias("target"))


def python_namespaces(files: DataFrame) -> DataFrame:
    """(worktree_id, module) of every folder above a Python file."""
    py = scoped(files).where(P.extension(F.col("path")).isin("py", "pyi")).select(TREE, F.split("path", "/").alias("p"))
    ups = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.array_join(F.slice("p", 1, n), "."))
    return py.where(F.size("p") > 1).select(TREE, F.explode(ups).alias("module")).distinct()


def python_edges(files: DataFrame, aliases: dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Resolved edges of Python files(path, content), among the paths ``known`` (those of the files if it isn't given).

    With a worktree_id, files resolve within their own tree, and edges name it.

    In order: relative imports climb their packages; then exact modules, namespace folders and sys.path hints, for the name
    itself and then for its aliases; then the standard library; else the module is external. Imports in a condition are one
    step less sure. ``from a import b`` has an edge to a and, where a.b is a module of its own, to that as well.
    """
    known = files if known is None else known
    # rows numbered once must be read from storage, not numbered again
    rows = settle(python_imports(files).withColumn("_row", F.monotonically_increasing_id()))
    own = F.split(F.regexp_replace(F.regexp_replace("source_file", r"\.pyi?$", ""), r"(^|/)[^/]+$", ""), "/")
    package = F.filter(own, lambda x: x != "")
    depth = F.size(package) - (F.col("level") - 1)
    base = F.array_join(F.slice(package, 1, F.greatest(depth, F.lit(0))), ".")
    full = F.when(F.col("level") > 0, F.concat_ws(".", F.when(base != "", base), F.when(F.col("module") != "", F.col("module")))).otherwise(F.col("module"))
    rows = rows.withColumns({"_escapes": (F.col("level") > 0) & (depth < 0), "_full": full})
    names = F.filter("names", lambda n: n != "*")
    wanted = rows.where("not _escapes").select(TREE, "_row", "hints", F.explode(F.concat(F.array(F.struct(F.lit("").alias("n"), F.col("_full").alias("m"))), F.transform(names, lambda n: F.struct(n.alias("n"), F.concat_ws(".", F.when(F.col("_full") != "", F.col("_full")), n).alias("m"))))).alias("w"))
    wanted = wanted.select(TREE, "_row", "hints", F.col("w.n").alias("_name"), F.col("w.m").alias("_m"))
    tries = [F.struct(F.lit(0).alias("k"), F.lit("").alias("why"), F.col("_m").alias("m"))]
    for i, (old, new) in enumerate(sorted((aliases or {}).items()), 1):
        fits = (F.col("_m") == old) | F.col("_m").startswith(old + ".")
        tries.append(F.when(fits, F.struct(F.lit(10 * i).alias("k"), F.lit("by alias").alias("why"), F.concat(F.lit(new), F.substring("_m", len(old) + 1, 1 << 20)).alias("m"))))
    hinted = F.transform("hints", lambda h: F.struct(F.lit(5).alias("k"), F.lit("by path hint").alias("why"), F.concat_ws(".", F.replace(F.regexp_replace(h, r"^(\./)+|/+$", ""), F.lit("/"), F.lit(".")), F.col("_m")).alias("m")))
    tried = wanted.where("_m <> ''").select(TREE, "_row", "_name", F.explode(F.concat(F.array_compact(F.array(*tries)), hinted)).alias("t")).select(TREE, "_row", "_name", "t.k", "t.why", F.col("t.m").alias("module"))
    modules = python_modules(known)
    found = tried.join(modules, [TREE, "module"]).select("_row", "_name", "k", "why", "target", F.lit(True).alias("exact"))
    spaces = python_namespaces(known).join(modules, [TREE, "module"], "left_anti")
    found = found.unionByName(tried.join(spaces, [TREE, "module"]).select("_row", "_name", (F.col("k") + 1).alias("k"), "why", F.replace("module", F.lit("."), F.lit("/")).alias("target"), F.lit(False).alias("exact")))
    best = found.groupBy("_row", "_name").agg(F.min_by(F.struct("target", "exact", "why"), F.struct("k", "target")).alias("b")).select("_row", "_name", "b.*")
    main = best.where("_name = ''").drop("_name")
    rows = rows.join(main, "_row", "left")
    std = in_stdlib("_full")
    relative = F.col("level") > 0
    spec = F.concat(F.repeat(F.lit("."), F.col("level")), F.col("module"))
    confidence = (
        F.when(F.col("_escapes"), "low").when(F.col("target").isNotNull(), F.when(F.col("exact") & (F.col("why") == ""), "high").otherwise("medium"))
        .when(relative, "low").when(std, "medium").when(F.col("mutates_path"), "medium").otherwise("low")
    )
    reason = (
        F.when(F.col("_escapes"), "escapes the package root").when(F.col("target").isNotNull(), F.when(F.col("why") != "", F.col("why")))
        .when(relative, "no such relative module").when(std, "standard library").otherwise("external")
    )
    edges = rows.select(TREE, "source_file", spec.alias("raw_specifier"), "names", F.col("target").alias("resolved_target"), "edge_kind", "level", "conditional", confidence.alias("confidence"), reason.alias("unresolved_reason"))
    children = best.where("_name <> ''").join(rows.select(TREE, "_row", "source_file", spec.alias("s"), "edge_kind", "level", "conditional", F.col("target").alias("main")), "_row")
    children = children.where(F.col("exact") & (F.col("main").isNull() | (F.col("target") != F.col("main"))))
    sep = F.when(F.col("s").endswith("."), "").otherwise(".")
    extra = children.select(
        TREE, "source_file", F.concat(F.col("s"), sep, F.col("_name")).alias("raw_specifier"), F.array("_name").alias("names"), F.col("target").alias("resolved_target"), F.lit("child").alias("edge_kind"),
        "level", "conditional", F.when(F.col("why") == "", "high").otherwise("medium").alias("confidence"), F.when(F.col("why") != "", F.col("why")).alias("unresolved_reason"),
    )
    out = edges.unionByName(extra)
    step = F.create_map(*[F.lit(x) for kv in LOWER.items() for x in kv])
    unsure = F.when(F.col("conditional"), F.concat_ws("; ", "unresolved_reason", F.lit("in a condition"))).otherwise(F.col("unresolved_reason"))
    out = out.select(
        TREE, "source_file", "raw_specifier", F.col("names").alias("imported_names"), "resolved_target", "edge_kind", "level", "conditional",
        F.when(F.col("conditional"), step[F.col("confidence")]).otherwise(F.col("confidence")).alias("confidence"), unsure.alias("unresolved_reason"), F.lit("python").alias("lang"),
    ).dropDuplicates([TREE, "source_file", "raw_specifier", "resolved_target", "edge_kind"])
    return out if TREE in files.columns else out.drop(TREE)


# -- TypeScript and JavaScript --------------------------------------------------------------------------------------------

_TS = (
    ("import", re.compile(r"\bimport\s+(?:type\s+)?(?:([\w$*{}\s,]+?)\s+from\s+)?([\"'])([^\"'\n]+)\2")),
    ("export", re.compile(r"\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+[\w$]+)?|\{([^}]*)\})\s+from\s+([\"'])([^\"'\n]+)\2")),
    ("dynamic", re.compile(r"\bimport\s*\(()\s*([\"'])([^\"'\n]+)\2\s*\)")),
    ("require", re.compile(r"\brequire\s*\(()\s*([\"'])([^\"'\n]+)\2\s*\)")),
    ("import-equals", re.compile(r"\bimport\s+([\w$]+)\s*=\s*require\s*\(\s*([\"'])([^\"'\n]+)\2\s*\)")),
)


def ts_statements(content: str) -> list[tuple[str, list[str], str]]:
    """(specifier, names, kind) of every import, re-export, require and dynamic import; comments don't count."""
    clean = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.S)
    clean = re.sub(r"(?m)^(\s*)//[^\n]*", r"\1", clean)
    out, seen = [], set()
    for kind, rx in _TS:
        for m in rx.finditer(clean):
            key = (m[3], kind)
            if key not in seen and not (kind == "require" and (m[3], "import-equals") in seen):
                seen.add(key)
                out.append((m[3], [x.split(" as ")[0].strip() for x in re.split(r"[{},]", m[1] or "") if x.strip()], kind))
    return sorted(out)


def ts_edges(files: DataFrame, projects: list[dict] | DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Resolved edges of TypeScript and JavaScript files(path, content) among the paths ``known``: relative paths, ``paths`` and ``baseUrl``; others are packages.

    ``projects`` is what ``nearest.ts_configs`` reads from a tree, or a list of such. With a worktree_id, files resolve within
    their own tree, and edges name it.
    """
    known = files if known is None else known

    def found(batches):
        for pdf in batches:
            for tree, path, content in zip(pdf[TREE], pdf["path"], pdf["content"]):
                yield from ((tree, path, n, spec, names, kind) for n, (spec, names, kind) in enumerate(ts_statements(content or "")))

    def run(batches):
        yield from frames(found(batches), [TREE, "path", "n", "spec", "imported_names", "edge_kind"])

    some = scoped(files).where(P.extension(F.col("path")).isin(*TS_EXTENSIONS)).select(TREE, "path", "content")
    rows = settle(some.mapInPandas(run, f"{TREE} string, path string, n int, spec string, imported_names array<string>, edge_kind string"))
    configs = projects if isinstance(projects, DataFrame) else given_configs(rows, projects or [])
    tried = candidates(rows.select(TREE, "path", "n", "spec"), configs)
    stem = F.regexp_replace("candidate", r"\.(m|c)?jsx?$", "")
    variants = F.posexplode(F.array(F.col("candidate"), *[F.concat(stem, F.lit(v)) for v in TS_VARIANTS])).alias("k", "target")
    tried = tried.select(TREE, "path", "n", "rank", variants).join(scoped(known).select(TREE, F.col("path").alias("target")).distinct(), [TREE, "target"])
    best = tried.groupBy(TREE, "path", "n").agg(F.min_by("target", F.struct("rank", "k")).alias("resolved_target"))
    rows = rows.join(best, [TREE, "path", "n"], "left")
    relative = F.col("spec").startswith(".")
    pkg = F.concat(F.lit("pkg:"), F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1))
    found = F.col("resolved_target").isNotNull()
    out = rows.select(
        TREE, F.col("path").alias("source_file"), F.col("spec").alias("raw_specifier"), "imported_names", F.coalesce("resolved_target", F.when(~relative, pkg)).alias("resolved_target"), "edge_kind", F.lit(0).alias("level"), F.lit(False).alias("conditional"),
        F.when(found, "high").when(relative, "low").otherwise("medium").alias("confidence"), F.when(~found, F.when(relative, "no such relative module").otherwise("external")).alias("unresolved_reason"), F.lit("typescript").alias("lang"),
    )
    return out if TREE in files.columns else out.drop(TREE)


_DECLARED = re.compile(r"(?m)^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|type|enum|const\s+enum|const|let|var|namespace)\s+([A-Za-z_$][\w$]*)")


def ts_declarations(files: DataFrame) -> DataFrame:
    """(name, kind, path, line) of top-level declarations, variables among them."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                clean = blank_literals(content or "")
                for m in _DECLARED.finditer(clean):
                    kind = {"function*": "function", "const enum": "enum", "const": "variable", "let": "variable", "var": "variable"}.get(re.sub(r"\s+", " ", m[1]), m[1])
                    out.append((m[2], kind, path, clean.count("\n", 0, m.start()) + 1))
            yield pd.DataFrame(out, columns=["name", "kind", "path", "line"])

    return files.where(P.extension(F.col("path")).isin(*TS_EXTENSIONS)).select("path", "content").mapInPandas(run, "name string, kind string, path string, line int")


# -- other languages ------------------------------------------------------------------------------------------------------

#: What an import looks like in a line, by language; the first group is the specifier.
LINE_IMPORTS = {"rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "kotlin": r"^\s*import\s+([\w.]+)", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"}
GO_BLOCK = r'(?s)\bimport\s*\((.*?)\)'


def line_edges(files: DataFrame) -> DataFrame:
    """(source_file, raw_specifier, lang) of Rust, Kotlin, Java, C and Go files(path, language, content), with their worktree_id where they have one; native."""
    tree = [TREE] if TREE in files.columns else []
    specs = lambda name: F.regexp_extract_all("content", F.lit("(?m)" + LINE_IMPORTS[name]), F.lit(1))
    block = F.array_join(F.regexp_extract_all("content", F.lit(GO_BLOCK), F.lit(1)), "\n")
    every = F.when(F.col("language") == "go", F.concat(F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1)), F.regexp_extract_all("content", F.lit(r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))))
    for name in LINE_IMPORTS:
        every = every.when(F.col("language") == name, specs(name))
    rows = files.where(F.col("language").isin("go", *LINE_IMPORTS))
    return rows.select(*tree, F.col("path").alias("source_file"), F.explode(every).alias("raw_specifier"), F.col("language").alias("lang")).distinct()


def other_edges(files: DataFrame, modules: DataFrame) -> DataFrame:
    """The imports of Go, Rust, Kotlin, Java and C files as edges; a Go package of the nearest go.mod's module leads to its folder.

    ``modules`` is what ``nearest.go_modules`` reads from the tree.
    """
    specs = line_edges(scoped(files)).select(TREE, F.col("source_file").alias("path"), F.col("raw_specifier").alias("spec"), "lang")
    none = specs.where("lang <> 'go'").withColumns({"class": F.lit(None).cast("string"), "target": F.lit(None).cast("string")})
    rows = go_targets(specs.where("lang = 'go'"), modules).unionByName(none)
    reason = F.when(F.col("target").isNull(), F.when(F.col("class") == "stdlib", "standard library").when(F.col("class") == "external", "external").otherwise("not resolved"))
    return rows.select(
        TREE, F.col("path").alias("source_file"), F.col("spec").alias("raw_specifier"), F.array().cast("array<string>").alias("imported_names"), F.col("target").alias("resolved_target"), F.lit("import").alias("edge_kind"), F.lit(0).alias("level"), F.lit(False).alias("conditional"),
        F.when(F.col("target").isNotNull() | (F.col("class") == "stdlib"), "medium").otherwise("low").alias("confidence"), reason.alias("unresolved_reason"), "lang",
    )


def go_class(specifier: Column, module: str) -> Column:
    """internal for the module and below it, stdlib if the first part has no dot, else external."""
    internal = (specifier == module) | specifier.startswith(module + "/")
    return F.when(internal, "internal").when(~F.contains(F.substring_index(specifier, "/", 1), F.lit(".")), "stdlib").otherwise("external")


# -- lookups --------------------------------------------------------------------------------------------------------------


def dependency_groups(edges: DataFrame, most: int = 200) -> DataFrame:
    """(source_file, group, n, names) of edges: internal, stdlib or external, distinct and sorted, with at most ``most`` shown."""
    target = F.coalesce("resolved_target", "raw_specifier")
    outside = F.col("resolved_target").isNull() | F.col("resolved_target").startswith("pkg:")
    std = (F.col("lang") == "python") & in_stdlib("raw_specifier") & (F.col("level") == 0)
    group = F.when(outside & std, "stdlib").when(outside, "external").otherwise("internal")
    rows = edges.select("source_file", group.alias("group"), target.alias("t")).distinct()
    return rows.groupBy("source_file", "group").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("t")), 1, most).alias("names"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """total, resolved, unresolved, rate, and the edges by class: standard library first, then internal and external.

    A Python edge is of the standard library if the first part of its name is, dots in front aside, even where a file of the
    tree answers to it; it is internal if it is relative, found or found by an alias. Internal edges have a rate of their own.
    """
    python = F.col("lang") == "python"
    std = python & in_stdlib("ltrim('.', raw_specifier)")
    found = F.col("resolved_target").isNotNull() & ~F.coalesce(F.col("resolved_target").startswith("pkg:"), F.lit(False))
    internal = ~std & (found | F.col("raw_specifier").startswith(".") | (F.col("level") > 0))
    n, inside = F.count("*"), F.count_if(internal)
    return edges.agg(
        n.alias("total"), F.count_if(found).alias("resolved"), F.count_if(~found).alias("unresolved"), F.when(n > 0, F.count_if(found) / n).otherwise(0.0).alias("rate"),
        F.count_if(std).alias("stdlib"), inside.alias("internal"), F.count_if(internal & found).alias("internal_resolved"),
        F.when(inside > 0, F.count_if(internal & found) / inside).otherwise(0.0).alias("internal_rate"), F.count_if(~std & ~internal).alias("external"),
        F.count_if(F.contains(F.coalesce("unresolved_reason", F.lit("")), F.lit("by alias"))).alias("by_alias"), F.count_if(F.col("conditional")).alias("conditional"),
    )


def find_importers(edges: DataFrame, target: str, include_self: bool = False, excluded: tuple[str, ...] = (".md", ".txt", ".rst"), limit: int = 100) -> tuple[DataFrame, int]:
    """(source_file, via) of the files that import a path, module or package, by path; and how many there are before the limit.

    A target may be a path, the same without extension or index, a dotted module, a specifier, or a package's name.
    """
    stem = re.sub(r"\.[A-Za-z0-9]+$", "", target)
    keys = {target, stem, module_of(target), module_of(target).removeprefix("src."), f"pkg:{target}", re.sub(r"/(index|__init__)$", "", stem)}
    hit = F.col("resolved_target").isin(*keys) | F.col("raw_specifier").isin(*keys)
    hit = hit | F.coalesce(P.same_or_suffix(F.col("resolved_target"), F.lit(target)), F.lit(False))
    rows = edges.where(hit)
    if not include_self:
        rows = rows.where(F.col("source_file") != target)
    for ext in excluded:
        rows = rows.where(~F.lower("source_file").endswith(ext))
    rows = rows.groupBy("source_file").agg(F.min("raw_specifier").alias("via"))
    return rows.orderBy("source_file").limit(max(1, limit)), rows.count()


def suggest_paths(files: DataFrame, wanted: str, near: int = 10, alike: int = 8) -> DataFrame:
    """(path, why) for a path that isn't there: files beside it, and files whose stem holds its stem."""
    folder = os.path.dirname(wanted)
    stem = re.sub(r"\.[^.]*$", "", os.path.basename(wanted)).lower()
    beside = files.where(P.dirname(F.col("path")) == folder).select("path", F.lit("beside").alias("why")).orderBy("path").limit(near)
    like = files.where(F.contains(F.lower(P.basename(F.col("path"))), F.lit(stem))).select("path", F.lit("alike").alias("why")).orderBy("path").limit(alike)
    return beside.unionByName(like)


def directory_dependencies(edges: DataFrame, folder: str, recursive: bool = True, most_files: int = 50, per_file: int = 80) -> DataFrame:
    """(source_file, n, names) of the files in a folder, the first by path, with what each depends on."""
    prefix = folder.rstrip("/") + "/" if folder.strip("/.") else ""
    inside = F.col("source_file").startswith(prefix)
    if not recursive:
        inside = inside & ~F.contains(F.substring("source_file", len(prefix) + 1, 1 << 20), F.lit("/"))
    rows = edges.where(inside).select("source_file", F.coalesce("resolved_target", "raw_specifier").alias("t")).distinct()
    out = rows.groupBy("source_file").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("t")), 1, per_file).alias("names"))
    return out.orderBy("source_file").limit(min(500, max(1, most_files)))
