"""Where a name is used: word references by line, Python references aware of docstrings and overrides, and their context."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

TEXT_CHARS, STATIC_CHARS = 200, 220


def word_pattern(symbol: str) -> str:
    """A whole ASCII word, whatever letters of other scripts stand beside it."""
    return f"(?<![A-Za-z0-9_]){re.escape(symbol)}(?![A-Za-z0-9_])"


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of files(path, content); lines count from 1."""
    rows = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("_i", "text"))
    return rows.select("path", (F.col("_i") + 1).alias("line"), "text")


def word_references(files: DataFrame, symbol: str, extension: str | None = None, limit: int | None = None) -> DataFrame:
    """Lines of files(path, content) that hold the symbol as a word; with a limit, the first by path and line."""
    if extension:
        files = files.where(P.extension(F.col("path")) == extension.lower().lstrip("."))
    rows = file_lines(files.where(F.contains("content", F.lit(symbol)))).where(F.col("text").rlike(word_pattern(symbol)))
    rows = rows.withColumn("text", F.left(T.strip(F.col("text")), F.lit(TEXT_CHARS)))
    return rows.orderBy("path", "line").limit(limit) if limit else rows


def with_context(references: DataFrame, files: DataFrame, radius: int) -> DataFrame:
    """references(path, line) and the lines of files around each; the radius is held to [0, 8]."""
    r = min(8, max(0, radius))
    lines = files.select(F.col("path").alias("_p"), T.lines(F.col("content")).alias("_l"))
    rows = references.join(lines, F.col("path") == F.col("_p"))
    start = F.greatest(F.col("line") - r, F.lit(1))
    stop = F.least(F.col("line") + r, F.size("_l"))
    context = F.when(stop >= start, F.array_join(F.slice("_l", start, stop - start + 1), "\n")).otherwise("")
    return rows.withColumns({"context_start": start, "context": context}).drop("_p", "_l")


#: What declares a symbol, by language; {s} is the symbol.
DECLARATIONS = {
    "typescript": r"\b(?:function\*?|class|interface|type|enum|const|let|var|namespace)\s+{s}\b|^\s*(?:public|private|protected|static|async|readonly|get|set|\s)*{s}\s*\([^)]*\)\s*(?::[^{{=]+)?\{{",
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+{s}\b|^{s}\s*(?::[^=]+)?=",
    "go": r"^\s*(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+){s}\b",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|type|mod|const|static)\s+{s}\b",
    "kotlin": r"\b(?:fun|class|interface|object|typealias|val|var)\s+(?:<[^>]*>\s*)?{s}\b",
}
COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--)")


def declares(line: str, symbol: str, language: str) -> bool:
    """Whether a line looks like the symbol's declaration; comments never do."""
    pattern = DECLARATIONS.get("typescript" if language == "javascript" else language)
    return bool(pattern) and not COMMENT.match(line) and bool(re.search(pattern.format(s=re.escape(symbol)), line))


def python_line_facts(content: str) -> list[tuple[str, bool]]:
    """For each line of a Python file, the class it stands in (empty for none) and whether a docstring or comment covers it."""
    out, classes, quote = [], [], ""
    for line in content.split("\n"):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        inside = bool(quote)
        rest = line
        while rest:
            if quote:
                at = rest.find(quote)
                if at < 0:
                    break
                rest, quote = rest[at + 3 :], ""
            else:
                opening = [(rest.find(q), q) for q in ('"""', "'''") if q in rest]
                if not opening:
                    break
                at, quote = min(opening)
                inside = inside or not rest[:at].strip()
                rest = rest[at + 3 :]
        if bare and not bare.startswith("#") and not inside:
            while classes and indent <= classes[-1][0]:
                classes.pop()
        out.append((classes[-1][1] if classes else "", inside or bare.startswith("#")))
        m = re.match(r"class\s+([A-Za-z_]\w*)", bare)
        if m and not inside:
            classes.append((indent, m[1]))
    return out


def class_bases(files: DataFrame) -> DataFrame:
    """(base, child) of every Python class statement, by simple names."""
    pattern = r"(?m)^\s*class\s+([A-Za-z_]\w*)\s*\(([^)]*)\)"
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    rows = files.select(F.explode(found).alias("c"))
    bases = F.explode(F.split(F.regexp_extract("c", pattern, 2), ","))
    rows = rows.select(F.regexp_extract("c", pattern, 1).alias("child"), bases.alias("b"))
    base = F.regexp_extract(F.trim(F.regexp_replace("b", r"\[.*", "")), r"([A-Za-z_]\w*)$", 1)
    return rows.where(~F.contains("b", F.lit("="))).select(base.alias("base"), "child").where("base <> ''").distinct()


def python_references(files: DataFrame, symbol: str, anchor: str | None = None, declarations: bool = True, limit: int | None = None) -> DataFrame:
    """(path, line, text, kind) of a Python symbol: reference, declaration or override; docstrings and comments don't count.

    If the anchor file declares the symbol as a method of a class, then the same method in any class that derives from it,
    by simple names, is an override and is reported even without declarations.
    """
    from .tables import closure

    python = files.where(P.extension(F.col("path")) == "py")
    heirs: list[str] = []
    if anchor:
        row = python.where(F.col("path") == anchor).select("content").first()
        own = _owner_class(row["content"], symbol) if row else None
        if own:
            start = files.sparkSession.createDataFrame([(own,)], "node string")
            reached = closure(class_bases(python), start, "base", "child")
            heirs = [r["node"] for r in reached.where("depth > 0").orderBy("node").collect()]  # the subclasses of one class
    word, define = re.compile(word_pattern(symbol)), re.compile(rf"^\s*(?:async\s+)?def\s+{re.escape(symbol)}\s*\(")

    def scan(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                text = content.split("\n")
                for n, (line, (cls, masked)) in enumerate(zip(text, python_line_facts(content)), 1):
                    if masked or not word.search(line):
                        continue
                    if define.search(line) and cls in heirs:
                        kind = "override"
                    else:
                        kind = "declaration" if declares(line, symbol, "python") else "reference"
                    if kind != "declaration" or declarations:
                        out.append((path, n, line.strip()[:STATIC_CHARS], kind))
            yield pd.DataFrame(out, columns=["path", "line", "text", "kind"])

    rows = python.where(F.contains("content", F.lit(symbol))).select("path", "content").mapInPandas(scan, "path string, line int, text string, kind string")
    return rows.orderBy("path", "line").limit(limit) if limit else rows


def _owner_class(content: str, symbol: str) -> str | None:
    for line, (cls, masked) in zip(content.split("\n"), python_line_facts(content)):
        if cls and not masked and re.match(rf"\s+(?:async\s+)?def\s+{re.escape(symbol)}\s*\(", line):
            return cls
    return None


def candidate_files(indexed: DataFrame, anchor: str, importers: DataFrame) -> DataFrame:
    """indexed(path, ...) reduced to the anchor and the files that import it: all that a scan for its names has to read."""
    own = indexed.sparkSession.createDataFrame([(anchor,)], "path string")
    wanted = importers.select(F.col("source_file").alias("path")).unionByName(own).distinct()
    return indexed.join(wanted, "path", "left_semi")


def imported_references(files: DataFrame, symbol: str, declaring: str, edges: DataFrame, declarations: bool = True) -> DataFrame:
    """Word references in the declaring file and in the files whose edges lead to it: what a scan can tell without a compiler."""
    users = edges.where(F.col("resolved_target") == declaring).select(F.col("source_file").alias("path")).distinct()
    own = files.sparkSession.createDataFrame([(declaring,)], "path string")
    rows = word_references(files.join(users.unionByName(own).distinct(), "path", "left_semi"), symbol)
    if declarations:
        return rows
    lang = P.language(F.col("path"))
    declared: Column = F.lit(False)
    for name, pattern in DECLARATIONS.items():
        langs = ("typescript", "javascript") if name == "typescript" else (name,)
        declared = declared | (lang.isin(*langs) & F.col("text").rlike(pattern.format(s=re.escape(symbol))))
    return rows.where(~declared)


def find_references(files: DataFrame, symbol: str, anchor: str | None = None, edges: DataFrame | None = None, symbols: DataFrame | None = None, limit: int = 50, declarations: bool = True) -> tuple[DataFrame, dict]:
    """References and what really found them: the anchor's language chooses a backend, and the word scan is always last.

    No compiler or language server runs here, so the report's ``actual`` is never called semantic.
    """
    limit = min(500, max(1, limit))
    ext = (anchor or "").rsplit(".", 1)[-1].lower() if anchor and "." in anchor else ""
    note = {"requested": "auto", "actual": "heuristic", "confidence": "low", "reason": None, "candidates": []}
    if ext in {"ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs"} and edges is not None:
        if files.where(F.col("path") == anchor).isEmpty():
            return word_references(files.limit(0), symbol), note | {"actual": "none", "reason": "the anchor file isn't indexed"}
        rows = imported_references(files, symbol, anchor, edges, declarations).orderBy("path", "line").limit(limit)
        if not rows.isEmpty():
            return rows, note | {"actual": "import-scan", "confidence": "medium"}
        return word_references(files, symbol, ext, limit), note | {"reason": "no importing file uses the symbol"}
    python = ext == "py" or (not anchor and symbols is not None and not symbols.where((F.col("name") == symbol) & F.col("file_path").endswith(".py")).isEmpty())
    if python:
        rows = python_references(files, symbol, anchor, declarations, limit)
        if not rows.isEmpty():
            return rows, note | {"actual": "python-static", "confidence": "medium"}
        return word_references(files, symbol, "py" if anchor else None, limit), note | {"reason": "the static scan found nothing"}
    if symbols is not None:
        named = symbols.where(F.col("name") == symbol).orderBy("file_path", "start_line").limit(8).collect()
        note["candidates"] = [f"{r['file_path']}:{r['start_line']}" for r in named]
    return word_references(files, symbol, ext or None, limit), note


def nearest_declaration(lines: list[str], around: int, symbol: str, language: str, reach: int = 20) -> int | None:
    """The number of the nearest line that declares the symbol, downward first; numbers from 1."""
    for step in range(reach + 1):
        for n in dict.fromkeys((around + step, around - step)):
            if 1 <= n <= len(lines) and declares(lines[n - 1], symbol, language):
                return n
    return None


def location(text: str) -> tuple[str, int | None, int | None]:
    """The parts of ``path:line:column``; a path alone has neither."""
    m = re.match(r"^(.*?)(?::(\d+))?(?::(\d+))?$", text.strip())
    return m[1], int(m[2]) if m[2] else None, int(m[3]) if m[3] else None
