"""Symbol chunkers: scanners that read one file at a time, and the native extraction of symbols by line.

A file's symbols depend on the order of its lines, so the scanners run in an Arrow batch, a file to a row, and need no
shuffle. Extraction by pattern is native.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.hashing import short_sha1
from .chunks import chunk_files, chunk_id
from .references import file_lines
from .tables import merged

KINDS = ("function", "class", "method", "interface", "type", "enum", "variable", "module", "property", "constant")
AST_LANGUAGES = ("typescript", "javascript", "python", "go", "rust", "kotlin")
#: One-line patterns of each language, in order of preference: kind, pattern, group of the name, group of the parent.
LINE_RULES = {
    "go": (
        ("method", r"^func\s+\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)[^)]*\)\s*([A-Za-z_]\w*)", 2, 1), ("function", r"^func\s+([A-Za-z_]\w*)", 1, 0),
        ("class", r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\b", 1, 0), ("interface", r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\b", 1, 0), ("type", r"^type\s+([A-Za-z_]\w*)", 1, 0),
    ),
    "rust": (
        ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)", 1, 0), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_]\w*)", 1, 0),
        ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+([A-Za-z_]\w*)", 1, 0),
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:async\s+)?(?:const\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+([A-Za-z_]\w*)", 1, 0),
    ),
    "kotlin": (
        ("class", r"^\s*(?:[a-z]+\s+)*class\s+([A-Za-z_]\w*)", 1, 0), ("interface", r"^\s*(?:[a-z]+\s+)*interface\s+([A-Za-z_]\w*)", 1, 0), ("class", r"^\s*(?:[a-z]+\s+)*object\s+([A-Za-z_]\w*)", 1, 0),
        ("type", r"^\s*(?:[a-z]+\s+)*typealias\s+([A-Za-z_]\w*)", 1, 0), ("function", r"^\s*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[A-Za-z_][\w.<>]*\.)?([A-Za-z_]\w*)", 1, 0),
    ),
}
Row = tuple[str, str, str, int, int]  # kind, name, parent, first and last line


def line_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, parent, start_line, end_line, chunk) of Go, Rust and Kotlin declarations; native, one line each."""
    lang = files.select("path", F.col("language").alias("_l"))
    rows = file_lines(files.where(F.col("language").isin(*LINE_RULES))).join(lang, "path")
    found = F.lit(None)
    for name, rules in LINE_RULES.items():
        for kind, pattern, at, parent in reversed(rules):
            hit = (F.col("_l") == name) & F.col("text").rlike(pattern)
            said = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", pattern, at).alias("name"), (F.regexp_extract("text", pattern, parent) if parent else F.lit("")).alias("parent"))
            found = F.when(hit, said).otherwise(found)
    rows = rows.withColumn("s", found).where("s is not null")
    return rows.select("path", "s.kind", "s.name", "s.parent", F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line"), F.col("text").alias("chunk"))


def scan_python(text: str) -> list[Row]:
    """Blocks by indentation: functions, classes, methods with their decorators, and constants of modules; ``async def`` counts too.

    A constant is one line; ``__all__`` runs on over its brackets and the blank lines behind it.
    """
    lines = text.split("\n")
    out: list[Row] = []
    classes: list[tuple[int, str]] = []
    bare = [x.strip() for x in lines]
    depth = [len(x) - len(x.lstrip()) for x in lines]
    for i, line in enumerate(lines):
        if not bare[i] or bare[i].startswith("#"):
            continue
        while classes and depth[i] <= classes[-1][0]:
            classes.pop()
        m = re.match(r"(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", bare[i])
        if m:
            start = i
            j = i - 1
            while j >= 0 and (not bare[j] or depth[j] == depth[i] and bare[j].startswith("@")):
                if bare[j]:
                    start = j
                j -= 1
            stop = i + 1
            while stop < len(lines) and (not bare[stop] or bare[stop].startswith("#") or depth[stop] > depth[i]):
                stop += 1
            parent = classes[-1][1] if classes else ""
            kind = "class" if m[1] == "class" else "method" if parent else "function"
            out.append((kind, m[2], parent, start + 1, stop))
            if kind == "class":
                classes.append((depth[i], m[2]))
        elif depth[i] == 0 and (m := re.match(r"([A-Z][A-Z0-9_]*|__all__)\s*(?::[^=]+)?=(?!=)", line)):
            stop = i + 1
            if m[1] == "__all__":  # with its brackets, continued and deeper lines, and the blank lines after it
                opened, goes_on = _balance(line), line.rstrip().endswith("\\")
                while stop < len(lines) and (not bare[stop] or opened > 0 or goes_on or depth[stop] > 0):
                    if bare[stop]:
                        opened, goes_on = opened + _balance(lines[stop]), bare[stop].endswith("\\")
                    stop += 1
            out.append(("variable", m[1], "", i + 1, stop))
    return out


def _balance(line: str) -> int:
    return sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")


_TS_RULES = (
    ("class", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)")),
    ("interface", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)")),
    ("enum", re.compile(r"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)")),
    ("type", re.compile(r"^\s*(?:export\s+)?(?:declare\s+)?type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)")),
)
_TS_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*([A-Za-z_$#][\w$]*)\s*(?:<[^(]*>)?\(")
_TS_WORDS = frozenset({"if", "for", "while", "switch", "catch", "return", "function", "new", "await", "typeof", "super", "constructor"})


def blank_literals(text: str) -> str:
    """The text with the insides of comments, strings and templates blanked, so that braces can be counted; line ends stay."""
    token = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def scan_typescript(text: str) -> list[Row]:
    """Functions, classes, methods with their class, interfaces, types and enums, each up to its closing brace or semicolon."""
    clean = blank_literals(text).split("\n")
    out: list[Row] = []
    depth, classes = 0, []
    for i, line in enumerate(clean):
        while classes and depth <= classes[-1][0]:
            classes.pop()
        found = next(((kind, m[1]) for kind, rx in _TS_RULES if (m := rx.match(line))), None)
        if not found and classes and depth == classes[-1][0] + 1 and (m := _TS_METHOD.match(line)) and m[1] not in _TS_WORDS - {"constructor"}:
            found = ("method", m[1])
        if found:
            kind, name = found
            out.append((kind, name, classes[-1][1] if kind == "method" else "", i + 1, _block_end(clean, i, kind) + 1))
            if kind == "class":
                classes.append((depth, name))
                depth += line.count("{") - line.count("}")
                continue
        depth += line.count("{") - line.count("}")
    return out


def _block_end(lines: list[str], start: int, kind: str) -> int:
    opened, seen, round_ = 0, False, 0
    for i in range(start, len(lines)):
        for c in lines[i]:
            if c in "([":
                round_ += 1
            elif c in ")]":
                round_ -= 1
            elif c == "{":
                opened, seen = opened + 1, True
            elif c == "}":
                opened -= 1
                if seen and opened == 0 and round_ <= 0 and kind != "type":
                    return i
            elif c == ";" and opened == 0 and round_ <= 0:
                return i
        if kind == "type" and opened == 0 and round_ <= 0 and i > start and not re.match(r"\s*[|&]", lines[i + 1] if i + 1 < len(lines) else ""):
            return i
    return len(lines) - 1


def scanned_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, parent, start_line, end_line, chunk) of Python, TypeScript and JavaScript files(path, language, content)."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                lines = (content or "").split("\n")
                for kind, name, parent, a, b in (scan_python if language == "python" else scan_typescript)(content or ""):
                    chunk = "\n".join(lines[a - 1 : b])
                    out.append((path, kind, name, parent, a, b, chunk.strip() if kind == "variable" else chunk))
            yield pd.DataFrame(out, columns=["path", "kind", "name", "parent", "start_line", "end_line", "chunk"])

    wanted = files.where(F.col("language").isin("python", "typescript", "javascript")).select("path", "language", "content")
    return wanted.mapInPandas(run, "path string, kind string, name string, parent string, start_line int, end_line int, chunk string")


def symbol_rows(files: DataFrame, languages: set[str] | None = None) -> DataFrame:
    """Symbols of files(path, language, content), the first of each place, kind and name; ``languages`` are those that the files have, if that is known."""
    rows = scanned_symbols(files)
    if languages is None or languages & LINE_RULES.keys():
        rows = rows.unionByName(line_symbols(files))
    return rows.dropDuplicates(["path", "start_line", "end_line", "kind", "name"])


def chunk_ids(rows: DataFrame) -> DataFrame:
    """rows(path, kind, name, start_line, end_line, chunk) with chunk_id: of a symbol, or of a line window where there is no name."""
    span = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    digest = short_sha1(F.col("path"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("kind"), F.col("name"), F.col("chunk"))
    return rows.withColumn("chunk_id", F.when(F.col("name") == "", chunk_id(F.col("path"))).otherwise(F.concat_ws(":", "path", span, "kind", "name", digest)))


def symbol_chunks(files: DataFrame) -> DataFrame:
    """Symbols of files(path, language, content) as chunks, the first of each place, kind and name; with chunk_id."""
    return chunk_ids(symbol_rows(files))


def route_rows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol rows where a file has any, line windows for all other files; without ids."""
    rest = chunk_files(files.join(symbols.select("path").distinct(), "path", "left_anti"))
    lines = rest.select("path", F.lit("").alias("kind"), F.lit("").alias("name"), F.lit("").alias("parent"), "start_line", "end_line", "chunk")
    return symbols.select(lines.columns).unionByName(lines)


def route_chunks(files: DataFrame) -> DataFrame:
    """Symbol chunks where a file has any, line windows for all other files."""
    return chunk_ids(route_rows(files, symbol_rows(files)))


#: What declares a symbol in a line of any language; the first group is the name.
ANY_LANGUAGE = (
    ("function", r"^[ \t]*(?:export\s+)?function\s+([A-Za-z_$][\w$]*)\s*\("), ("class", r"^[ \t]*(?:export\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"^[ \t]*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("type", r"^[ \t]*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*="),
    ("class", r"^[ \t]*class\s+([A-Za-z_]\w*)"), ("variable", r"^([A-Z][A-Z0-9_]*)(?:\s*:\s*[^=]+)?\s*="),
    ("function", r"^[ \t]*func\s+([A-Za-z_]\w*)\s*\("), ("method", r"^[ \t]*func\s*\(\s*[A-Za-z_]\w*\s+\*?[A-Za-z_]\w*\s*\)\s+([A-Za-z_]\w*)\s*\("),
    ("class", r"^[ \t]*type\s+([A-Za-z_]\w*)\s+struct\b"), ("interface", r"^[ \t]*type\s+([A-Za-z_]\w*)\s+interface\b"),
    ("function", r"^[ \t]*(?:pub\s+)?fn\s+([A-Za-z_]\w*)\s*\("), ("class", r"^[ \t]*(?:pub\s+)?struct\s+([A-Za-z_]\w*)\b"), ("interface", r"^[ \t]*(?:pub\s+)?trait\s+([A-Za-z_]\w*)\b"), ("enum", r"^[ \t]*(?:pub\s+)?enum\s+([A-Za-z_]\w*)\b"),
    ("class", r"^[ \t]*(?:data\s+|sealed\s+|open\s+|abstract\s+)?class\s+([A-Za-z_]\w*)\b"), ("interface", r"^[ \t]*(?:sealed\s+)?interface\s+([A-Za-z_]\w*)\b"), ("type", r"^[ \t]*typealias\s+([A-Za-z_]\w*)\b"), ("function", r"^[ \t]*(?:suspend\s+)?fun\s+(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*)\s*\("),
)
_DEF, _CLASS = re.compile(r"^\s*def\s+([A-Za-z_]\w*)\s*\("), re.compile(r"^\s*class\s+([A-Za-z_]\w*)\s*(?:\([^)]*\))?\s*:")
_REEXPORT = re.compile(r"^\s*from\s+[.A-Za-z0-9_]+\s+import\s+(.+)$")


def python_extras(path: str, content: str) -> list[Row]:
    """What the patterns of ANY_LANGUAGE leave out in Python: functions and methods, ``__all__``, and the names that a package passes on as modules."""
    out: list[Row] = [r for r in scan_python(content) if r[1] == "__all__"]
    classes: list[int] = []
    for n, line in enumerate(content.split("\n"), 1):
        bare, indent = line.strip(), len(line) - len(line.lstrip())
        if bare and not bare.startswith("#"):
            while classes and indent <= classes[-1]:
                classes.pop()
        if _CLASS.match(line):
            classes.append(indent)
        if m := _DEF.match(line):
            out.append(("method" if classes else "function", m[1], "", n, n))
        elif path.rsplit("/", 1)[-1] == "__init__.py" and (m := _REEXPORT.match(line)):
            clause = m[1].split("#")[0].strip().strip("()")
            names = [re.split(r"\s+as\s+", x.strip())[-1].strip() for x in clause.split(",")]
            out += [("module", x, "", n, n) for x in names if x and x != "*"]
    return out


def _sql(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def extracted_symbols(files: DataFrame, languages: set[str] | None = None) -> DataFrame:
    """(path, kind, name, start_line, end_line) by patterns alone, whatever the language of files(path, content), each once; ``languages`` as in ``symbol_rows``.

    All patterns are tried on a line in one pass, native; what depends on the lines before is read from Python files alone.
    """
    hits = F.expr("array_compact(array(" + ", ".join(f"CASE WHEN text RLIKE {_sql(p)} THEN struct('{k}' AS kind, regexp_extract(text, {_sql(p)}, 1) AS name) END" for k, p in ANY_LANGUAGE) + "))")
    lines = file_lines(files).select("path", F.col("line").cast("int").alias("start_line"), F.explode(hits).alias("s"))
    rows = lines.select("path", "s.kind", "s.name", "start_line", F.col("start_line").alias("end_line"))

    def run(batches):
        for pdf in batches:
            out = [(p, k, n, a, b) for p, c in zip(pdf["path"], pdf["content"]) for k, n, _, a, b in python_extras(p.rsplit("\x1f", 1)[-1], (c or "").replace("\r\n", "\n"))]
            yield pd.DataFrame(out, columns=["path", "kind", "name", "start_line", "end_line"])

    if languages is not None and "python" not in languages:
        return rows.dropDuplicates(["path", "start_line", "kind", "name"])
    python = files.where(P.extension(F.col("path")) == "py").select("path", "content")
    extras = python.mapInPandas(run, "path string, kind string, name string, start_line int, end_line int")
    return rows.unionByName(extras).dropDuplicates(["path", "start_line", "kind", "name"])


def merged_symbols(scanned: DataFrame, extracted: DataFrame) -> DataFrame:
    """(path, kind, name, start_line, end_line, chunk_id, origin): what scanners found, and what patterns add; one row for each place, kind and name, the scanner's first."""
    cols = ["path", "kind", "name", "start_line", "end_line", "chunk_id"]
    if "chunk_id" not in extracted.columns:
        extracted = extracted.withColumn("chunk_id", F.lit(None).cast("string"))
    one, two = scanned.select(*cols, F.lit("scanner").alias("origin")), extracted.select(*cols, F.lit("pattern").alias("origin"))
    return merged(one, two, ["path", "start_line", "kind", "name"], ["end_line"])


def exported_names(content: str) -> list[str]:
    """Names in a Python file's ``__all__``."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            return [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return []
