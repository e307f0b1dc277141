"""Path expressions and the helpers that turn a user's pattern into one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension to language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "kt": "kotlin",
    "kts": "kotlin", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "md": "markdown", "json": "json",
}
#: The fewer languages that a file's summary tells apart.
SUMMARY_LANGUAGES = ("typescript", "javascript", "python", "go", "rust", "kotlin", "java", "markdown", "json")
#: Directory and file names that a scan leaves out.
IGNORED = (
    "node_modules", ".git", ".next", "dist", "build", "coverage", "target", "vendor", "__pycache__", ".venv", "venv", ".mypy_cache", ".ruff_cache",
    ".pytest_cache", ".tox",
)
#: Base names and path segments of secrets, in any case.
SECRET_NAMES = r"(?i)(^|/)(\.env(\..+)?|id_(rsa|ed25519)(\.pub)?|[^/]*\.(pem|key|p12|pfx|secret)|credentials\.json|tokens?\.json|\.pypirc|\.npmrc)$"
SECRET_SEGMENTS = r"(?i)(^|/)(\.ssh|secrets?|private)(/|$)"
#: Languages and extensions that count as code.
CODE_LANGUAGES = ("typescript", "javascript", "python", "go", "rust", "kotlin", "java", "c", "cpp", "csharp", "swift", "scala")
CODE_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "kt", "kts", "java", "c", "cc", "cpp", "cxx", "h", "hpp", "cs", "swift", "scala")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case, without the dot; empty for names without one or that start with their only one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[extension(path)], F.lit("text"))


def summary_language(path: Column) -> Column:
    """As ``language``, with text for those that summaries don't tell apart."""
    found = language(path)
    return F.when(found.isin(*SUMMARY_LANGUAGES), found).otherwise("text")


def is_secret(path: Column) -> Column:
    return path.rlike(SECRET_NAMES) | path.rlike(SECRET_SEGMENTS)


def is_ignored(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """A segment of the path is an ignored name; of an exclude glob the last segment without wildcards counts."""
    plain = [next((s for s in reversed(x.split("/")) if s and not re.search(r"[*?\[]", s)), "") for x in extra]
    names = F.array(*[F.lit(x) for x in (*IGNORED, *filter(None, plain))])
    return F.arrays_overlap(F.split(path, "/"), names)


def is_code(path: Column, lang: Column | None = None) -> Column:
    return F.lower(lang if lang is not None else language(path)).isin(*CODE_LANGUAGES) | extension(path).isin(*CODE_EXTENSIONS)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: ``*`` and ``?`` stay within a segment, ``**`` crosses, ``[...]`` and ``{a,b}`` choose."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if pattern[i : i + 3] == "**/":
                out += "(?:[^/]+/)*"
                i += 2
            elif pattern[i : i + 2] == "**":
                out += ".*"
                i += 1
            else:
                out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            stop = pattern.find("]", i + 2)
            if stop < 0:
                raise ValueError(f"unclosed [ in {pattern!r}")
            inner = pattern[i + 1 : stop].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]"
            i = stop
        elif c == "{" and "}" in pattern[i:]:
            stop = pattern.index("}", i)
            out += "(?:" + "|".join(re.escape(x) for x in pattern[i + 1 : stop].split(",")) + ")"
            i = stop
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches(path: Column, pattern: str) -> Column:
    """A pattern with ``*``, ``?`` or ``[`` is a glob on the path and, without a slash, on its base name; else it is a part in any case.

    A glob that can't be read is a part too.
    """
    if re.search(r"[*?\[]", pattern):
        try:
            rx = glob_regex(pattern)
        except ValueError:
            rx = None
        if rx is not None:
            whole = path.rlike(rx)
            return whole if "/" in pattern else whole | basename(path).rlike(rx)
    return F.contains(F.lower(path), F.lit(pattern.lower()))


def same_or_suffix(a: Column, b: Column) -> Column:
    """Equal, or one is the tail of the other from a slash on."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def jailed(path: str, roots: list[str] | None = None) -> str:
    """A root-relative path from a user's argument; ValueError for empty, secret, outside or upward ones."""
    p = path.strip().replace("\\", "/")
    if not p:
        raise ValueError("the path is empty")
    if p.startswith("/"):
        root = next((r for r in sorted(roots or [], key=len, reverse=True) if p == r or p.startswith(r.rstrip("/") + "/")), None)
        if root is None:
            raise ValueError("the path is outside the roots")
        p = p[len(root.rstrip("/")) :].lstrip("/")
    p = re.sub(r"^(\./)+", "", p)
    if ".." in p.split("/"):
        raise ValueError("the path leads upward")
    if re.search(SECRET_NAMES, p) or re.search(SECRET_SEGMENTS, p):
        raise ValueError("the path is secret")
    return p
