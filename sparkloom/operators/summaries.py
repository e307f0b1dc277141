"""What the head of a file says about it: its leading comment or module docstring, and its package; folds over the lines, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

QUOTES = ('"""', "'''")


def _fold(lines: Column, step) -> Column:
    """The state (phase, out) after all lines; step(phase, line, trimmed) gives the next phase and what the line adds, null for nothing.

    Nothing is added once the phase is ``done``, so a long file costs one look at each line.
    """
    start = F.struct(F.lit("start").alias("phase"), F.array().cast("array<string>").alias("out"))

    def next_(acc: Column, line: Column) -> Column:
        phase, added = step(acc["phase"], line, T.strip(line))
        out = F.when((acc["phase"] == "done") | added.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(added)))
        return F.struct(F.when(acc["phase"] == "done", "done").otherwise(phase).alias("phase"), out.alias("out"))

    return F.aggregate(lines, start, next_)


def cleaned(text: Column) -> Column:
    """Trimmed lines, without blank ends; null for an empty one."""
    out = T.strip(F.array_join(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), T.strip), "\n"))
    return F.when(out != "", out)


def leading_comment(content: Column) -> Column:
    """The text of the comment that a file begins with, after a ``#!`` line and blank ones: of ``//`` or ``#`` lines, or a block; null without one."""
    lines = T.lines(F.regexp_replace(content, "^﻿", ""))
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    lines = F.when(F.startswith(first, F.lit("#!")), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)

    def step(phase: Column, line: Column, bare: Column):
        fresh = F.when(F.startswith(bare, F.lit("//")), "//").when(F.startswith(bare, F.lit("#")), "#").when(F.startswith(bare, F.lit("/*")), "/*").when(bare == "", "start").otherwise("done")
        kind = F.when(phase == "start", fresh).when(phase == "/*", "/*").when(F.startswith(bare, phase), phase).otherwise("done")
        added = F.when(kind == "//", F.regexp_replace(bare, r"^//\s?", "")).when(kind == "#", F.regexp_replace(bare, r"^#\s?", "")).when(kind == "/*", F.concat(F.lit("\x00"), line))
        return F.when((kind == "/*") & F.contains(line, F.lit("*/")), "done").otherwise(kind), added

    text = F.array_join(_fold(lines, step)["out"], "\n")
    block = F.replace(text, F.lit("\x00"), F.lit(""))
    block = F.regexp_replace(F.regexp_replace(F.regexp_replace(block, r"^\s*/\*", ""), r"\*/\s*$", ""), r"(?m)^\s*\*\s?", "")
    return cleaned(F.when(F.startswith(text, F.lit("\x00")), block).otherwise(text))


def module_docstring(content: Column) -> Column:
    """The docstring of a Python module: the first thing after comments and blank lines, to its closing quotes or the end; else null."""
    one, two = QUOTES

    def step(phase: Column, line: Column, bare: Column):
        opening = F.when(F.startswith(bare, F.lit(one)), one).when(F.startswith(bare, F.lit(two)), two)
        quote = F.when(phase == "start", opening).otherwise(phase)
        rest = F.when(phase == "start", F.substring(F.ltrim(line), F.lit(4), F.length(line))).otherwise(line)
        skipped = (phase == "start") & ((bare == "") | F.startswith(bare, F.lit("#")))
        ends = F.contains(rest, quote)
        added = F.when(~skipped & quote.isNotNull(), F.when(ends, F.substring(rest, F.lit(1), F.instr(rest, quote) - 1)).otherwise(rest))
        return F.when(skipped, "start").when(quote.isNull() | ends, "done").otherwise(quote), added

    return cleaned(F.array_join(_fold(T.lines(content), step)["out"], "\n"))


def package_of(path: Column, content: Column) -> Column:
    """(label, value): the package that a Go, Kotlin or Java file declares, or a Python file's module; null for others."""
    lang = P.summary_language(path)
    declared = F.regexp_extract(content, r"(?m)^\s*package\s+([A-Za-z0-9_.]+)\b", 1)
    module = F.regexp_replace(F.regexp_replace(path, r"(^|/)__init__\.py$", ""), r"\.py$", "")
    module = F.regexp_replace(F.replace(module, F.lit("/"), F.lit(".")), r"^\.+|\.+$", "")
    say = lambda label, value: F.when(value != "", F.struct(F.lit(label).alias("label"), value.alias("value")))
    return F.when(lang.isin("go", "kotlin", "java"), say("Package", declared)).when(lang == "python", say("Module", module))


def described(files: DataFrame) -> DataFrame:
    """(path, language, doc, package) of files(path, content); ``package`` reads like ``Package: main``. Null contents have neither."""
    path, content = F.col("path"), F.col("content")
    block = leading_comment(content)
    doc = F.when(P.summary_language(path) == "python", F.coalesce(module_docstring(content), block)).otherwise(block)
    package = package_of(path, content)
    return files.select("path", P.summary_language(path).alias("language"), doc.alias("doc"), F.concat(package["label"], F.lit(": "), package["value"]).alias("package"))
