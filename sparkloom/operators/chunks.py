"""Table-generating chunkers: line windows and character windows. Symbol chunkers are in ``symbols``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import short_sha1

WINDOW, OVERLAP = 80, 20
NARROW_WINDOW, NARROW_OVERLAP = 32, 8
DOC_CHARS, DOC_FLOOR, DOC_OVERLAP = 1400, 200, 200


def is_narrow(path: Column, language: Column) -> Column:
    """Markdown and transcripts take the narrow window."""
    return (language == "markdown") | F.lower(path).endswith(".md") | F.contains(F.lower(path), F.lit("transcript"))


def line_windows(files: DataFrame, window: int | Column = WINDOW, overlap: int | Column = OVERLAP, path: str = "path", content: str = "content") -> DataFrame:
    """files and start_line, end_line (from 1, both inside), chunk and chunk_id, a row for each window of lines that isn't blank.

    A window of ``window`` lines starts every ``window - overlap`` lines until one reaches the end. Null and empty contents have none.
    """
    if isinstance(window, int) and isinstance(overlap, int) and not (window > 0 and 0 <= overlap < window):
        raise ValueError("the window must be positive and the overlap smaller than it")
    w = window if isinstance(window, Column) else F.lit(window)
    s = w - (overlap if isinstance(overlap, Column) else F.lit(overlap))
    rows = files.withColumn("_lines", T.lines(F.col(content))).where(F.size("_lines") > 0)
    n = F.size("_lines")
    count = F.when(n <= w, F.lit(1)).otherwise(F.ceil((n - w) / s) + 1).cast("int")

    # windows are cut before they are exploded, so that no row carries all lines of its file
    def part(k: Column) -> Column:
        chunk = T.rstrip(F.array_join(F.slice("_lines", k * s + 1, w), "\n"))
        return F.struct((k * s + 1).cast("int").alias("start_line"), F.least(k * s + w, n).cast("int").alias("end_line"), chunk.alias("chunk"))

    rows = rows.select(*files.columns, F.explode(F.transform(F.sequence(F.lit(0), count - 1), part)).alias("_w"))
    rows = rows.select(*files.columns, "_w.start_line", "_w.end_line", "_w.chunk").where("chunk <> ''")
    return rows.withColumn("chunk_id", chunk_id(F.col(path).cast("string")))


def chunk_id(path: Column) -> Column:
    span = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    return F.concat(path, F.lit(":"), span, F.lit(":"), short_sha1(path, F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("chunk")))


def chunk_files(files: DataFrame) -> DataFrame:
    """Line windows of files(path, content, language), narrow for markdown and transcripts."""
    narrow = is_narrow(F.col("path"), F.col("language"))
    return line_windows(files, F.when(narrow, NARROW_WINDOW).otherwise(WINDOW), F.when(narrow, NARROW_OVERLAP).otherwise(OVERLAP))


def split_doc(text: str | None, most: int = DOC_CHARS, overlap: int = DOC_OVERLAP) -> Iterator[str]:
    """Windows of at most ``most`` characters, cut at the last blank line or sentence end in their second half.

    The next window starts ``overlap`` characters before the end of the trimmed one, so offsets depend on each other and
    one text is read from front to back.
    """
    text = re.sub(r"^\s+|\s+$", "", text or "")
    most = max(DOC_FLOOR, most)
    at = 0
    while at < len(text):
        stop = min(len(text), at + most)
        part = text[at:stop]
        if stop < len(text):
            cut = max(part.rfind("\n\n"), part.rfind(". "))
            if cut > most // 2:
                part = part[: cut + 1]
        end = at + len(part)
        part = re.sub(r"^\s+|\s+$", "", part)
        if part:
            yield part
        if end >= len(text):
            break
        at += max(1, len(part) - overlap)


def doc_chunks(docs: DataFrame, key: str, content: str = "content", most: int = DOC_CHARS, overlap: int = DOC_OVERLAP) -> DataFrame:
    """key, chunk_index and chunk of docs(key, content)."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return pd.Series([list(split_doc(t, most, overlap)) for t in texts])

    return docs.select(key, F.posexplode(parts(content)).alias("chunk_index", "chunk"))
