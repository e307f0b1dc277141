"""Web documents: a fetched or stored page to titled text, and its chunks for the store."""

from __future__ import annotations

from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunks import DOC_CHARS, DOC_OVERLAP, doc_chunks


def fetch(urls: DataFrame, timeout: float = 20.0) -> DataFrame:
    """(url, content_type, body, error) of urls(url); a failed fetch is a row with an error, so the others go on."""

    def run(batches):
        for pdf in batches:
            out = []
            for url in pdf["url"]:
                try:
                    with urlopen(url, timeout=timeout) as r:
                        charset = r.headers.get_content_charset() or "utf-8"
                        out.append((url, r.headers.get_content_type(), r.read().decode(charset, "replace"), None))
                except Exception as e:  # any of many network errors
                    out.append((url, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "content_type", "body", "error"])

    return urls.select("url").mapInPandas(run, "url string, content_type string, body string, error string")


def readable(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """(url, title, content) of pages(url, content_type, body): HTML by its type or look becomes text; a selector only marks the title."""
    html = F.coalesce(F.contains(F.lower("content_type"), F.lit("html")), F.lit(False)) | F.col("body").rlike(r"(?i)^\s*<(!doctype html|html)\b")
    title = F.when(html, T.page_title(F.col("body"), F.col("url"))).otherwise(F.col("url"))
    if selector:
        title = F.concat(title, F.lit(f" ({selector})"))
    return pages.where("body is not null").select("url", title.alias("title"), F.when(html, T.html_to_text(F.col("body"))).otherwise(T.strip(F.col("body"))).alias("content"))


def chunked(docs: DataFrame, most: int = DOC_CHARS, overlap: int = DOC_OVERLAP) -> DataFrame:
    """docs_chunks(url, chunk_index, title, content, updated_at) of docs(url, title, content)."""
    parts = doc_chunks(docs, "url", "content", most, overlap)
    rows = parts.join(docs.select("url", "title"), "url")
    return rows.select("url", F.col("chunk_index").cast("int").alias("chunk_index"), "title", F.col("chunk").alias("content"), F.current_timestamp().alias("updated_at"))
