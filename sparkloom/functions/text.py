"""Text expressions: lines, windows, tokens, HTML. All are built-in functions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities and what they stand for, in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))


def lines(text: Column) -> Column:
    """The lines of a text; an empty array for an empty or null text."""
    return F.when(F.length(text) > 0, F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")).otherwise(F.array().cast("array<string>"))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def camel_tokens(text: Column) -> Column:
    """Lower-case tokens of [a-z0-9], split at camel-case borders and everything else, with repeats."""
    split = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.filter(split, lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Lower-case tokens of [a-z0-9_], with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), lambda t: t != "")


def coverage(query: Column, candidate: Column) -> Column:
    """The share of the query's tokens, repeats counted, that the candidate has; 0 for an empty query."""
    hits = F.size(F.filter(query, lambda t: F.array_contains(candidate, t)))
    return F.when(F.size(query) > 0, hits / F.size(query)).otherwise(0.0)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return F.when(n > 0, F.array_max(same)).otherwise(0)


def ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))).otherwise(text)


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>", " ")


def decode_entities(text: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    for name, char in entities:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_to_text(html: Column) -> Column:
    """Readable text: breaks and block ends as line ends, list items with a dash, other tags as spaces, white space collapsed."""
    x = without_scripts(html)
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</(p|h[1-6])>", "\n\n")
    x = F.regexp_replace(x, r"(?i)<li[^>]*>", "- ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = decode_entities(x)
    x = F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")
    x = F.regexp_replace(x, r" *\n *", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(x)


def title(html: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    """The text of <title>, in which tags are no tags, white space collapsed; empty if there is none, null for null."""
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.regexp_replace(F.regexp_replace(decode_entities(t, entities), r"[ \t\n\f\r]+", " "), r"^ | \z", "")


def page_title(html: Column, fallback: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    """The text of <title>; the fallback if there is none."""
    t = title(html, entities)
    return F.when(t != "", t).otherwise(fallback)
