"""Content addresses and the hash embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def git_blob(content: Column) -> Column:
    """The git object id of a blob: sha1 of ``blob <bytes>``, NUL and the bytes."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string"), F.chr(F.lit(0))).cast("binary"), data))


def short_sha1(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 16)


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII token, as a signed number."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)
