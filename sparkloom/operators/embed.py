"""Embedding providers. The hash embedding is native; a model runs as a Pandas UDF if one is installed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a
from ..functions.text import word_tokens


class EmbeddingProvider(Protocol):
    """Adds a vector column to a DataFrame."""

    dimensions: int

    def embed(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame: ...


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


class HashEmbedder:
    """Token hashes counted into slots, in an Arrow batch at a time.

    Each token adds 1 at |FNV-1a| mod the dimensions and a half 17 places on; the vector is scaled to length 1, and no tokens
    give the first unit vector.
    """

    def __init__(self, dimensions: int = 64):
        if dimensions < 1:
            raise ValueError("an embedding has at least one dimension")
        self.dimensions = dimensions

    def embed(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        dim = self.dimensions

        @F.pandas_udf("array<double>")
        def vectors(texts: pd.Series) -> pd.Series:
            return pd.Series([_hashed(t, dim) for t in texts])

        return df.withColumn(out, vectors(F.col(text).cast("string")))


_WORDS = re.compile("[a-z0-9_]+")


def _hashed(text: str | None, dim: int) -> np.ndarray:
    places = np.fromiter(map(_hashes.__getitem__, _WORDS.findall((text or "").lower())), np.int64)
    if not len(places):
        return np.eye(1, dim)[0]
    if len(_hashes) > MOST_HASHES:
        _hashes.clear()
    counts = np.bincount(places % dim, minlength=dim)
    v = counts + 0.5 * np.roll(counts, 17)
    return v / np.sqrt((v * v).sum())  # a sum of quarters, exact in any order


class _Hashes(dict):
    """|FNV-1a| of the words met so far."""

    def __missing__(self, word: str) -> int:
        h = 2166136261
        for c in word.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        self[word] = found = abs(h - (1 << 32) if h >> 31 else h)
        return found


_hashes = _Hashes()
MOST_HASHES = 500_000  # of a worker, between texts


class NativeHashEmbedder(HashEmbedder):
    """The same vectors from built-in functions alone: an explode, two grouped sums and a join back by ``key``."""

    def __init__(self, key: str, dimensions: int = 64):
        super().__init__(dimensions)
        self.key = key

    def embed(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        dim, key = self.dimensions, self.key
        tokens = df.select(key, F.explode(word_tokens(F.col(text))).alias("t")).groupBy(key, "t").count()
        slots = tokens.select(key, (F.abs(fnv1a(F.col("t"))) % dim).alias("i"), "count")
        both = slots.select(key, F.explode(F.array(F.struct("i", F.col("count").cast("double").alias("x")), F.struct(((F.col("i") + 17) % dim).alias("i"), (F.col("count") * 0.5).alias("x")))).alias("p"))
        sums = both.groupBy(key, "p.i").agg(F.sum("p.x").alias("x"))
        maps = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("_m"))
        places = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
        vector = F.transform(places, lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
        first = F.transform(places, lambda i: F.when(i == 0, 1.0).otherwise(0.0))
        return df.join(maps, key, "left").withColumn(out, F.when(F.col("_m").isNull(), first).otherwise(_unit(vector))).drop("_m")


class OnnxEmbedder:
    """Mean-pooled, normalised sentence embeddings from a local ONNX model and tokenizer file; needs ``onnxruntime``."""

    def __init__(self, model: str, tokenizer: str, dimensions: int):
        self.model, self.tokenizer, self.dimensions = model, tokenizer, dimensions

    def embed(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        model, tokenizer, dim = self.model, self.tokenizer, self.dimensions

        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer)
            tok.enable_padding()
            tok.enable_truncation(512)
            session = onnxruntime.InferenceSession(model)
            names = {i.name for i in session.get_inputs()}
            for texts in batches:
                found = []
                for a in range(0, len(texts), 32):
                    enc = tok.encode_batch([t or "" for t in texts.iloc[a : a + 32]])
                    ids, mask = (np.array([getattr(e, k) for e in enc], np.int64) for k in ("ids", "attention_mask"))
                    feed = {k: v for k, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", ids * 0)) if k in names}
                    v = (session.run(None, feed)[0] * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    found += list(np.pad(v[:, :dim], ((0, 0), (0, max(0, dim - v.shape[1])))))
                yield pd.Series(found)

        return df.withColumn(out, F.pandas_udf(vectors, "array<double>")(F.col(text).cast("string")))


def provider(name: str = "hash", fallback: bool = True, **options) -> tuple[EmbeddingProvider, str | None]:
    """A provider by name, and a warning if the hash embedder stands in for one that can't be loaded."""
    if name == "hash":
        return HashEmbedder(options.get("dimensions", 64)), None
    if name == "onnx":
        try:
            import onnxruntime  # noqa: F401
            from tokenizers import Tokenizer

            Tokenizer.from_file(options["tokenizer"])
            return OnnxEmbedder(options["model"], options["tokenizer"], options["dimensions"]), None
        except Exception as e:  # a missing library or file
            if not fallback:
                raise
            return HashEmbedder(options.get("dimensions", 64)), f"the hash embedding is used, as the model can't be loaded: {e}"
    raise ValueError(f"no embedding provider is called {name!r}")
