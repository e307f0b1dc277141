"""Convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of those of its hash and of the hashes of its first four and five letters, so inflected
forms share a stem. Filters of several widths slide over the whole text, and each filter keeps its maximum. As
convolution is linear before the maximum, scoring adds up rows of tables that hold each hash's product with each filter
position; no text is cut short.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, fold, labelled_sample, table

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 12
#: The fit's bound: rows of each class at most, and characters of a row at most.
PER_CLASS = {1: 1500, 0: 3000}
MAX_CHARS = 40_000
CHUNK = 1 << 17
WORD = re.compile(r"\w+")
STEMS = (4, 5)
PARTS = 1 + len(STEMS)
_known: dict[str, int] = {}
_rows = np.zeros((1 << 10, PARTS), np.int32)


def _hashed(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS + 1


def word_ids(text: str | None) -> np.ndarray:
    """Hashed ids, from 1, of each word and of its stems, one row for each word; 0 is padding."""
    global _rows
    words = WORD.findall((text or "").lower())
    if len(_known) > 400_000:
        _known.clear()
    at = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        x = _known.get(w)
        if x is None:
            x = _known[w] = len(_known)
            if x >= len(_rows):
                _rows = np.concatenate((_rows, np.zeros_like(_rows)))
            _rows[x] = (_hashed(w), *(_hashed(f"{w[:k]}|{k}") if len(w) >= k else 0 for k in STEMS))
        at[i] = x
    return _rows[at]


@dataclass
class TextCnn:
    embed: np.ndarray
    filters: list[np.ndarray]  # one (width, DIM, FILTERS) array for each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embed @ w[o]).astype(np.float32) for o in range(len(w))] for w in self.filters]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return self.slope * (np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias) + self.shift


def pooled(tables: list[list[np.ndarray]], docs: list[np.ndarray]) -> np.ndarray:
    """The maximum of each filter over each document. Long documents are taken in overlapping chunks, so all of the text counts."""
    widest = len(tables[-1])
    out = np.full((len(docs), len(tables) * FILTERS), -np.inf, np.float32)
    pieces, owners, valid, size = [], [], [], 0

    def flush():
        nonlocal pieces, owners, valid, size
        if not pieces:
            return
        tail = np.zeros((widest - 1, PARTS), np.int32)
        ids = np.concatenate([x for p in pieces for x in (p, tail)])
        starts = np.cumsum([0, *(len(p) + widest - 1 for p in pieces[:-1])])
        body = len(ids) - (widest - 1)
        # windows begin at a chunk's own words alone, not at its overlap or padding
        edges = np.stack((starts, starts + valid), axis=1).ravel()
        edges = edges[:-1] if edges[-1] >= body else edges
        for k, parts in enumerate(tables):
            conv = parts[0][ids[:body, 0]]
            for o in range(len(parts)):
                for j in range(PARTS):
                    if o or j:
                        conv += parts[o][ids[o : body + o, j]]
            np.maximum.at(out[:, k * FILTERS : (k + 1) * FILTERS], owners, np.maximum.reduceat(conv, edges)[::2])
        pieces, owners, valid, size = [], [], [], 0

    for i, doc in enumerate(docs):
        if not len(doc):
            doc = np.zeros((1, PARTS), np.int32)
        for a in range(0, len(doc), CHUNK):
            pieces.append(doc[a : a + CHUNK + widest - 1])
            owners.append(i)
            valid.append(min(CHUNK, len(doc) - a))
            size += len(pieces[-1])
            if size > CHUNK:
                flush()
    flush()
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], y: np.ndarray, langs: list[str], seed: int = 7) -> TextCnn:
    """Train on four fifths, then fit slope and shift of the logit and each language's threshold on the rest.

    With no rows, or rows of one class alone, every text scores the share of label 1 (or 0.5).
    """
    rng = np.random.default_rng(seed)
    model = TextCnn(
        embed=rng.normal(0, 0.05, (BUCKETS + 1, DIM)), filters=[rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS],
        bias=np.zeros(len(WIDTHS) * FILTERS), out=rng.normal(0, 0.1, len(WIDTHS) * FILTERS),
    )
    model.embed[0] = 0
    if len(set(y.tolist())) < 2:
        share = float(np.mean(y)) if len(y) else 0.5
        model.slope, model.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    docs = [word_ids(t) for t in texts]
    rest = rng.permutation(len(docs))
    check, train = rest[: len(rest) // 5], rest[len(rest) // 5 :]
    if len(set(y[check].tolist())) < 2:
        check = rest
    # The first dimension starts from each bucket's smoothed log-odds of being in a document of label 1.
    seen = np.zeros((2, BUCKETS + 1))
    for i in train:
        seen[y[i], np.unique(docs[i])] += 1
    seen[:, 0] = 0
    n = np.bincount(y[train], minlength=2)
    odds = np.log((seen[1] + 0.2) / (n[1] + 0.4)) - np.log((seen[0] + 0.2) / (n[0] + 0.4))
    sure = np.minimum(seen.sum(0) / 4, 1)
    model.embed[1:, 0] = np.clip(odds * sure, -1, 4)[1:] / 2
    for w in model.filters:
        w[:, 0, : FILTERS // 2] = np.abs(w[:, 0, : FILTERS // 2]) + 0.3
    params = [*model.filters, model.bias, model.out]
    speed = [np.full(p.shape, 1e-3) for p in params]
    embed_speed = np.full(BUCKETS + 1, 1e-3)
    bias_speed = 1e-3
    weight = np.where(y == 1, len(train) / (2 * max(n[1], 1)), len(train) / (2 * max(n[0], 1)))
    for _ in range(EPOCHS):
        train = rng.permutation(train)
        for start in range(0, len(train), 32):
            batch = train[start : start + 32]
            grads = [np.zeros(p.shape) for p in params]
            g_bias, touched, g_embed = 0.0, [], []
            for i in batch:
                ids = np.concatenate((docs[i], np.zeros((WIDTHS[-1], PARTS), np.int32)))
                x = model.embed[ids].sum(axis=1)
                body = max(1, len(docs[i]))
                tops, peaks = [], []
                for w in model.filters:
                    conv = sum(x[o : body + o] @ w[o] for o in range(len(w)))
                    top = conv.argmax(0)
                    tops.append(top)
                    peaks.append(conv[top, np.arange(FILTERS)])
                z = np.concatenate(peaks) + model.bias
                a = np.maximum(z, 0)
                d = (sigmoid(a @ model.out + model.out_bias) - y[i]) * weight[i]
                g_bias += d
                grads[-1] += d * a
                da = d * model.out * (z > 0)
                grads[-2] += da
                for k, (w, top) in enumerate(zip(model.filters, tops)):
                    dk = da[k * FILTERS : (k + 1) * FILTERS]
                    for o in range(len(w)):
                        grads[k][o] += (x[top + o] * dk[:, None]).T
                        touched.append(ids[top + o].ravel())
                        g_embed.append(np.repeat((w[o] * dk).T, PARTS, axis=0))
            for p, g, s in zip(params, grads, speed):
                g = g / len(batch) + 1e-5 * p
                s += g * g
                p -= 0.05 * g / np.sqrt(s)
            g_bias /= len(batch)
            bias_speed += g_bias**2
            model.out_bias -= 0.05 * g_bias / bias_speed**0.5
            rows, g = np.concatenate(touched), np.concatenate(g_embed) / len(batch)
            u, inv = np.unique(rows, return_inverse=True)
            total = np.zeros((len(u), DIM))
            np.add.at(total, inv, g)
            embed_speed[u] += (total**2).mean(1)
            model.embed[u] -= 0.02 * total / np.sqrt(embed_speed[u])[:, None]
            model.embed[0] = 0
    _calibrate(model, model.logits(pooled(model.tables(), [docs[i] for i in check])), y[check], [langs[i] for i in check])
    return model


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between scores where F1 is highest."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # no cut inside a tie
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


def _calibrate(model: TextCnn, logits: np.ndarray, y: np.ndarray, langs: list[str]) -> None:
    """Put the best cut at 0.5 and scale the logit so that its spread is moderate; then a cut for each language that has enough rows."""
    cut = best_cut(logits, y)
    slope = 3 / max(float(np.std(logits)), 1e-6)
    model.slope, model.shift = slope, -slope * cut
    scaled = sigmoid(slope * (logits - cut))
    langs = np.array([x or "" for x in langs])
    for lang in sorted(set(langs)):
        own = langs == lang
        if y[own].sum() >= 5 and (1 - y[own]).sum() >= 5:
            model.thresholds[str(lang)] = min(0.99, max(0.01, best_cut(scaled[own], y[own])))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class=None, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold and flagged of every row of docs(doc_id, text, lang).

    The fit takes at most ``per_class`` rows of each label outside the held-out fold. The score depends on the text
    alone; lang only chooses the threshold behind ``flagged`` (0.5 for languages without enough rows to calibrate).
    A null or wordless text is scored as one padding word. held_out is false for a null doc_id. Repeated rows stay; an
    empty table gives an empty result, and with no usable labels every score is 0.5.
    """
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", folds, held, per_class or PER_CLASS, max_chars)
    model = fit(sample["text"].tolist(), sample["y"].to_numpy(np.int64), sample["lang"].tolist())
    sent = docs.sparkSession.sparkContext.broadcast((model.tables(), model.bias, model.out, model.out_bias, model.slope, model.shift))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        tables, bias, out, out_bias, slope, shift = sent.value
        found = []
        for a in range(0, len(texts), 256):
            p = pooled(tables, [word_ids(t) for t in texts.iloc[a : a + 256]])
            found.append(sigmoid(slope * (np.maximum(p + bias, 0) @ out + out_bias) + shift))
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    cuts = F.lit(0.5)
    for lang, cut in model.thresholds.items():
        cuts = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(cuts)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), score(F.col("text").cast("string")).alias("score"))
    return rows.select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        cuts.alias("lang_threshold"), (F.col("score") >= cuts).cast("int").alias("flagged"),
    )


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
