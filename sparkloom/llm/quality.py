"""Quality classifier by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages. Every passage of the whole text is encoded, gated attention learned from document
labels weighs the passages, and the document's score is that of the weighted passage representation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, fold, labelled_sample, table
from .words import words_in

PASSAGE = 64  # words
WORD_DIMS, SHAPE_DIMS = 64, 64
HIDDEN, GATE = 24, 16
EPOCHS = 40
#: The fit's bound: rows of each class at most, and characters of a row at most.
PER_CLASS = {0: 2000, 1: 3000}
MAX_CHARS = 40_000
#: Passages whose features are held at a time, and bytes of short texts that are taken together.
CHUNK, BATCH = 4096, 1 << 18

SPACE, LOWER, UPPER, DIGIT, PUNCT, OTHER = range(6)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:33] = SPACE
_KIND[33:127] = PUNCT
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[ord("A") : ord("Z") + 1] = UPPER
_KIND[ord("a") : ord("z") + 1] = LOWER
STATS = 16
DIMS = STATS + 32 + SHAPE_DIMS + WORD_DIMS


def encode(texts: list[str | None]):
    """Features of the passages of whole texts, CHUNK passages at a time, and the text each passage belongs to.

    A text without words is one empty passage. What a feature says of a text (its words, the share of distinct ones, which
    stand there first) is taken from the whole of it.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join([*parts, b""])
    starts, ends, h = words_in(joined)
    data = np.frombuffer(joined, np.uint8)
    text = np.searchsorted(np.cumsum([0, *(len(p) + 1 for p in parts)]), starts, side="right") - 1
    n_words = np.bincount(text, minlength=len(parts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(n_passages) - n_passages
    owner = np.repeat(np.arange(len(parts)), n_passages)
    passage = first[text] + (np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[text]) // PASSAGE
    order = np.lexsort((h, text))
    fresh = np.ones(len(starts))
    fresh[order[1:]] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    whole = np.stack((np.bincount(text, fresh, len(parts)) / np.maximum(n_words, 1), np.log1p(n_words) / 8), axis=1)
    newlines = np.flatnonzero(data == 10)
    for a in range(0, len(owner), CHUNK):
        own = owner[a : a + CHUNK]
        i, j = np.searchsorted(passage, (a, a + CHUNK))
        x = np.zeros((len(own), DIMS), np.float32)
        if j > i:
            near = slice(i, min(j + 1, len(starts)))  # with the word behind, to tell how the last one ends
            _fill(x, data, starts[near], ends[near], h[near], text[near], passage[near] - a, fresh[i:j], whole[own], newlines)
        yield x, own


def _fill(x, data, starts, ends, h, text, passage, fresh, whole, newlines) -> None:
    """The features of len(fresh) words, into the rows x of their passages; further words only follow."""
    m, total = len(fresh), len(x)
    line = np.searchsorted(newlines, starts[1:]) > np.searchsorted(newlines, ends[:-1])
    broke = np.append(line & (text[1:] == text[:-1]), False)[:m].astype(float)
    same = np.zeros(m)
    same[1:] = (h[1:m] == h[: m - 1]) & (passage[1:m] == passage[: m - 1])
    starts, ends, h, passage = starts[:m], ends[:m], h[:m], passage[:m]
    base = int(starts[0])
    kind = _KIND[data[base : ends[-1]]]
    within = lambda k: np.add.reduceat(kind == k, starts - base, dtype=np.int64)  # noqa: E731  what follows a word is white space
    lower, upper, digit, punct, other = (within(k) for k in (LOWER, UPPER, DIGIT, PUNCT, OTHER))
    length = ends - starts
    total_of = lambda w: np.bincount(passage, w, total)
    n = np.maximum(np.bincount(passage, minlength=total), 1).astype(float)
    chars = np.maximum(total_of(length), 1)
    order = np.lexsort((h, passage))
    new = np.ones(m)
    new[order[1:]] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    x[:, :STATS] = np.stack((
        total_of(lower) / chars, total_of(upper) / chars, total_of(digit) / chars, total_of(punct) / chars, total_of(other) / chars, chars / n / 10,
        total_of(same) / n, total_of(new) / n, total_of(fresh) / n, whole[:, 0], whole[:, 1], total_of(broke) / n,
        total_of((upper == length).astype(float)) / n, total_of((punct == length).astype(float)) / n, total_of((length > 15).astype(float)) / n, n / PASSAGE,
    ), axis=1)
    last = data[ends - 1]
    mark = np.where(_KIND[last] == PUNCT, last & 31, 0)
    shape = (np.minimum(length, 15) // 2) * 8 + (upper > 0) * 4 + (punct > 0) * 2 + (digit > 0)
    for at, size, code in ((STATS, 32, mark), (STATS + 32, SHAPE_DIMS, shape), (STATS + 32 + SHAPE_DIMS, WORD_DIMS, (h >> np.uint64(50)).astype(np.int64) % WORD_DIMS)):
        x[:, at : at + size] = np.sqrt(np.bincount(passage * size + code, minlength=total * size).reshape(total, size) / n[:, None])
    x[np.bincount(passage, minlength=total) == 0] = 0


@dataclass
class GatedAttention:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    def passages(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.p["W"] + self.p["b"])

    def bags(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logits of bags of passage representations; starts are the first rows of each bag."""
        a = (np.tanh(h @ self.p["V"]) / (1 + np.exp(-np.clip(h @ self.p["U"], -30, 30)))) @ self.p["w"]
        sizes = np.diff(np.append(starts, len(h)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        z = np.add.reduceat(h * a[:, None], starts) / np.add.reduceat(a, starts)[:, None]
        return self.slope * (z @ self.p["c"] + self.p["d"][0]) + self.shift


def score_texts(model: GatedAttention, texts: list[str | None]) -> np.ndarray:
    """Scores of whole texts; short ones are taken together."""
    out, batch, size = [], [], 0
    for i, t in enumerate(texts):
        batch.append(t)
        size += len(t or "")
        if size > BATCH or i + 1 == len(texts):
            h, owner = (np.concatenate(c) for c in zip(*((model.passages(x), own) for x, own in encode(batch))))
            out.append(model.bags(h, np.searchsorted(owner, np.arange(len(batch)))))
            batch, size = [], 0
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -40, 40))) if out else np.zeros(0)


def fit(texts: list[str], y: np.ndarray, seed: int = 11) -> GatedAttention:
    """Train on four fifths; the logit's shift is the best cut on the rest. With one class or no rows, every score is the share of label 1 (or 0.5)."""
    rng = np.random.default_rng(seed)
    n_in = DIMS
    p = {"W": rng.normal(0, n_in**-0.5, (n_in, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    model = GatedAttention(np.zeros(n_in), np.ones(n_in), p)
    if len(set(y.tolist())) < 2:
        share = float(np.mean(y)) if len(y) else 0.5
        model.slope, model.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    feats, firsts = [], []
    for a in range(0, len(texts), 64):
        x, owner = (np.concatenate(c) for c in zip(*encode(texts[a : a + 64])))
        feats += np.split(x, np.searchsorted(owner, np.arange(1, len(texts[a : a + 64]))))
    order = rng.permutation(len(texts))
    check, train = order[: len(order) // 5], order[len(order) // 5 :]
    if len(set(y[check].tolist())) < 2:
        check = order
    every = np.concatenate([feats[i] for i in train])
    model.mean, model.scale = every.mean(0), every.std(0) + 0.02
    n = np.bincount(y[train], minlength=2)
    weight = np.where(y == 1, len(train) / (2 * max(n[1], 1)), len(train) / (2 * max(n[0], 1)))
    m1, m2, step = {k: np.zeros(v.shape) for k, v in p.items()}, {k: np.zeros(v.shape) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        train = rng.permutation(train)
        for a in range(0, len(train), 64):
            batch = train[a : a + 64]
            x = np.clip((np.concatenate([feats[i] for i in batch]) - model.mean) / model.scale, -6, 6)
            sizes = np.array([len(feats[i]) for i in batch])
            starts = np.cumsum(sizes) - sizes
            h = np.tanh(x @ p["W"] + p["b"])
            t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
            e = (t * s) @ p["w"]
            e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
            att = e / np.repeat(np.add.reduceat(e, starts), sizes)
            z = np.add.reduceat(h * att[:, None], starts)
            dl = (1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30))) - y[batch]) * weight[batch] / len(batch)
            dz = np.repeat(dl[:, None] * p["c"], sizes, axis=0)
            datt = (dz * h).sum(1)
            de = att * (datt - np.repeat(np.add.reduceat(datt * att, starts), sizes))
            dts = de[:, None] * p["w"]
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh = (dz * att[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grads = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * p[k] * (k != "d")
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= 0.004 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    logits = np.concatenate([model.bags(model.passages(feats[i]), np.zeros(1, np.int64)) for i in check])
    cut = _cut(logits, y[check])
    model.slope = 3 / max(float(np.std(logits)), 1e-6)
    model.shift = -model.slope * cut
    return model


def _cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of cuts with the best balanced accuracy."""
    order = np.argsort(scores, kind="stable")
    s, t = scores[order], y[order]
    below = np.concatenate(([0], np.cumsum(1 - t))) / max((1 - t).sum(), 1)
    above = 1 - np.concatenate(([0], np.cumsum(t))) / max(t.sum(), 1)
    edges = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    gap = np.diff(edges)
    good = below + above
    best = np.flatnonzero((good >= good.max() - 1e-12) & (gap > 0)) if (gap > 0).any() else np.array([0])
    k = best[gap[best].argmax()] if len(best) else int(good.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_class=None, max_chars: int = MAX_CHARS) -> DataFrame:
    """All columns of docs, and held_out, score and predicted, for every row of docs(doc_id, text, lang, ...).

    The fit takes at most ``per_class`` rows of each label outside the held-out fold, and the score depends on the text
    alone. Columns of docs with the new names are replaced. A null or wordless text is a bag of one empty passage.
    held_out is false for a null doc_id. Repeated rows stay; an empty table gives an empty result, and with no usable labels
    every score is 0.5.
    """
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", folds, held, per_class or PER_CLASS, max_chars)
    model = fit(sample["text"].tolist(), sample["y"].to_numpy(np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(sent.value, texts.tolist()))

    rows = docs.drop("held_out", "score", "predicted")
    rows = rows.withColumn("held_out", F.coalesce(fold("doc_id", folds) == held, F.lit(False))).withColumn("score", score(F.col("text").cast("string")))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
