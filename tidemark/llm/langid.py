"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the runs of two to four bytes inside a word, its two ends marked. Each has an
embedding in a hashed table; a document is the mean over its whole text, and a linear layer with a
softmax names the language. Numpy trains both by stochastic gradient descent on the driver, over a
bounded sample. Since the mean and the layer are linear, tasks carry the product of the two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, U64, blocks, utf8
from .storage import fresh

BITS = 15
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def subwords(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all subwords of each document, and each document's range of them."""
    b = _CLASS[LOWER[buf]]
    rows, keep = [], []
    ends = off[1:]
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint32)
        for i in range(n):
            code = code * np.uint32(256) + b[i : i + m]
        ok = np.ones(m, bool)
        for i in range(1, n - 1):
            ok &= b[i : i + m] > 0
        if n == 2:
            ok &= code > 0
        for i in range(1, n):
            at = ends - i
            ok[at[(at >= 0) & (at < m)]] = False
        at = np.flatnonzero(ok)
        rows.append(((code[at] + np.uint32(n * 0x01000193)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
        keep.append(at)
    if not rows:
        return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
    count = sum(np.diff(np.searchsorted(k, off)) for k in keep)
    doc_off = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(doc_off[-1], np.uint32)
    filled = doc_off[:-1].copy()
    for r, k in zip(rows, keep, strict=True):
        part = np.searchsorted(k, off)
        size = np.diff(part)
        out[np.repeat(filled - part[:-1], size) + np.arange(len(k))] = r
        filled += size
    return out, doc_off


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # rows x languages: embedding times weights
    bias: np.ndarray
    temperature: float
    reject: float  # probabilities under this are refused

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows, so = subwords(buf, off)
        n = np.diff(so)
        total = np.zeros((len(n), len(self.langs)))
        full = np.flatnonzero(n)
        if len(full):
            total[full] = np.add.reduceat(self.table[rows], so[:-1][full], axis=0)
        z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 7) -> Model:
    """Fit on whole texts; every fifth text calibrates the temperature and the rejection."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.array([names.index(x) for x in langs])
    feats = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        rows, _ = subwords(raw, np.array([0, len(raw)]))
        u, c = np.unique(rows, return_counts=True)
        feats.append((u, (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    # A small random layer lets the embeddings move from the first step.
    w += rng.normal(0, 0.5, w.shape).astype(np.float32)
    held = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~held) if len(y) >= 10 else np.arange(len(y))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for s in range(0, len(order), batch):
            part = order[s : s + batch]
            vec = np.stack([feats[d][1] @ emb[feats[d][0]] for d in part])
            z = vec @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = p @ w.T
            w -= step / len(part) * vec.T @ p
            bias -= step / len(part) * p.sum(0)
            for k, d in enumerate(part):
                u, c = feats[d]
                # Not the plain gradient, which is ``c``: a preconditioned step, by which rare subwords move
                # nearly as far as frequent ones.
                emb[u] -= (step * 60 * np.sqrt(c / len(u)))[:, None] * back[k]
    table = (emb @ w).astype(np.float32)
    model = Model(names, table, bias.astype(np.float64), 1.0, 0.0)
    check = np.flatnonzero(held) if len(y) >= 10 else fit
    logit = np.stack([feats[d][1] @ table[feats[d][0]] + bias for d in check])
    model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(logit / t, y[check]))
    z = logit / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p[np.arange(len(check)), y[check]][p.argmax(1) == y[check]]
    model.reject = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return model


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    top = z.max(1)
    return float(np.mean(top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(y)), y]))


def sample(docs: DataFrame, per_lang: int, seed: int = 7) -> DataFrame:
    """About ``per_lang`` whole texts of each language, chosen by a hash of the doc_id."""
    rows = docs.where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg((F.lit(1.0 * per_lang) / F.count("*")).alias("share"))
    drawn = F.expr(f"pmod(xxhash64(doc_id, {seed}), 1000000) / 1000000.0")
    return rows.withColumn("u", drawn).join(F.broadcast(share), "lang").where("u < share").select("lang", "text", "u")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row.

    A text that is null or has no letter is ``und`` with score 0. Other texts always get a learned
    language; ``accepted`` is false where its probability is under the calibrated rejection. If
    nothing was learned, every text is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, off = utf8(batch.column(1))
            pred, score = [], []
            for i, j in blocks(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                ascii_letter = np.concatenate([[0], np.cumsum((LOWER[part] >= 97) & (LOWER[part] <= 122))])
                has = ascii_letter[o[1:]] > ascii_letter[o[:-1]]
                for d in np.flatnonzero(~has):
                    has[d] = any(map(str.isalpha, part[o[d] : o[d + 1]].tobytes().decode("utf-8", "replace")))
                if not m.langs:
                    has[:] = False
                    p = np.zeros((j - i, 1))
                else:
                    p = m.scores(part, o)
                best = p.argmax(1)
                pred += [m.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                score.append(np.where(has, p[np.arange(len(p)), best], 0.0))
            s = np.concatenate(score) if score else np.empty(0)
            names = np.array(pred, object)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(s), pa.array((s >= m.reject) & (names != "und"))], names=["doc_id", "lang_pred", "score", "accepted"]
            )

    return fresh(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def fit_identify(docs: DataFrame, learn: str, per_lang: int = 400, seed: int = 7) -> DataFrame:
    """Train on rows that meet the SQL condition ``learn`` and predict for all rows.

    ``per_lang`` bounds the sample: about so many texts of each language, twice as many at most.
    Rows with a null text or language teach nothing. Every row is returned, repeated rows too and
    alike; texts of any length are read whole; other columns are not looked at, whatever their
    names. Without rows to learn from every text is ``und``; an empty table gives no rows.
    """
    rows = sample(docs.where(learn).select("doc_id", "lang", "text"), per_lang, seed)
    n = rows.select("lang").distinct().count()
    picked = rows.orderBy("u", "lang").limit(2 * per_lang * max(n, 1)).collect()
    return identify(docs, train([r.text for r in picked], [r.lang for r in picked], seed=seed))
