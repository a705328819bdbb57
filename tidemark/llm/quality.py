"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every word has an index vector of signs drawn from its hash. A word's context vector is the sum of
the index vectors of its neighbours over the whole corpus, gathered in a hashed table of fixed
size. A document is pooled from the index and context vectors of all its words; a two-layer network
trained in numpy scores it, and a temperature calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, bit_counts, blocks, utf8, word_hashes
from .storage import added_tables, fresh, packed, unpacked

#: Rows of the hashed table of context vectors, their width, and the rows that are added up together. Words share
#: rows however large the vocabulary: a pooled document is a mean over all its words, and what sharing adds to it
#: is alike for all documents. Held-out accuracy did not rise with more rows, and each task hands on a whole table.
ROWS, DIM, SLICE = 4096, 32, 256
#: Classes of bytes whose runs are words: lower-case and non-ASCII letters, capitals, digits, the rest.
_KIND = np.full(256, 4, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's words and their offsets.

    A word is a run of letters, of digits or of other marks; one capital before small letters
    belongs to their run, so case and punctuation remain visible to the model.
    """
    kind = _KIND[buf]
    cut = np.ones(len(kind), bool)
    if len(kind) > 1:
        cut[1:] = (kind[1:] != kind[:-1]) & ~((kind[1:] == 1) & (kind[:-1] == 2))
    cut[off[:-1][off[:-1] < len(kind)]] = True
    edge = np.flatnonzero(cut)
    end = np.append(edge[1:], len(kind))
    real = kind[edge] > 0
    start, end = edge[real], end[real]
    return word_hashes(buf, start, end), np.searchsorted(start, off)


def _index_vectors(h: np.ndarray, so: np.ndarray) -> np.ndarray:
    """Sums of the sign vectors of the hashes in each range."""
    return 2 * bit_counts(h, so)[:, :DIM] - np.diff(so)[:, None]


def context_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIM unit vectors, from all words of all documents.

    Each task sums its own table; the tables meet in slices and in two steps, so what is shuffled is a
    fixed size a task, and the driver gets one table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIM), np.int64)
        for batch in batches:
            buf, off = utf8(batch.column(0))
            for i, j in blocks(off):
                h, wo = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if len(h) < 2:
                    continue
                ok = np.ones(len(h) - 1, bool)
                inner = wo[1:-1] - 1
                ok[inner[(inner >= 0) & (inner < len(ok))]] = False
                left, right = h[:-1][ok], h[1:][ok]
                row = np.concatenate([left, right]) >> U64(52)
                row = row.astype(np.uint16)
                other = np.concatenate([right, left])
                order = np.argsort(row, kind="stable")
                total += _index_vectors(other[order], np.searchsorted(row[order], np.arange(ROWS + 1)))
        for s in range(0, ROWS, SLICE):
            if total[s : s + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([packed(total[s : s + SLICE].ravel())], pa.binary())], names=["part", "n"])

    sums = added_tables(fresh(docs, "text").mapInArrow(run, "part long, n binary"))
    table = np.zeros((ROWS, DIM))
    for r in sums.collect():  # ROWS / SLICE rows
        table[r.part : r.part + SLICE] = unpacked(r.n).reshape(SLICE, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each document: mean index, context and neighbour vectors, and how concentrated they are."""
    h, wo = tokens(buf, off)
    n = np.maximum(np.diff(wo), 1)[:, None]
    index = _index_vectors(h, wo) / n
    context = np.zeros((len(off) - 1, DIM))
    full = np.flatnonzero(np.diff(wo))
    if len(full):
        context[full] = np.add.reduceat(table[(h >> U64(52)).astype(np.int64)], wo[:-1][full], axis=0)
    context /= n
    # Neighbours bound by the product of their signs: a word that follows itself gives ones.
    bound = np.zeros((len(off) - 1, DIM))
    if len(full) and len(h) > 1:
        same = np.append(~(h[:-1] ^ h[1:]), U64(0))
        same[wo[1:][full] - 1] = 0  # the last word of a document has no neighbour in the next one
        bound = _index_vectors(same, wo) / n
    norm = lambda x: (x * x).sum(1, keepdims=True)
    return np.hstack([index, context, bound, bound.mean(1, keepdims=True), np.sqrt(norm(index)), np.log(norm(index) + 1e-4), np.sqrt(norm(context)), np.log1p(np.diff(wo))[:, None] / 5])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, batch: int = 64, rate: float = 0.003, decay: float = 1e-4, seed: int = 11) -> Network:
    """Two layers by Adam on four fifths of the rows; the last fifth sets the temperature.

    Without rows the network is undecided: every probability is one half.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1] if len(x) else 3 * DIM + 5
    net = Network(np.zeros(d), np.ones(d), rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(x):
        return net
    net.mean, net.scale = x.mean(0), x.std(0) + 1e-3
    held = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~held) if held.any() else np.arange(len(y))
    z = (x - net.mean) / net.scale
    share = float(np.clip(y[fit].mean(), 1e-3, 1 - 1e-3))
    params = [net.w1, net.b1, net.w2, np.array([np.log(share / (1 - share))])]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for s in range(0, len(order), batch):
            k = order[s : s + batch]
            a = np.tanh(z[k] @ params[0] + params[1])
            e = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -40, 40))) - y[k]
            back = np.outer(e, params[2]) * (1 - a * a)
            grads = [z[k].T @ back / len(k) + decay * params[0], back.mean(0), a.T @ e / len(k) + decay * params[2], np.array([e.mean()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    check = np.flatnonzero(held) if held.any() else fit
    logit, target = net.logit(x[check]), y[check]
    net.temperature = float(min(np.geomspace(0.2, 10, 50), key=lambda t: np.mean(np.logaddexp(0, logit / t) - target * logit / t)))
    return net


def _features(docs: DataFrame, table: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(2))
            x = [pooled(buf[off[i] : off[j]], off[i : j + 1] - off[i], shared.value) for i, j in blocks(off)]
            x = np.concatenate(x) if x else np.empty((0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["u", "quality", "x"])

    return docs.select("u", "quality", "text").mapInArrow(run, "u long, quality int, x binary")


def fit_score(docs: DataFrame, labels: DataFrame, learn: str, sample: int = 8000, seed: int = 11) -> DataFrame:
    """doc_id, score for every row: the probability that its text is of good quality.

    Word vectors come from all documents. Labels come from rows of ``labels`` that meet the SQL
    condition ``learn`` on doc_id; at most ``sample`` of them, chosen by a hash of the doc_id, train
    the network, each with one text: of rows that share the doc_id, the least. A null, empty or blank
    text has no words and is scored like any other; texts of any length are read whole. Rows with a
    null quality teach nothing, and a doc_id with both labels counts as good. Repeated doc_ids are
    scored row by row. Without labels every score is one half. Other columns are not looked at.
    """
    table = context_vectors(docs)
    picked = labels.where("quality is not null and doc_id is not null").where(learn)
    picked = picked.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("u", F.expr(f"xxhash64(doc_id, {seed})")).orderBy("u").limit(sample)
    known = fresh(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "u", "quality").agg(F.min("text").alias("text"))
    known = known.select("u", F.col("quality").cast("int").alias("quality"), "text")
    rows = sorted(_features(known, table).collect(), key=lambda r: (r.u, r.x))  # a row a label: ``sample`` at most
    x = np.array([np.frombuffer(r.x) for r in rows])
    net = train(x, np.array([r.quality for r in rows], float), seed=seed)
    shared = docs.sparkSession.sparkContext.broadcast((table, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, model = shared.value
        for batch in batches:
            buf, off = utf8(batch.column(1))
            p = [model.probability(pooled(buf[off[i] : off[j]], off[i : j + 1] - off[i], t)) for i, j in blocks(off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(p) if p else np.empty(0))], names=["doc_id", "score"])

    return fresh(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
