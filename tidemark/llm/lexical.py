"""Ranked lexical search: variable-block-max WAND over shards of the documents.

A scan turns each document into its length and its counts of the terms that the items use. A shard is
a run of these rows in one task. There each term's posting list is cut into blocks by a dynamic
programme that weighs the error of the blocks' bounds against their number. For an item the blocks of
its terms bound the score of every stretch of documents; stretches are opened from the highest bound
on, and those whose bound is under the k-th best score so far are skipped. Results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, blocks, distinct_spans, spans, utf8
from .storage import cut, fresh

#: Bytes of item texts that one pass over the documents answers, and postings of a shard.
PASS_BYTES, SHARD = 16 << 20, 2_000_000
#: A block's boundaries lie between grains of so many postings, a block has up to WIDEST grains, and its
#: price is that of an error of PRICE times its list's largest score.
GRAIN, WIDEST, PRICE = 4, 64, 4
_CELLS = 1 << 20  # of the programme's tables at once
#: Documents that are opened at first, and groups of shards whose answers are merged first.
FIRST, LOTS = 2048, 256
#: Bytes that no term holds.
OTHER = np.zeros(256, bool)
OTHER[:0x30] = OTHER[0x3A:0x41] = OTHER[0x5B:0x61] = OTHER[0x7B:0x80] = True
_PAIRS = "doc_id {}, n long, term array<int>, tf array<int>"


def terms_of(text: str | None) -> Counter:
    low, off = _bytes([text])
    start, end, _ = spans(low, off, OTHER)
    raw = low.tobytes()
    return Counter(raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True))


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    buf, off = utf8(pa.array(texts, pa.string()))
    return LOWER[buf], off


def term_rows(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, term, tf of the documents with at least one term; ``term`` has those of the broadcast vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in blocks(off):
                low, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                start, end, wo = spans(low, o, OTHER)
                first, code = distinct_spans(low, start, end)
                raw, n = low.tobytes(), np.diff(wo)
                ids = np.fromiter((known.get(raw[a:b], -1) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)), np.int64, len(first))
                doc, own = np.repeat(np.arange(j - i), n), ids[code]
                key, tf = np.unique(doc[own >= 0] * (len(known) + 1) + own[own >= 0], return_counts=True)
                held = np.flatnonzero(n)
                at = np.searchsorted(key // (len(known) + 1), np.append(held, j - i)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array(held)), pa.array(n[held]),
                        pa.ListArray.from_arrays(pa.array(at), pa.array((key % (len(known) + 1)).astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(tf.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "term", "tf"],
                )

    return docs.mapInArrow(run, _PAIRS.format(docs.schema["doc_id"].dataType.simpleString()))


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """For each term of the vocabulary the number of rows that hold it; one number a term comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["term", "df"])

    got = rows.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return out


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def block_ends(score: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts many lists into blocks: list, first and end posting of each block.

    ``score``: the lists one after the other, each with postings ``start[k]`` to ``start[k + 1]``.
    Chosen are the boundaries (after whole grains) with the least sum, over all blocks, of the
    block's largest score times its postings and of its price: the sum of the scores is the same for
    all choices, so this is the least error of the bounds. Lists of like length are cut together.
    """
    size = np.diff(start)
    grains = -(-size // GRAIN)
    lists = np.argsort(-grains, kind="stable")
    lists = lists[: int(np.count_nonzero(grains))]
    out, at = [(np.empty(0, np.int64),) * 3], 0
    while at < len(lists):
        widest = min(WIDEST, int(grains[lists[at]]))
        some = lists[at : at + max(1, _CELLS // widest)]
        out.append(_cut_lists(score, start, np.sort(some), grains, widest))
        at += len(some)
    k, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((a, k))
    return k[order], a[order], b[order]


def _cut_lists(score: np.ndarray, start: np.ndarray, lists: np.ndarray, grains: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of some lists with postings. A step prolongs all of them by a grain, the longest list first in the arrays."""
    lists = lists[np.argsort(-grains[lists], kind="stable")]
    grains = grains[lists]
    go = np.concatenate([[0], np.cumsum(grains)])
    list_of = np.repeat(np.arange(len(lists)), grains)
    first = start[lists][list_of] + GRAIN * (np.arange(go[-1]) - go[list_of])
    held = np.minimum(GRAIN, start[lists + 1][list_of] - first)
    top = score[first]
    for i in range(1, GRAIN):
        there = held > i
        top[there] = np.maximum(top[there], score[first[there] + i])
    price = PRICE * np.maximum.reduceat(top, go[:-1])
    # best[k, s % (widest + 1)]: the least sum of the first s grains of list k.
    best = np.zeros((len(lists), widest + 1), np.int64)
    high, many = np.zeros((len(lists), widest), np.int64), np.zeros((len(lists), widest), np.int64)
    length = np.zeros(int(go[-1]), np.int64)
    for s in range(int(grains[0])):
        live = int(np.searchsorted(-grains, -s, "left"))  # lists with more than s grains
        own = go[:live] + s
        high[:live, s % widest], many[:live, s % widest] = 0, 0  # the block that starts with this grain
        np.maximum(high[:live], top[own][:, None], out=high[:live])
        many[:live] += held[own][:, None]
        back = s - np.arange(min(s + 1, widest))  # first grains of the blocks that end here
        sums = best[:live][:, back % (widest + 1)] + high[:live][:, back % widest] * many[:live][:, back % widest]
        pick = sums.argmin(axis=1)
        best[:live, (s + 1) % (widest + 1)] = sums[np.arange(live), pick] + price[:live]
        length[own] = pick + 1
    left, out = grains.copy(), []
    while (alive := np.flatnonzero(left)).size:  # back from the ends of all lists at once
        n = length[go[alive] + left[alive] - 1]
        out.append((alive, left[alive] - n, left[alive]))
        left[alive] -= n
    k, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    k = lists[k]
    return k, start[k] + GRAIN * a, np.minimum(start[k] + GRAIN * b, start[k + 1])


class Shard(NamedTuple):
    """Posting lists by term over documents in ascending order of their ids, and their blocks."""

    ids: pa.Array
    start: np.ndarray  # of each term's list
    doc: np.ndarray
    score: np.ndarray
    block_of: np.ndarray  # of each term's blocks
    first: np.ndarray  # postings of the blocks
    end: np.ndarray
    top: np.ndarray

    @classmethod
    def build(cls, ids: pa.Array, n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, words: int) -> Shard:
        order = pa.compute.sort_indices(ids).to_numpy().astype(np.int64)  # nulls last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        if 25 * int(n.max(initial=0)) * documents < 2**63:
            m = 75 + (25 * n * documents) // max(words, 1)
        else:
            m = np.array([75 + 25 * int(x) * documents // words for x in n.tolist()], np.int64)
        doc = np.repeat(np.arange(len(n)), size)
        score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        doc = place[doc]
        sort = np.lexsort((doc, term))
        doc, score = doc[sort], score[sort]
        start = np.searchsorted(term[sort], np.arange(len(weights) + 1))
        k, first, end = block_ends(score, start)
        return cls(ids.take(pa.array(order)), start, doc, score, np.searchsorted(k, np.arange(len(weights) + 1)), first, end, np.maximum.reduceat(score, first) if len(first) else first)

    def best(self, terms: list[int], times: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents with a score above 0, the best first, ties by place."""
        blocks_ = np.concatenate([np.arange(self.block_of[t], self.block_of[t + 1]) for t in terms])
        if not len(blocks_):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        mult = np.repeat(np.array(times), [self.block_of[t + 1] - self.block_of[t] for t in terms])
        first, end = self.doc[self.first[blocks_]], self.doc[self.end[blocks_] - 1] + 1
        # The sum of the blocks over each document changes only where a block begins or ends.
        edge = np.concatenate([first, end])
        change = np.concatenate([mult * self.top[blocks_], -mult * self.top[blocks_]])
        at, inverse = np.unique(edge, return_inverse=True)
        step = np.zeros(len(at), np.int64)
        np.add.at(step, inverse, change)
        bound, length = np.cumsum(step)[:-1], np.diff(at)
        by_bound = np.argsort(-bound, kind="stable")
        reach = np.cumsum(length[by_bound])
        score = np.zeros(len(self.ids), np.int64)
        opened, least, take = 0, 1, FIRST
        while opened < len(by_bound) and bound[by_bound[opened]] >= least:
            # The next stretches by their bounds; the bounds fall, so those under ``least`` end it.
            upto = min(max(int(np.searchsorted(reach, take, "left")) + 1, opened + 1), int(np.searchsorted(-bound[by_bound], -least, "right")))
            self._open(at, by_bound[opened:upto], blocks_, mult, first, end, score)
            opened, take = upto, 2 * int(reach[upto - 1])
            if np.count_nonzero(score) >= k:
                least = max(1, int(np.partition(score, len(score) - k)[len(score) - k]))
        found = np.flatnonzero(score >= least)
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found]

    def _open(self, at: np.ndarray, stretches: np.ndarray, blocks_: np.ndarray, mult: np.ndarray, first: np.ndarray, end: np.ndarray, score: np.ndarray) -> None:
        """Adds up the scores of the documents of some stretches; blocks that meet none of these are skipped."""
        mark = np.zeros(len(score) + 1, np.int32)
        mark[at[stretches]] += 1
        np.subtract.at(mark, at[stretches + 1], 1)
        live = np.cumsum(mark[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(live)])
        meet = np.flatnonzero(before[end] > before[first])
        a, n = self.first[blocks_[meet]], self.end[blocks_[meet]] - self.first[blocks_[meet]]
        posting = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        doc = self.doc[posting]
        keep = live[doc]
        np.add.at(score, doc[keep], (np.repeat(mult[meet], n) * self.score[posting])[keep])


def search(docs: DataFrame, items: DataFrame, k: int = 20, pass_bytes: int = PASS_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 for each item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. Each
    distinct row of the items is an item; null ids are ids like others, and of documents they rank
    last among equal scores. Null, empty and wordless texts have no terms: such items have no rows
    and such documents do not count. Repeated documents count each; where they tie, one follows the
    other. Texts are read whole; an empty table on either side gives no rows. Items are answered in
    passes of about ``pass_bytes``, so what is broadcast and the terms' numbers that come to the
    driver are bounded by it.
    """
    spark = docs.sparkSession
    rows, asked = fresh(docs, "doc_id", "text"), fresh(items, "item_id", "text").where("text is not null").distinct()
    passes = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / pass_bytes))
    out = None
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").toArrow()
        part = _pass(rows, own.column("item_id").combine_chunks(), items.schema["item_id"].dataType.simpleString(), own.column("text").to_pylist(), k, shard)
        part = part.withColumn("item", F.col("item") + F.lit(p << 32))
        out = part if out is None else out.union(part)
    # First within groups of shards, so that no window sees all shards of an item.
    ties = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = out.withColumn("_r", F.row_number().over(Window.partitionBy("item", "item_id", "lot").orderBy(*ties))).where(F.col("_r") <= k)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "item_id").orderBy(*ties))).where(F.col("rank") <= k)
    return some.select("item_id", "rank", "doc_id", "score")


def _pass(docs: DataFrame, item_ids: pa.Array, item_kind: str, texts: list[str], k: int, shard: int) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    bags = [terms_of(t) for t in texts]
    names = sorted({t for bag in bags for t in bag})
    vocabulary = {t: i for i, t in enumerate(names)}
    rows = cut(term_rows(docs, spark.sparkContext.broadcast(vocabulary)), "term_rows")
    total = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    weights = np.array([weight(int(d), total.documents) for d in document_frequencies(rows, len(names))], np.int64)
    asked = [([vocabulary[t] for t in bag], list(bag.values())) for bag in bags]
    shared = spark.sparkContext.broadcast((weights, asked, item_ids))
    documents, words = total.documents, total.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked, item_ids = shared.value
        held: list[pa.RecordBatch] = []
        postings = 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= shard:
                yield _answers(held, weights, asked, item_ids, documents, words, k)
                held, postings = [], 0
        if held:
            yield _answers(held, weights, asked, item_ids, documents, words, k)

    found = rows.mapInArrow(run, f"item long, item_id {item_kind}, doc_id {kind}, score long")  # the number tells items of one id apart
    return found.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(LOTS)))


def _answers(batches: list[pa.RecordBatch], weights: np.ndarray, asked: list, item_ids: pa.Array, documents: int, words: int, k: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, n, term, tf = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
    flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (term, tf)]
    own = Shard.build(ids, n.to_numpy(zero_copy_only=False), np.asarray(term.value_lengths()).astype(np.int64), *flat, weights, documents, words)
    got = [(i, *own.best(terms, times, k)) for i, (terms, times) in enumerate(asked) if terms]
    item = pa.array(np.repeat(np.array([i for i, _, _ in got], np.int64), [len(d) for _, d, _ in got]))
    doc, score = (np.concatenate([g[c] for g in got] or [np.empty(0, np.int64)]) for c in (1, 2))
    return pa.RecordBatch.from_arrays([item, item_ids.take(item), own.ids.take(pa.array(doc)), pa.array(score)], names=["item", "item_id", "doc_id", "score"])
