"""Exact top-k search: term-at-a-time accumulation in blocks, partition selection and a merge.

Queries and candidates are dealt into blocks by a hash of their id. A task gets one block of each,
turns the candidates into postings by dimension, and for every dimension adds the weighted posting
list to a dense array of scores. It keeps the k best of each query; a window merges them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

QUERY_BLOCK, ROW_BLOCK = 2048, 8192
_QUERIES, _ROWS = 64, 2048  # of one dense score array


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their rows, padded with zeros to the longest."""
    ids = table.column("vec_id").to_numpy()
    col = table.column("v").combine_chunks()
    size = np.asarray(col.value_lengths()).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(ids)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def block_best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query the k best candidates of the block, its own id left out: qid, cid, score.

    Scores are exact: 32 or 64 bits where no sum can leave them, and Python's integers beyond. A
    score among the best that 64 bits cannot hold raises an OverflowError.
    """
    dims = min(q.shape[1], c.shape[1])
    bound = _largest(q) * _largest(c) * max(dims, 1)
    if bound >= 2**63 - 1:
        return _best_of_large(qid, q[:, :dims], cid, c[:, :dims], k)
    kind = np.int32 if bound < 2**31 - 1 else np.int64
    none = np.iinfo(kind).min  # below every score
    out: list[list[np.ndarray]] = [[], [], []]
    postings = []
    for s in range(0, len(cid), _ROWS):
        part = c[s : s + _ROWS, :dims].astype(kind)
        lists = []
        for t in range(dims):
            at = np.flatnonzero(part[:, t])
            # A list that holds nearly all rows is kept dense: adding its zeros is cheaper than scattering.
            lists.append((None, part[:, t].copy()) if 4 * len(at) > 3 * len(part) else (at, part[at, t]))
        postings.append((cid[s : s + _ROWS], lists))
    for a in range(0, len(qid), _QUERIES):
        ids, own = qid[a : a + _QUERIES], q[a : a + _QUERIES, :dims].astype(kind)
        best_s, best_c = [], []
        for rows, lists in postings:
            score = np.zeros((len(ids), len(rows)), kind)
            buffer = np.empty_like(score)
            for t, (at, weight) in enumerate(lists):
                if at is None:
                    np.multiply(own[:, t, None], weight[None, :], out=buffer)
                    score += buffer
                elif len(at):
                    score[:, at] += own[:, t, None] * weight[None, :]
            score[ids[:, None] == rows[None, :]] = none
            keep = min(k, len(rows))
            # All above the k-th largest score, and of those equal to it the first: rows stand by their ids.
            last = np.partition(score, len(rows) - keep, axis=1)[:, len(rows) - keep, None]
            above, equal = score > last, score == last
            room = keep - above.sum(1, keepdims=True)
            top = np.nonzero(above | (equal & (equal.cumsum(1) <= room)))[1].reshape(len(ids), keep)
            best_s.append(np.take_along_axis(score, top, 1))
            best_c.append(rows[top])
        s, r = np.concatenate(best_s, 1), np.concatenate(best_c, 1)
        order = np.lexsort((r, ~s), axis=1)[:, :k]
        s, r = np.take_along_axis(s, order, 1), np.take_along_axis(r, order, 1)
        real = s > none
        out[0].append(np.repeat(ids, real.sum(1)))
        out[1].append(r[real])
        out[2].append(s[real].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def _best_of_large(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = []
    wide = [(int(i), row.astype(object)) for i, row in zip(cid, c, strict=True)]
    for i, row in zip(qid.tolist(), q.astype(object), strict=True):
        scored = ((-int((row * other).sum()), j) for j, other in wide if j != i)
        out += [(i, j, -s) for s, j in heapq.nsmallest(k, scored)]
    if any(not -(2**63) <= s < 2**63 for _, _, s in out):
        raise OverflowError("a score does not fit 64 bits")
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def quantised(vectors: DataFrame, scale: int = 64, column: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of every component.

    Vectors that are null or hold a null, NaN or infinity, or have no id, are left out. A component
    that 64 bits cannot hold raises an error.
    """
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    wide = F.raise_error("a scaled component does not fit 64 bits").cast("long")
    whole = lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**63, F.floor(c.cast("double") * scale)).otherwise(wide)
    return vectors.where(x.isNotNull() & ~bad & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, whole).alias("v"))


def top_k(rows: DataFrame, queries: str, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that meets ``queries``.

    ``rows``: vec_id, v array<long>. The score is the integer inner product; where lengths differ,
    the missing components are 0. Ties go to the smaller vec_id. Rows that share the query's vec_id
    are its own; other repeated rows are candidates of their own. A query that occurs twice is
    answered once. Without queries or other rows the result is empty.
    """
    rows = cut(rows.select("vec_id", "v"), "vectors")
    n = rows.count()
    asked = rows.where(queries).dropDuplicates(["vec_id"])
    nq, nc = max(1, math.ceil(asked.count() / QUERY_BLOCK)), max(1, math.ceil(n / ROW_BLOCK))
    here = F.expr("xxhash64(vec_id, 1)")
    q = asked.withColumn("qb", F.pmod(here, F.lit(nq))).withColumn("cb", F.explode(F.expr(f"sequence(0L, {nc - 1}L)")))
    c = rows.withColumn("cb", F.pmod(F.expr("xxhash64(vec_id, 2)"), F.lit(nc))).withColumn("qb", F.explode(F.expr(f"sequence(0L, {nq - 1}L)")))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            qid, cid, score = block_best(*_matrix(left), *_matrix(right), k)
        else:
            qid = cid = score = np.empty(0, np.int64)
        return pa.table({"query_id": pa.array(qid, pa.int64()), "vec_id": pa.array(cid, pa.int64()), "score": pa.array(score, pa.int64())})

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
