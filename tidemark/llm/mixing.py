"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. In each source a share of every length is taken whole; the
budget that remains is fitted by a bounded-knapsack programme over the lengths left. Documents of a
length are then taken in the order of a seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import blocks, spans, utf8
from .storage import cut, fresh

#: Rows of a (source, length) that are ranked together.
RANKED = 512
#: Largest budget, in words, that the knapsack programme works on, beyond twice the longest document.
BUDGET = 1 << 14


def word_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and size: runs of bytes other than ASCII white space; null is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(0))
            n = [np.diff(spans(buf[off[i] : off[j]], off[i : j + 1] - off[i])[2]) for i, j in blocks(off, 1 << 22)]
            n = pa.array(np.concatenate(n) if n else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[*keep, "size"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return fresh(docs, "text", *keep).mapInArrow(run, f"{kinds}, size long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target for each source (null is a source of its own, the last).

    Weights repeat over the sources in code-point order and share ``total`` times all sizes. A
    target stops at ``limit`` times its source's size, and the excess is shared by weight again. In
    the order of limit over weight, the level after capping the first k sources rises until the
    last that must be capped and falls after it, so the final level is its maximum.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    own = own.withColumn("w", pick).withColumn("most", F.col("source_size") * limit)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    own = own.withColumn("level", level)
    level = F.max("level").over(everything)
    return own.select("source", "source_size", F.least("most", level * F.col("w")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest ``budget``.

    First the same share of every length, rounded down, then the longest that still fit, until the
    rest is in reach of an exact bounded-knapsack programme over what is left. The words taken never
    exceed the budget unless one more document brings them nearer.
    """
    take = np.zeros(len(lengths), np.int64)
    size = int((lengths * counts).sum())
    if budget <= 0 or size == 0:
        return take
    if budget >= size:
        return counts.copy()
    longest = int(lengths.max())
    reach = BUDGET + 2 * longest
    share = max(0.0, (budget - reach) / size)
    take = np.floor(counts * share).astype(np.int64)
    left = budget - int((take * lengths).sum())
    for k in np.argsort(-lengths):
        if left <= reach:
            break
        more = min(int(counts[k] - take[k]), (left - reach) // max(int(lengths[k]), 1))
        take[k] += more
        left -= more * int(lengths[k])
    # Bounded knapsack: bit s of ``can`` says that s words are in reach; counts in binary portions. ``by`` keeps the
    # portion by which a sum was reached first, so the way back needs one number a sum and no set of sums a portion.
    top = min(left + longest, int(((counts - take) * lengths).sum()))
    full = (1 << top + 1) - 1
    can, portions, by = 1, [], np.full(top + 1, -1, np.int32)
    for k in np.argsort(lengths, kind="stable"):
        length, free = int(lengths[k]), int(counts[k] - take[k])
        if length == 0:
            continue
        free = min(free, top // length)
        portion = 1
        while free > 0:
            p = min(portion, free)
            new = (can << p * length & full) & ~can
            by[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(portions)
            portions.append((k, p))
            can |= new
            free -= p
            portion *= 2
        if can >> left & 1:
            break
    under = (can & (1 << left + 1) - 1).bit_length() - 1
    over = can >> left
    over = left + (over & -over).bit_length() - 1 if over else top + left + 1
    goal = under if left - under <= over - left else over
    while goal:  # what a portion was added to was in reach before it
        k, p = portions[by[goal]]
        take[k] += p
        goal -= p * int(lengths[k])
    return take


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, limit: float = 2.0, seed: int = 42, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies.

    A source whose target is above its size is taken whole as often as that goes, and the rest is
    fitted once more. Empty documents have size 0 and are never taken. Every row is returned;
    repeated rows are separate documents. Reruns agree: ties end with the doc_id, and rows that
    share it are alike in all that is returned. Null sources are one source.
    """
    sized = cut(word_counts(docs.withColumnRenamed(text, "text") if text != "text" else docs, "doc_id", "source"), "sized")
    goal = cut(targets(sized, weights, total, limit), "targets")
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    same = F.col("h.source").eqNullSafe(F.col("g.source"))
    histogram = histogram.alias("h").join(goal.alias("g"), same).select(F.col("h.source").alias("source"), "size", "n", "source_size", "target")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        whole = int(rows.source_size.iloc[0])
        target = float(rows.target.iloc[0])
        times = int(target // whole) if whole else 0
        extra = fit(rows["size"].to_numpy(), rows.n.to_numpy(), round(target - times * whole))
        return pd.DataFrame({"source": rows.source, "size": rows["size"], "n": rows.n, "source_size": rows.source_size, "target": rows.target, "times": times, "extra": extra})

    kind = docs.schema["source"].dataType.simpleString()
    planned = cut(
        histogram.groupBy("source").applyInPandas(plan, f"source {kind}, size long, n long, source_size long, target double, times long, extra long"), "planned"
    )
    # Lengths with many documents are ranked in portions of about RANKED, each with its own part of ``extra``.
    rows = sized.alias("d").join(planned.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    rows = rows.select("doc_id", F.col("d.source").alias("source"), F.col("d.size").alias("size"), "source_size", "target", "times", "extra", "n")
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.expr(f"pmod(h, cast(1 + n / {RANKED} as bigint))"))
    split = rows.where("extra > 0 and extra < n")
    sizes = split.groupBy("source", "size", "part").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    ranked = split.withColumn("rank", rank).alias("r").join(
        sizes.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size")) & (F.col("r.part") == F.col("s.part"))
    )
    chosen = ranked.select("doc_id", F.col("r.size").alias("size"), "source_size", "target", "times", F.expr("cast(rank + before <= extra as bigint)").alias("once"))
    rest = rows.where("not (extra > 0 and extra < n)").select("doc_id", "size", "source_size", "target", "times", F.expr("cast(extra > 0 as bigint)").alias("once"))
    out = chosen.union(rest).withColumn("copies", F.expr("if(size > 0, times + once, 0)"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them.

    Rows that share a doc_id (null too) are taken alike, as often as the most taken of them.
    """
    chosen = mix(docs, **how).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]))
    rows = rows.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), chosen["copies"])))
    return rows.select("row.*")
