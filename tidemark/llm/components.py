"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, shuffled


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b of one type. Returns node, root: the smallest node of its component.

    Each step is a grouping and a join on the node, so nothing is gathered and a hub of any degree
    is split by adaptive execution; nothing is broadcast. Nodes without an edge to another node are not returned. Nulls
    link nothing. A finished step is a table that replaces the one before, and the loop ends when a step
    changes nothing.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", instead_of=e)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(e: DataFrame) -> tuple:
    """Number of edges and an order-free checksum of them."""
    row = e.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(u, v) as decimal(20,0))), 0)")).first()
    return row[0], row[1]
