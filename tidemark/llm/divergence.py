"""Source divergence audit: how far the word shares of the sources of a language lie apart.

Two-dimensional tiling. The groups (lang, source) of a language are dealt into blocks of about GROUPS,
its kept terms into chunks of about CHUNK, and the counts of a block on a chunk are packed into one
row. Each row is replicated to the tiles, block by block, that need it; a task reads the chunks of its
tile one after the other and adds up its part of the pair matrix. A tile of many chunks is cut into
spans of SPAN chunks, so no task grows with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, blocks, distinct_spans, spans, utf8
from .storage import cut, fresh

GROUPS, CHUNK, SPAN, SALTS = 64, 2048, 64, 64
#: Documents of a language that a term needs, terms that are reported for a group, and what a whole share is.
LEAST, TERMS, WHOLE = 10, 10, 1_000_000_000
_COUNT_BLOCK = 4 << 20
#: Bytes that no term holds.
OTHER = np.zeros(256, bool)
OTHER[:0x41] = OTHER[0x5B:0x61] = OTHER[0x7B:0x80] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it).

    Null columns are empty strings. Every group also has one row of the term '', with the number of
    its rows. Counts are added up in each task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            pairs = table.select([0, 1]).group_by(["lang", "source"], use_threads=False).aggregate([])
            place = {p: k for k, p in enumerate(zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True))}
            group = np.fromiter((place[p] for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), np.int64, batch.num_rows)
            buf, off = utf8(batch.column(2))
            names = [pairs.column(k).combine_chunks() for k in (0, 1)]
            seen = np.bincount(group, minlength=len(place))
            yield _counted(names, np.arange(len(place)), pa.array([""] * len(place)), np.zeros(len(place), np.int64), seen)
            for i, j in blocks(off, _COUNT_BLOCK):
                low, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                start, end, wo = spans(low, o, OTHER)
                first, code = distinct_spans(low, start, end)
                if not len(first):
                    continue
                doc = np.repeat(np.arange(i, j), np.diff(wo))
                held, n = np.unique(doc * len(first) + code, return_counts=True)
                key, at = np.unique(group[held // len(first)] * len(first) + held % len(first), return_inverse=True)
                terms = _strings(low, start[first], end[first]).take(pa.array(key % len(first)))
                yield _counted(names, key // len(first), terms, np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key)))

    text = [F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(names: list[pa.Array], group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    group = pa.array(group)
    return pa.RecordBatch.from_arrays([names[0].take(group), names[1].take(group), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    raw = buf.tobytes()
    parts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(off.tobytes()), pa.py_buffer(b"".join(parts)))


def share(n: Column, total: Column) -> Column:
    """1 + floor(WHOLE * n / total) for n up to total, three decimal places at a time so that 64 bits hold it."""
    out, rest = F.lit(1).cast("long"), n
    for k in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out = out + F.lit(k) * F.call_function("div", rest, total)
        rest = rest % total
    return out


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same on arrays."""
    out, rest = np.ones(np.broadcast_shapes(n.shape, total.shape), np.int64), n
    for k in (1_000_000, 1_000, 1):
        part, rest = np.divmod(rest * 1000, total)
        out += k * part
    return out


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of ``p`` by rows of ``q``: the sum of floor((p - q)^2 / (p + q)) over the columns."""
    out = np.zeros((len(p), len(q)), np.int64)
    for k in range(len(p)):
        d = p[k] - q
        out[k] = (d * d // (p[k] + q)).sum(axis=1)
    return out


def divergence(docs: DataFrame, least: int = LEAST, top: int = TERMS, groups: int = GROUPS, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair``: the divergence of a group from each other source of its language, over all kept terms,
    at every rank. ``term``: the ``top`` terms that a group has more of than its language. Terms are
    kept where at least ``least`` rows of the language hold them. Null text, lang and source are
    empty strings; repeated rows count each; a language without kept terms has pairs of 0; ties go
    by the item's UTF-8 bytes; an empty table gives no rows. Exact while a language has fewer than
    9 * 10^15 words.
    """
    counts = cut(term_counts(fresh(docs, "lang", "source", "text")), "term_counts")
    words = counts.where("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least).select("lang", "term", "all_n")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    nch = F.greatest(F.lit(1), F.ceil(F.col("v") / chunk))
    slot = Window.partitionBy("lang", "chunk").orderBy("term")
    # One row a language meets its terms, on SALTS keys so that a language's terms are shared out.
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    kept = cut(kept.withColumn("chunk", F.pmod(F.xxhash64("term"), nch)).withColumn("tslot", F.row_number().over(slot) - 1), "kept_terms")
    used = cut(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n", "all_total", "v", "chunk", "tslot"), "kept_counts")

    own = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.count_if(F.col("term") == "").alias("s")).join(sizes.select("lang", "v"), "lang", "left")
    every = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang")
    nb = F.greatest(F.lit(1), F.ceil(F.col("s") / groups))
    seat = Window.partitionBy("lang", "gb").orderBy("source")
    every = every.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), nb.alias("nb"))
    every = cut(every.withColumn("gb", F.pmod(F.xxhash64("source"), "nb")).withColumn("gslot", F.row_number().over(seat) - 1), "groups")

    pairs = _pairs(used, every, kept, span)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    size = lambda n: F.col(n) + 2 * F.col("v")
    p = used.join(every.select("lang", "source", "total"), ["lang", "source"])
    p = p.select("lang", "source", F.col("term").alias("item"), share(F.col("n") + 2, size("total")).alias("p"), share(F.col("all_n") + 2, size("all_total")).alias("q")).where("p > q")
    terms = p.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.union(terms)


def _pairs(used: DataFrame, every: DataFrame, kept: DataFrame, span: int) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language."""
    packed = used.join(every.select("lang", "source", "gb", "gslot"), ["lang", "source"])
    packed = packed.groupBy("lang", "gb", "chunk").agg(F.collect_list(F.struct("gslot", "tslot", "n")).alias("cells"))
    seats = every.groupBy("lang", "gb", "nb", "v").agg(F.sort_array(F.collect_list(F.struct("gslot", "source", "total"))).alias("seats"))
    chunks = kept.groupBy("lang", "chunk").agg(F.count("*").alias("terms"))
    # A block without words of a chunk has shares there too, so each block has a row for each chunk.
    rows = seats.join(chunks, "lang", "left").select("lang", "gb", "nb", "v", "seats", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("terms", F.lit(0)).alias("terms"))
    rows = rows.join(packed, ["lang", "gb", "chunk"], "left").withColumn("other", F.explode(F.expr("sequence(0L, nb - 1)")))
    rows = rows.select(
        "lang", F.least("gb", "other").alias("i"), F.greatest("gb", "other").alias("j"), F.expr(f"chunk div {span}").alias("span"), "chunk", "gb", "v", "terms",
        F.col("seats.source").alias("sources"), F.col("seats.total").alias("totals"), F.col("cells.gslot").alias("g"), F.col("cells.tslot").alias("t"), F.col("cells.n").alias("n"),
    )
    key = ["lang", "i", "j", "span"]
    parts = rows.repartition(*key).sortWithinPartitions(*key, "chunk", "gb").mapInArrow(_tiles, "lang string, a string, b string, value long")
    whole = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return whole.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up each tile's matrix over its chunks; holds one chunk of two blocks and one matrix."""
    key, at, left, total, names = None, None, None, None, None
    for batch in batches:
        for r in range(batch.num_rows):
            row = {f: batch.column(k)[r] for k, f in enumerate(batch.schema.names)}
            new = tuple(row[c].as_py() for c in ("lang", "i", "j", "span"))
            if new != key:
                if total is not None:
                    yield _matrix_rows(key, total, names)
                key, at, left, total = new, None, None, None
            p, own = _block_shares(row), row["sources"].as_py()
            if new[1] == new[2]:
                mine, theirs, names = p, p, (own, own)
            elif at != row["chunk"].as_py():
                at, left = row["chunk"].as_py(), (p, own)
                continue
            else:
                mine, theirs, names = left[0], p, (left[1], own)
            part = gaps(mine, theirs)
            total = part if total is None else total + part
    if total is not None:
        yield _matrix_rows(key, total, names)


def _block_shares(row: dict) -> np.ndarray:
    """The shares of a block's groups on a chunk's terms."""
    totals = row["totals"].values.to_numpy()
    n = np.zeros((len(totals), row["terms"].as_py()), np.int64)
    if row["g"].is_valid:
        n[row["g"].values.to_numpy(), row["t"].values.to_numpy()] = row["n"].values.to_numpy()
    return shares(n + 2, np.maximum(totals + 2 * row["v"].as_py(), 1)[:, None])


def _matrix_rows(key: tuple, total: np.ndarray, names: tuple[list[str], list[str]]) -> pa.RecordBatch:
    """Each unordered pair once: above the diagonal of a tile on it, everywhere else whole."""
    a, b = np.nonzero(np.triu(np.ones(total.shape, bool), 1) if key[1] == key[2] else np.ones(total.shape, bool))
    left, right = (pa.array(x, pa.string()).take(pa.array(k)) for x, k in zip(names, (a, b), strict=True))
    return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), left, right, pa.array(total[a, b])], names=["lang", "a", "b", "value"])
