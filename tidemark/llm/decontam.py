"""Benchmark decontamination by SimHash over item-sized windows.

Every item has a weighted SimHash. In a document, each window of an item's length that holds one of
its shingles is fingerprinted; the other windows share nothing with the item, so their similarity
is 0. Four 16-bit blocks index the items' fingerprints: whatever is within the radius is within a
quarter of it in some block. Candidates are verified by weighted similarity of their shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, U64, blocks, pack_bits, shingle_hashes, spans, utf8, word_hashes
from .storage import cut, fresh

#: About so many distinct item texts are indexed in a pass; what is broadcast for a pass is bounded by it.
ITEMS = 512
#: Distinct item texts shorter than a shingle that are looked for in a pass.
SHORT_ITEMS = 20_000
#: Words are runs of letters, digits and non-ASCII characters.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    # Capitals of Latin-1 differ from small letters in one bit of the second byte.
    two = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1 if len(low) > 1 else np.empty(0, int)
    low[two] |= 0x20
    start, end, wo = spans(low, off, APART)
    return word_hashes(low, start, end), wo


def _signs(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


@dataclass
class Index:
    shingle: int
    radius: int
    similarity: float
    length: np.ndarray  # words of each item
    fp: np.ndarray
    bags: list[dict[int, int]]
    known: np.ndarray  # sorted shingles of all items
    weight: np.ndarray
    rare: float  # weight of a shingle that no item has
    owned: np.ndarray  # shingles of the items of this pass in order, and the item of each
    owners: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # for each block: ranges by value, and items

    @staticmethod
    def build(texts: list[str], shingle: int, radius: int, similarity: float, total: int | None = None, counts: tuple[np.ndarray, np.ndarray] | None = None) -> Index:
        """``total`` and ``counts``: the number of all item texts, and how many have each shingle; by default of ``texts``."""
        words, wo = _words(*_joined(texts))
        h, so = shingle_hashes(words, wo, shingle)
        each = [h[a:b] for a, b in zip(so[:-1], so[1:], strict=True)]
        total = len(texts) if total is None else total
        known, df = counts or np.unique(np.concatenate([np.unique(e) for e in each] or [h]), return_counts=True)
        weight = np.log(1 + total / np.maximum(df, 1))
        rare = math.log(1 + total)
        fp = [pack_bits((weight[np.searchsorted(known, e)] @ _signs(e) > 0)[None, :])[0] if len(e) else U64(0) for e in each]
        owner = sorted((int(x), i) for i, e in enumerate(each) for x in np.unique(e))
        fp = np.array(fp, U64)
        tables = []
        flips = [m for m in range(1 << 16) if m.bit_count() <= radius // 4]
        for b in range(4):
            value = (fp >> U64(16 * b)) & U64(0xFFFF)
            key = (value[:, None].astype(np.int64) ^ np.array(flips)[None, :]).ravel()
            item = np.repeat(np.arange(len(fp), dtype=np.int32), len(flips))
            order = np.argsort(key, kind="stable")
            tables.append((np.searchsorted(key[order], np.arange(65537)), item[order]))
        return Index(
            shingle, radius, similarity, np.diff(wo), fp, [Counter(e.tolist()) for e in each], known, weight, rare,
            np.array([o[0] for o in owner], U64), np.array([o[1] for o in owner], np.int64), tables,
        )

    def within(self, fp: int) -> set[int]:
        """All items whose fingerprint is within the radius."""
        found: set[int] = set()
        for b, (at, items) in enumerate(self.tables):
            v = fp >> 16 * b & 0xFFFF
            found.update(items[at[v] : at[v + 1]].tolist())
        return {i for i in found if (int(self.fp[i]) ^ fp).bit_count() <= self.radius}

    def weigh(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.weight[at], self.rare)

    def verify(self, h: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's bag of shingles and an item's."""
        bag, own = Counter(h.tolist()), self.bags[item]
        keys = np.array(sorted({*bag, *own}), U64)
        w = self.weigh(keys)
        x, y = np.array([bag.get(int(k), 0) for k in keys]), np.array([own.get(int(k), 0) for k in keys])
        return float((w * np.minimum(x, y)).sum() / (w * np.maximum(x, y)).sum())

    def document(self, h: np.ndarray, n_words: int, hit: np.ndarray) -> list[tuple[int, int, float]]:
        """Item, first word and similarity of the best window for each item that it matches.

        hit: the positions of shingles that items have too.
        """
        wanted: dict[int, set[int]] = {}  # window size in words -> starts
        first, last = (np.searchsorted(self.owned, h[hit], side) for side in ("left", "right"))
        for p, a, b in zip(hit.tolist(), first.tolist(), last.tolist(), strict=True):
            for item in self.owners[a:b]:
                size = min(int(self.length[item]), n_words)
                n = max(size - self.shingle + 1, 1)
                wanted.setdefault(size, set()).update(range(max(0, p - n + 1), min(p, len(h) - n) + 1))
        if not wanted:
            return []
        lo = min(min(s) for s in wanted.values())
        hi = max(max(s) + max(size - self.shingle + 1, 1) for size, s in wanted.items())
        best: dict[int, tuple[float, int]] = {}
        w = self.weigh(h[lo:hi])
        total = np.concatenate([np.zeros((1, 64)), np.cumsum(w[:, None] * _signs(h[lo:hi]), axis=0)])
        for size, starts in wanted.items():
            n = max(size - self.shingle + 1, 1)
            at = np.array(sorted(starts))
            for p, f in zip(at.tolist(), pack_bits(total[at - lo + n] - total[at - lo] > 1e-9).tolist(), strict=True):
                for item in self.within(f):
                    if min(self.length[item], n_words) == size:
                        s = self.verify(h[p : p + n], item)
                        if s >= self.similarity and (-s, p) < (-best.get(item, (-1.0, 0))[0], best.get(item, (-1.0, 0))[1]):
                            best[item] = (s, p)
        return [(item, p, s) for item, (s, p) in sorted(best.items())]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _isin(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Range of documents, word hashes and each document's range of words."""
    buf, off = utf8(column)
    for i, j in blocks(off):
        yield i, j, *_words(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def item_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all item texts in order, and how many texts have each: 16 bytes a shingle of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, wo in _blocks(batch.column(0)):
                h, so = shingle_hashes(words, wo, shingle)
                own = [np.unique(h[a:b]) for a, b in zip(so[:-1], so[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64))], names=["h"])

    rows = texts.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).toArrow()
    h, n = rows.column("h").to_numpy().view(U64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, radius: int = 16, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of each document and item.

    A window counts from ``similarity`` on. An item shorter than a shingle matches where its words
    stand consecutively; one without a word matches nothing. Shingles are weighed by all item texts
    at once, so a match does not depend on the passes in which the items are read: about ITEMS texts
    each, over all documents if one pass is enough, else over those documents that hold a shingle of
    any item; items shorter than a shingle then have passes of their own over all documents. Items of
    one text share their matches, whatever their ids (null is an id like any other). Null, empty and wordless texts have no rows; rows of one doc_id have one row
    an item, the best; ties go to the earlier window. Ids keep their type.
    """
    spark = docs.sparkSession
    texts = cut(_lengths(fresh(benchmark, "text").where("text is not null").distinct()), "item_texts")
    items = fresh(benchmark, "item_id", "text").where("text is not null").distinct()
    total = texts.count()
    short, long = texts.where(f"n between 1 and {shingle - 1}"), texts.where(f"n >= {shingle}")
    counts = item_shingles(texts, shingle) if total else None
    rows = fresh(docs, "doc_id", "text")
    passes = math.ceil(long.count() / ITEMS)
    if passes <= 1 and short.count() <= ITEMS:  # all items in one pass
        out = _scan(rows, _shared(spark, texts.where("n > 0"), shingle, radius, similarity, total, counts))
    else:
        # Items shorter than a shingle are looked for by themselves, so that the others need only documents that hold a shingle of theirs.
        lots = math.ceil(short.count() / SHORT_ITEMS)
        scans = [(rows, short.where(f"pmod(xxhash64(text), {lots}) = {k}")) for k in range(lots)]
        if passes:
            some = cut(_with_shingles(rows, spark.sparkContext.broadcast(counts[0]), shingle), "documents_with_shingles")
            scans += [(some, long.where(f"pmod(xxhash64(text), {passes}) = {k}")) for k in range(passes)]
        out = None
        for read, own in scans:
            part = _scan(read, _shared(spark, own, shingle, radius, similarity, total, counts))
            out = part if out is None else out.union(part)
    found = out.join(items.select("item_id", F.unhex(F.sha2("text", 256)).alias("item")), "item")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("first_word"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.first_word")).alias("first_word"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def _lengths(texts: DataFrame) -> DataFrame:
    """text, n: its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(wo) for _, _, _, wo in _blocks(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else np.empty(0, np.int64), pa.int64())], names=["text", "n"])

    return texts.mapInArrow(run, "text string, n long")


def _shared(spark: SparkSession, texts: DataFrame, shingle: int, radius: int, similarity: float, total: int, counts: tuple[np.ndarray, np.ndarray] | None):
    """What a pass broadcasts for its item texts: the index, their digests and the short ones."""
    own = sorted(r.text for r in texts.select("text").collect())
    index = Index.build(own, shingle, radius, similarity, total, counts)
    return spark.sparkContext.broadcast((index, [hashlib.sha256(t.encode()).digest() for t in own], _short(own, shingle)))


def _short(texts: list[str], shingle: int) -> dict[int, dict[int, list[int]]]:
    """By their number of words, the hashes of texts of fewer words than a shingle, and the texts of each."""
    words, wo = _words(*_joined(texts))
    h, so = shingle_hashes(words, wo, shingle)
    out: dict[int, dict[int, list[int]]] = {}
    for i, n in enumerate(np.diff(wo).tolist()):
        if 0 < n < shingle:
            out.setdefault(n, {}).setdefault(int(h[so[i]]), []).append(i)
    return out


def _with_shingles(rows: DataFrame, shared, shingle: int) -> DataFrame:
    """The rows that hold a shingle of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, j, words, wo in _blocks(batch.column(1)):
                h, so = shingle_hashes(words, wo, shingle)
                keep[i + np.searchsorted(so, np.flatnonzero(_isin(h, shared.value)), "right") - 1] = True
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def _scan(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names, short = shared.value
        for batch in batches:
            rows: list[tuple[int, int, int, int, float]] = []
            for i, j, words, wo in _blocks(batch.column(1)) if names else ():
                h, so = shingle_hashes(words, wo, index.shingle)
                hits = np.flatnonzero(_isin(h, index.owned))
                owner = np.searchsorted(so, hits, "right") - 1
                for d in np.unique(owner).tolist():
                    own = h[so[d] : so[d + 1]]
                    for item, p, s in index.document(own, int(wo[d + 1] - wo[d]), hits[owner == d] - so[d]):
                        rows.append((i + d, item, p, int(index.length[item]), s))
                for n, texts in short.items():
                    h, so = shingle_hashes(words, wo, n)
                    for at in np.flatnonzero(_isin(h, np.array(sorted(texts), U64))).tolist():
                        d = int(np.searchsorted(so, at, "right")) - 1
                        if wo[d + 1] - wo[d] >= n:
                            rows += [(i + d, item, at - int(so[d]), n, 1.0) for item in texts[int(h[at])]]
            if rows:
                d, item, p, n, s = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d)), pa.array([names[k] for k in item], pa.binary()), pa.array(p), pa.array(n), pa.array(s)],
                    names=["doc_id", "item", "first_word", "n_words", "similarity"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, item binary, first_word long, n_words long, similarity double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without a benchmark item in their text.

    Rows without a doc_id stay, as do null and empty texts; rows of one doc_id go together; other
    columns are kept. An empty table, or a benchmark without words, changes nothing.
    """
    bad = contaminated(docs, benchmark, **how).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
