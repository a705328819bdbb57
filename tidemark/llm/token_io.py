"""Token ids in Parquet: list columns, controlled row groups, page indexes, selective reads.

A data set has two tables. ``tokens``: doc_id, part, place (ids of the part before the document),
n_tokens and input_ids, in ascending doc_id order, the ids dictionary-encoded and the numbers
delta-encoded. ``parts``: part and first (ids of all earlier parts).
"""

from __future__ import annotations

import ctypes
import gc
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import LOWER, blocks, distinct_spans, spans, utf8
from .storage import fresh

LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
#: Units of one generation of a Python worker's memory (two are held), and the longest that is remembered:
#: some 45 MB a generation at the most.
REMEMBER, LONGEST = 250_000, 48
#: Classes of bytes: white space, ASCII letters, digits, ASCII marks, and what is left to the tokenizer.
_KIND = np.full(256, 5, np.uint8)
_KIND[33:127] = 4
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[97:123] = _KIND[65:91] = 1
_KIND[48:58] = 3
_KIND[ord("'")] = 5
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that the tokenizer encodes on their own.

    It drops white space and takes runs of letters, single digits and runs of marks apart, so those
    of ASCII and Latin-1 letters are units. A word with anything else in it, such as an apostrophe,
    another script or the start of a special token, is one unit as it stands.
    """
    kind = _KIND[buf]
    if len(buf) > 1:
        pair = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
        kind[pair] = kind[pair + 1] = 1
        kind[np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))] = 5
    start, end, _ = spans(buf, off)
    if not len(start):
        return start, end
    cut = np.ones(len(kind), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    odd = np.concatenate([[0], np.cumsum(kind == 5)])
    for k in np.flatnonzero(odd[end] > odd[start]).tolist():
        cut[start[k] : end[k]] = False
    cut[start] = True
    at = np.flatnonzero(cut & (kind > 0))
    word = np.searchsorted(start, at, "right") - 1
    return at, np.minimum(np.append(at[1:], len(buf)), end[word])


class Memory:
    """The ids of units, one after the other in an array that doubles when it is full."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.flat, self.at, self.n = np.empty(1 << 12, np.int32), np.zeros(1 << 10, np.int64), 0

    def find(self, words: list[bytes]) -> np.ndarray:
        """Places of units; -1 where one is not known."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.at[at + 1] - self.at[at]
        return self.flat[np.repeat(self.at[at], size) + steps(size)], size

    def add(self, words: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        used, n = int(self.at[self.n]), self.n + len(words)
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
        self.flat[used : used + len(flat)] = flat
        self.at[self.n + 1 : n + 1] = used + np.cumsum(size)
        self.place.update(zip(words, range(self.n, n), strict=True))
        self.n = n


def steps(size: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on within each stretch."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


class Encoder:
    """Encodes each distinct unit with the tokenizers library and remembers its ids.

    What one generation of the memory holds is found while the next one fills, so the units in use
    are not learned again, and the memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young, self.old = Memory(), Memory()
        # How the model spells the letters of _LATIN, as the tokenizer's own first steps have them.
        letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
        norm, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.spelled = {ord(c): split.pre_tokenize_str(norm.normalize_str(c))[0][0] for c in letters}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units in a row, and how many each has."""
        if len(self.young.place) > REMEMBER:
            self.young, self.old = Memory(), self.young
        at = self.young.find(words)
        miss = np.flatnonzero(at < 0)
        parts = []
        if len(miss):
            known = self.old.find([words[i] for i in miss.tolist()])
            again, new = miss[known >= 0], miss[known < 0]
            if len(again):
                parts.append((again, *self.old.take(known[known >= 0])))
            if len(new):
                parts.append((new, *self._encode([words[i] for i in new.tolist()])))
        hit = np.flatnonzero(at >= 0)
        size = np.zeros(len(words), np.int64)
        parts.append((hit, *self.young.take(at[hit])))
        for where, _, n in parts:
            size[where] = n
        off = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        for where, ids, n in parts:
            flat[np.repeat(off[where], n) + steps(n)] = ids
        for where, ids, n in parts[:-1]:
            own = [words[i] for i in where.tolist()]
            keep = np.fromiter(map(len, own), np.int64, len(own)) <= LONGEST
            self.young.add([w for w, k in zip(own, keep.tolist(), strict=True) if k], ids[np.repeat(keep, n)], n[keep])
        return flat, size

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of ASCII and Latin-1 letters go to the model at once; the others take all steps."""
        latin = np.fromiter((w.isalpha() or _LATIN.fullmatch(w) is not None for w in words), bool, len(words))
        tokenize, out = self.tokenizer.model.tokenize, [None] * len(words)
        for k in np.flatnonzero(latin).tolist():
            w = words[k]
            out[k] = [t.id for t in tokenize(w.decode() if w.isascii() else w.decode().translate(self.spelled))]
        rest = np.flatnonzero(~latin).tolist()
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(size.sum())), size

    def encode(self, buf: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, each closed by ``end``, and the documents' offsets."""
        low = LOWER[buf]
        start, stop = units(low, off)
        first, code = distinct_spans(low, start, stop)
        raw = low.tobytes()
        flat, size = self.ids([raw[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)])
        n = size[code]
        sums = np.concatenate([[0], np.cumsum(n)])
        wo = np.searchsorted(start, off)
        # One more place after each document's last unit, for its end id.
        doc = np.repeat(np.arange(len(off) - 1), np.diff(wo))
        out = np.full(int(sums[-1]) + len(off) - 1, end, np.int32)
        step = steps(n)
        out[np.repeat(sums[:-1] + doc, n) + step] = flat[np.repeat((np.cumsum(size) - size)[code], n) + step]
        return out, sums[wo] + np.arange(len(wo))


@cache
def encoder(path: str) -> Encoder:
    """One a Python worker, so that its tasks share what it remembers."""
    return Encoder(path)


def give_back() -> None:
    """Return to the system what earlier stages left unused in this worker, before this one fills its memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Encode every whole text (null: empty), append ``end`` and write the data set at ``path``.

    Documents are dealt by ranges of doc_id and text and sorted within them, so rows of one id are shared out; null ids come first. Rows of
    one doc_id follow each other in the order of their texts' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in blocks(off):
                ids, so = own.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i], end)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.full(j - i, part, np.int32)),
                        pa.array(place + so[:-1]),
                        pa.array(np.diff(so)),
                        pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "place", "n_tokens", "input_ids"],
                )
                place += int(so[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = fresh(docs, "doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.mapInArrow(run, f"doc_id {kind}, part int, place long, n_tokens long, input_ids array<int>")
    rows.write.options(**LAYOUT).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    # Only two number columns are read for this, and there is one row a part.
    sums = read_part(spark, path, kind).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums.select("part", first.alias("first")).coalesce(1).write.parquet(f"{path}/parts")


def read_part(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, part int, place long, n_tokens long, input_ids array<int>").parquet(f"{path}/tokens")


def read_tokens(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, input_ids.

    Filters on doc_id reach the page indexes, and without input_ids only numbers are read.
    """
    parts = spark.read.schema("part int, first long").parquet(f"{path}/parts")
    return read_part(spark, path, kind).join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "input_ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            col = batch.column(3)
            at = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths()))]).tolist()
            raw = memoryview(np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), "<i4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "input_ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
