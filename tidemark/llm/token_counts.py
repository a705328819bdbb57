"""Token counts through a digest cache: a text is encoded once for each version of a tokenizer.

The cache is a Parquet folder for each tokenizer version with the SHA-256 of a normalised content and
its count. Digests of the documents are joined with it; only distinct contents that are missing are
encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, blocks, distinct_spans, spans, utf8
from .storage import cut, fresh

CACHE = "content binary, n_tokens long"
#: Missing digests up to here (32 bytes each) are broadcast to pick the texts to encode; more are joined.
FEW = 50_000
#: Units of one generation of a worker's memory (two are held), and the longest that is remembered.
REMEMBER, LONGEST = 400_000, 48
#: White space beyond ASCII, whose runs the tokenizer takes apart otherwise than those of ASCII.
_WIDE = [c.encode() for c in "\x1c\x1d\x1e\x1f\x85\xa0     　"] + [b"\xe2\x80" + bytes([c]) for c in range(0x80, 0x8B)]
#: Classes of bytes: white space, ASCII letters, digits, ASCII marks, and what is left to the tokenizer.
_KIND = np.full(256, 5, np.uint8)
_KIND[33:127] = 3
_KIND[SPACE] = 0
_KIND[97:123] = _KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[ord("'")] = 5


def version(path: str) -> str:
    """Names what a count hangs on: the file's bytes, the library and its version."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\n" + f.read()).hexdigest()


class Counter:
    """Counts tokens of whole texts with the tokenizers library.

    A byte-level tokenizer that splits before white space counts the same whether a text is encoded
    whole or in stretches: a word with one space before it, and what is left of the white space. Each
    distinct stretch is encoded once and its count remembered in two bounded generations. Texts with
    a special token's string or white space beyond ASCII, and all texts of other kinds of tokenizers,
    are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        split = self.tokenizer.pre_tokenizer
        probe = [p for p, _ in split.pre_tokenize_str("a  b\n\nc, d's\n e")] if split else None
        self.by_stretch = self.tokenizer.normalizer is None and probe == ["a", "Ġ", "Ġb", "Ċ", "Ċ", "c", ",", "Ġd", "'s", "Ċ", "Ġe"]
        self.line_end = self.tokenizer.token_to_id("Ċ")
        self.odd = _WIDE + [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = np.zeros(len(off) - 1, np.int64)
        raw = buf.tobytes()
        apart = np.arange(len(n))
        if self.by_stretch:
            apart = np.unique(np.searchsorted(off, [at for x in self.odd for at in places(raw, x)], "right") - 1).astype(np.int64)
            start, end = stretches(buf, off)
            doc = np.searchsorted(off, start, "right") - 1
            keep = np.ones(len(n), bool)
            keep[apart] = False
            keep = keep[doc]
            start, end, doc = start[keep], end[keep], doc[keep]
            first, code = distinct_spans(buf, start, end)
            size = self.sizes([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])[code]
            n = np.bincount(doc, size, len(n)).astype(np.int64)
        if len(apart):
            n[apart] = self.whole([raw[off[k] : off[k + 1]].decode("utf-8", "replace") for k in apart.tolist()])
        return n

    def sizes(self, units: list[bytes]) -> np.ndarray:
        """The number of tokens of distinct stretches."""
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        out = [self.young.get(u) for u in units]
        again = [k for k, n in enumerate(out) if n is None]
        new = []
        for k in again:
            out[k] = self.old.get(units[k])
            if out[k] is None:
                new.append(k)
        blank = [k for k in new if units[k].isspace()]
        words = [k for k in new if not units[k].isspace()]
        for k, n in chain(zip(blank, self.whole([units[k].decode() for k in blank]), strict=True), zip(words, self.of_words([units[k] for k in words]), strict=True)):
            out[k] = n
        self.young.update((units[k], out[k]) for k in again if len(units[k]) <= LONGEST)
        return np.array(out, np.int64)


    def of_words(self, words: list[bytes]) -> list[int]:
        """Of words with or without a space before them: one text, with a line end after each, counts them all."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([(b"\n".join(words) + b"\n").decode("utf-8", "replace")], add_special_tokens=False)[0].ids)
        return (np.diff(np.flatnonzero(ids == self.line_end), prepend=-1) - 1).tolist()


class PieceCounter:
    """Counts tokens of whole texts with the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return np.array([len(ids) for ids in self.model.encode(texts, num_threads=1)], np.int64)


def places(raw: bytes, x: bytes) -> Iterator[int]:
    at = raw.find(x)
    while at >= 0:
        yield at
        at = raw.find(x, at + len(x))


def stretches(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of all texts, in order; they cover every byte.

    A word takes one space before it. Of the white space before a word, all but its last character is
    one stretch, and the last one is another unless it is that space; white space that ends a text is one.
    A word of ASCII and Latin-1 letters, digits and marks without an apostrophe is cut where these change.
    """
    start, end, _ = spans(buf, off)
    cut_at = np.zeros(len(buf) + 1, bool)
    cut_at[off] = True  # each text starts anew
    cut_at[end] = True  # white space after a word
    inner = start[start > 0]
    last = inner[~cut_at[inner]] - 1 if len(inner) else inner  # the last white space before a word, in the same text
    cut_at[last] = True
    alone = last[buf[last] != 0x20]
    cut_at[alone + 1] = True
    kind = _KIND[buf]
    if len(buf) > 1:
        pair = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
        kind[pair] = kind[pair + 1] = 1
    change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    other = np.concatenate([[0], np.cumsum(kind == 5)])
    word = np.searchsorted(start, change, "right") - 1
    cut_at[change[other[end[word]] == other[start[word]]]] = True
    at = np.flatnonzero(cut_at)
    return at[:-1], at[1:]


@cache
def counter(path: str) -> Counter | PieceCounter:
    """One a Python worker, so that its tasks share what it remembers."""
    return PieceCounter(path) if path.endswith(".model") else Counter(path)


def normalised(text: Column) -> Column:
    """What the library is given: null is empty, and bytes that are not UTF-8 are replaced."""
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """content, n_tokens for (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in blocks(off):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own.count(buf[off[i] : off[j]], off[i : j + 1] - off[i]))], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row, through the cache at ``cache_path``.

    No begin, end or added special tokens; special strings inside a text are what the library makes
    of them. Null is an empty text of 0 tokens; texts of any length are encoded whole; repeated rows
    and equal texts are encoded once and returned each; an empty table gives no rows and leaves the
    cache as it was. A run that stops before its append leaves the cache whole, and rows that two runs
    append at once agree. Executors need the tokenizer's file at the same path.
    """
    spark = docs.sparkSession
    place = f"{cache_path.rstrip('/')}/{version(tokenizer)}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(place)
    stored = lambda: spark.read.schema(CACHE).parquet(place).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    text = normalised(F.col("text"))
    digest = F.unhex(F.sha2(text, 256)).alias("content")
    rows = fresh(docs, "doc_id", "text")
    keyed = cut(rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest), "digests")
    digests = cut(keyed.select("content").distinct(), "distinct_digests")
    missing = cut(digests.join(stored().select("content"), "content", "left_anti"), "missing_digests")
    n = missing.count()
    if n:
        texts = rows.select(digest, text.alias("text"))
        if n <= FEW:
            texts = texts.join(F.broadcast(missing), "content", "left_semi")
        # One text a digest, taken in each task before the shuffle.
        texts = texts.groupBy("content").agg(F.first("text").alias("text"))
        if n > FEW:
            texts = texts.join(missing, "content", "left_semi")
        encoded(texts, tokenizer).write.mode("append").parquet(place)
    # A table of its own, so that a digest with very many rows can be split in the join.
    counts = cut(stored().join(digests, "content", "left_semi"), "counts")
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
