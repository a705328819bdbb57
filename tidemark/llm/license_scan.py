"""License scans: exact containment join of text blocks with license templates.

The blocks of a text are all its windows of as many words as the template has, whatever its lines. The
tokens of all templates are ordered by their frequency in the whole corpus, the rarest first. A
window that holds the needed share of a template holds one token at least of its prefix (prefix
filter); a text has as many of its tokens as are needed (length filter); and the windows around a
prefix token of which it is the rarest can hold no other tokens of the template than the more
frequent ones near it, which must be enough (positional filter). What passes is counted exactly.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


@dataclass(frozen=True)
class Template:
    """A license's words, and those that tell it from its neighbours: a window without them is not it."""

    label: str
    telling: str
    words: str


#: Notices, sentences and texts of well-known licenses, in words.
TEMPLATES = (
    Template("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    Template(
        "apache-2.0",
        "apache license warranties",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    Template("bsd", "redistribution source binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template(
        "bsd",
        "redistributions source binary",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "creative attribution noncommercial", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc-by-sa", "creative attribution sharealike", "creative commons attribution sharealike 4 0 international license"),
    Template("gpl-3.0", "gnu general public 3", "this work is licensed under the gnu general public license version 3"),
    Template(
        "gpl-notice",
        "gnu general public redistribute",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
    ),
    Template("isc", "permission purpose fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "mit license", "released under the mit license"),
    Template(
        "mit-grant",
        "permission granted software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    Template(
        "mit-grant",
        "permission granted sublicense",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    Template("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "unencumbered public domain", "this is free and unencumbered software released into the public domain"),
)
#: Bytes of words, A-Z lower-cased; the rest is space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield (x.as_py() or b"").translate(_TABLE)


def token_order(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    """The templates' tokens by the number of documents that hold them, the rarest first."""
    vocabulary = {t.encode() for template in templates for t in template.words.split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in _texts(batch.column(0)):
                n.update(vocabulary.intersection(text.split()))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in n]), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    counts = {r.token: r.n for r in fresh(docs, "text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    return sorted((t.decode() for t in vocabulary), key=lambda t: (counts.get(t, 0), t))


class Ordered:
    """A template with its distinct tokens in global order."""

    def __init__(self, template: Template, place: dict[str, int], threshold: float):
        self.label, self.size = template.label, len(template.words.split())
        self.telling = {t.encode() for t in template.telling.split()}
        tokens = sorted(set(template.words.split()), key=place.__getitem__)
        self.place = {t.encode(): i for i, t in enumerate(tokens)}
        self.need = math.ceil(threshold * len(tokens) - 1e-9)
        self.prefix = {t.encode() for t in tokens[: len(tokens) - self.need + 1]}

    def starts(self, at: list[int], tokens: list[bytes], n: int) -> Iterator[tuple[int, int]]:
        """Ranges of window starts that the prefix and positional filters leave, in order and apart.

        ``at`` and ``tokens``: the template's tokens in a text of ``n`` words, and their places in it.
        """
        most, done = max(n - self.size, 0), -1
        for p, t in zip(at, tokens, strict=True):
            if t not in self.prefix:
                continue
            i, j, own = bisect_left(at, p - self.size + 1), bisect_left(at, p + self.size), self.place[t]
            if j - i >= self.need and len({x for x in tokens[i:j] if self.place[x] >= own}) >= self.need:
                a, b = max(p - self.size + 1, done + 1, 0), min(p, most)
                if a <= b:
                    yield a, b
                    done = b

    def best(self, words: list[bytes], distinct: set[bytes]) -> float:
        """The largest share of the tokens that a window with the telling words holds; 0 under the threshold."""
        if len(self.place.keys() & distinct) < self.need or not self.telling <= distinct:
            return 0.0
        at = [i for i, w in enumerate(words) if w in self.place]
        tokens = [words[i] for i in at]
        best = 0
        for a, b in self.starts(at, tokens, len(words)):
            i = j = bisect_left(at, a)
            held: Counter = Counter()
            for s in range(a, b + 1):
                while j < len(at) and at[j] < s + self.size:
                    held[tokens[j]] += 1
                    j += 1
                while i < j and at[i] < s:
                    held[tokens[i]] -= 1
                    if not held[tokens[i]]:
                        del held[tokens[i]]
                    i += 1
                if len(held) > best and len(held) >= self.need and all(t in held for t in self.telling):
                    best = len(held)
        return best / len(self.place)


class Scanner:
    """The templates by the tokens of their prefixes, and the base phrases."""

    def __init__(self, order: list[str], templates: tuple[Template, ...], phrases: dict[str, str], threshold: float):
        place = {t: i for i, t in enumerate(order)}
        self.phrases = {label: b" " + words.encode() + b" " for label, words in phrases.items()}
        self.templates = [Ordered(t, place, threshold) for t in templates]
        self.prefix: dict[bytes, list[int]] = {}
        for k, t in enumerate(self.templates):
            if not t.telling <= t.place.keys():
                raise ValueError(f"the telling words of {t.label} are not among its words")
            for token in t.prefix:
                self.prefix.setdefault(token, []).append(k)

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
        words = text.split()
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for label, phrase in self.phrases.items():
            at = joined.find(phrase)
            while at >= 0:
                base.add(label)
                places.append(at)
                at = joined.find(phrase, at + 1)
        own, score, distinct = set(), 0.0, set(words)
        for k in sorted({k for t in self.prefix.keys() & distinct for k in self.prefix[t]}):
            share = self.templates[k].best(words, distinct)
            if share:
                own.add(self.templates[k].label)
                score = max(score, share)
        first, last = (joined.count(b" ", 0, min(places)), joined.count(b" ", 0, max(places))) if places else (None, None)
        return len(words), len(places), first, last, base, base | own, 1.0 if base else score


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Base phrases are consecutive words anywhere in the text. The method adds the label of a template
    if a window of the template's length (a shorter text is one window) holds ``threshold`` of its
    distinct tokens, the telling ones among them. score: 1 with a base phrase, else the largest such
    share. Null and empty texts have no words and no labels; repeated rows are judged row by row;
    texts of any length are read whole; other columns are not looked at, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(token_order(docs, templates), templates, phrases, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.scan(t) for t in _texts(batch.column(1))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in cols[:4]],
                    *[pa.array([",".join(sorted(x)) for x in c], pa.string()) for c in cols[4:6]],
                    pa.array(cols[6], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return fresh(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
