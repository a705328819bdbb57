"""Divergence audit, token counts and ranked search against brute force, with odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import divergence, entry, lexical, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n", "term", "p", "q", "value", "rank", "item", "lot", "content", "n_tokens", "chunk", "gb", "v", "total"]
ODD = [
    (1, "One two THREE two", "en", "a", 1), (2, "One two THREE two", "en", "a", 1), (2, "One two THREE two", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", None, "b", 3),
    (None, "no id at all, two", "en", None, None), (7, " ".join(f"word{i % 997} two" for i in range(30_000)), "fr", "c", 9), (8, "12 34 !!", "xx", "a", 1), (9, "été ÉTÉ naïve_x été", "fr", "c", 2),
]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit(7))
    return df


def letters(text, digits=False):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not (c.isalpha() or digits and c.isdigit()):
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def audit(rows, least, top):
    docs = [(r.lang or "", r.source or "", letters(r.text)) for r in rows]
    held, langs, groups = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        groups[lang, source].update(words)
        langs[lang].update(words)
        held.update((lang, w) for w in set(words))
    out = set()
    for (lang, source), own in groups.items():
        kept = [w for w in langs[lang] if held[lang, w] >= least]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        p, q = share(own), share(langs[lang])
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(-sum(gap(p[w], o[w]) for w in kept), s.encode(), s) for (other, s), c in groups.items() if other == lang and s != source for o in [share(c)]]
        terms = [(-gap(p[w], q[w]), w.encode(), w) for w in kept if own[w] and p[w] > q[w]]
        for part, rows_ in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(rows_)}
    return out


def test_divergence_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)] + ["é", "日本"]
    rows = [(i, " ".join(rng.choices(words[: rng.randint(1, 38)], k=rng.randint(0, 30))), rng.choice(["de", "fr", None]), rng.choice([*(f"s{k}" for k in range(9)), None]), 0) for i in range(150)]
    df = odd(spark, [*ODD, *rows])
    want = audit(df.select("text", "lang", "source").collect(), 3, 4)
    for how in ({}, {"groups": 2, "chunk": 3, "span": 2}, {"groups": 1, "chunk": 1, "span": 1}):
        got = [tuple(r) for r in divergence.divergence(df, 3, 4, **how).collect()]
        assert len(got) == len(want) and set(got) == want, how
    assert divergence.divergence(df.limit(0)).count() == 0
    bare = {tuple(r) for r in divergence.divergence(odd(spark, [(1, "a b", "en", "x", 0), (2, None, "en", "y", 0), (3, "c", "de", "x", 0)])).collect()}
    assert bare == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = np.array([3, 12_345_678_901_234, 2**52]), np.array([2**52, 2**52 + 7, 2**52])
    want = [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]
    assert divergence.shares(n, total).tolist() == want
    df = spark.createDataFrame(list(zip(n.tolist(), total.tolist())), "a long, b long")
    assert [r.p for r in df.select(divergence.share(F.col("a"), F.col("b")).alias("p")).collect()] == want


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    own = Tokenizer.from_file(path)
    return lambda t: len(own.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_and_cache(spark, tmp_path, name):
    path, place = entry.tokenizer_path(name), f"file://{tmp_path}/cache"
    count = library(path)
    rows = [*ODD, (10, "a<|endoftext|> b  <|endoftext|>", "en", "a", 0), (11, "tab\t\tthen  it's   done\r\n\n x", "en", "a", 0)]
    got = token_counts.count_tokens(odd(spark, rows), path, place).collect()
    want = Counter((i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t, *_ in rows)
    assert Counter(map(tuple, got)) == want
    stored = lambda: spark.read.parquet(f"{place}/{token_counts.version(path)}").count()
    n = stored()
    assert n == len({t or "" for _, t, *_ in rows}), "equal texts are encoded once"
    assert Counter(map(tuple, token_counts.count_tokens(odd(spark, rows), path, place).collect())) == want and stored() == n
    more = odd(spark, [*rows, (12, "something new", "en", "a", 0)])
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, path, place).collect()}[12] == count("something new") and stored() == n + 1
    assert token_counts.count_tokens(more.limit(0), path, place).count() == 0 and stored() == n + 1


def test_many_misses_are_joined(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FEW", 5)
    path, count = entry.tokenizer_path("byte_bpe_50k.json"), library(entry.tokenizer_path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, f"file://{tmp_path}/cache").collect()}
    assert got == {r.doc_id: count(r.text or "") for r in docs.collect()}


def test_stretches_count_like_whole_texts():
    path = entry.tokenizer_path("byte_bpe_50k.json")
    own, count, rng = token_counts.Counter(path), library(path), random.Random(3)
    assert own.by_stretch
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "日本", "1", "23", "'s", "'ll", ",", ".", "<|endoftext|>", " ", "　", "\x1c", "\x85", "<|", "🙂", "×", "don", "'t", "́", "​"]
    texts = ["".join(rng.choices(parts[: rng.choice([14, len(parts)])], k=rng.randint(0, 25))) for _ in range(4000)] + ["", " ", "x" * 100_000]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = own.count(np.frombuffer(b"".join(raw), np.uint8), off)
    assert got.tolist() == [count(t) for t in texts]


def ranked(rows, items, k=20):
    docs = [(i, Counter(w), len(w)) for i, t in rows if (w := letters(t, True))]
    total, words = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, bag, _ in docs for t in bag)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for i, bag, n in docs:
            m = 100 - 25 + 25 * n * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in letters(text, True) if bag[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_search_equals_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for how in ({}, {"pass_bytes": 2000, "shard": 500}):
        assert Counter(map(tuple, lexical.search(docs, items, **how).collect())) == want


def test_search_of_odd_rows(spark):
    rows = [*ODD, *[(20 + i, f"Zig zag {'zig ' * (i % 3)}", "en", "a", 0) for i in range(60)]]
    items = [(1, "zig zag"), (1, "zig zag"), (2, "two two ÉTÉ"), (2, "zag"), (None, "id at all"), (3, None), (4, "!! --"), (5, "nowhere"), (6, "")]
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("n", F.lit(1)).withColumn("score", F.lit(2))
    want = ranked([r[:2] for r in rows], items)
    for shard in (2_000_000, 7):
        assert Counter(map(tuple, lexical.search(odd(spark, rows), asked, shard=shard).collect())) == want
    assert lexical.search(odd(spark, rows).limit(0), asked).count() == lexical.search(odd(spark, rows), asked.limit(0)).count() == 0


def test_blocks_have_the_least_error(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [0, 1, 3, 4, 5, 40, 41, 170, 0, 90]
    start = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.integers(1, 1000, start[-1])
    for cells, widest in ((1 << 20, 64), (16, 8)):
        monkeypatch.setattr(lexical, "_CELLS", cells)
        monkeypatch.setattr(lexical, "WIDEST", widest)
        k, first, end = lexical.block_ends(score, start)
        assert np.repeat(np.arange(len(first)), end - first).size == len(score) and (first[1:] == end[:-1]).all()
        for i, n in enumerate(sizes):
            own = score[start[i] : start[i + 1]].tolist()
            grains = [own[g : g + lexical.GRAIN] for g in range(0, n, lexical.GRAIN)]
            price, best = lexical.PRICE * max(own, default=0), [0]
            for e in range(1, len(grains) + 1):
                best.append(min(best[b] + price + max(map(max, grains[b:e])) * sum(map(len, grains[b:e])) for b in range(max(0, e - widest), e)))
            got = sum(price + int(score[a:b].max()) * int(b - a) for j, a, b in zip(k, first, end) if j == i)
            assert got == best[-1]
