"""SimHash near-duplicates by the generalised pigeonhole principle.

If the 64 bits are split into m partitions and partition i gets a threshold t_i, with the t_i
summing to radius - m + 1, then two fingerprints within the radius are within t_i in some partition
i. Correlated bits go to one partition, and the thresholds come from a dynamic programme over
estimated candidate counts. A fingerprint is filed under each of its partition values with every
choice of t_i bits struck out; those that share a file are candidates, and are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, blocks, doc_shingles, mix, simhash, utf8
from .storage import added_tables, cut, fresh, packed, shuffled

#: Members of a bucket that one task compares with each other; larger buckets are divided.
BUCKET = 512


# ------------------------------------------------------------------ exact contract fingerprints


def xx_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, fp: the 64-bit SimHash over XXH64 (seed 42) of ``shingle``-word shingles.

    A-Z are lower-cased, words are runs without ASCII white space, repeats count. Fewer words: the
    whole sequence is the shingle. A null, empty or blank text has fingerprint 0.
    """
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            raw, out = buf.tobytes(), []
            for i, j in blocks(off):
                h, size = [], []
                for d in range(i, j):
                    words = raw[off[d] : off[d + 1]].lower().split()
                    joined = b" ".join(words)
                    n = len(words)
                    if n <= shingle:
                        h += [digest(joined, 42)] if n else []
                        size.append(min(n, 1))
                        continue
                    ends = np.cumsum([len(w) + 1 for w in words]) - 1
                    begins = np.concatenate([[0], ends[:-1] + 1])
                    h += [digest(joined[a:b], 42) for a, b in zip(begins[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
                    size.append(n - shingle + 1)
                out.append(simhash(np.array(h, U64), np.concatenate([[0], np.cumsum(size)])))
            fp = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return fresh(docs, key, text).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


# ------------------------------------------------------------------ partitions and thresholds


def bit_agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both: 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((64, 64))
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for s in range(0, len(x), 1 << 16):
                y = x[s : s + (1 << 16)].astype(np.float32)
                total += y.T @ y
            n += len(x)
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total[i, j].astype(np.int64), n))], names=["i", "j", "n"]
            )

    rows = fresh(fps, "fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2,081 rows
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into ``parts`` groups of nearly equal size with correlated bits together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = set(range(64)), []
    for g in range(parts):
        want = len(left) // (parts - g)
        group = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < want:
            b = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            left.discard(b)
        groups.append(sorted(group))
    return groups


def allocate(estimate: list[list[float]], radius: int) -> list[int]:
    """Thresholds from -1 up, summing to radius - m + 1, of least total estimate.

    estimate[i][t] is the cost of partition i at threshold t; -1 skips the partition at no cost.
    """
    need = radius - len(estimate) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in estimate:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, len(costs)):
                c = cost + (costs[t] if t >= 0 else 0.0)
                if total + t not in step or c < step[total + t][0]:
                    step[total + t] = (c, [*chosen, t])
        best = step
    return best[need][1]


def estimates(n: int, both: np.ndarray, groups: list[list[int]], same: list[float], radius: int) -> list[list[float]]:
    """Candidates plus filed rows of each partition at each threshold.

    ``same`` has the counted pairs that agree in the whole partition. Beyond that, the chance of
    few disagreeing bits is carried on from the bits' own shares, taken as independent.
    """
    p = np.diag(both) / max(n, 1)
    out = []
    for bits, pairs in zip(groups, same, strict=True):
        dist = np.array([1.0])
        for b in bits:
            differ = 2 * p[b] * (1 - p[b])
            dist = np.convolve(dist, [1 - differ, differ])
        reach = np.cumsum(dist)[: radius + 1] / max(dist[0], 1e-300)
        out.append([float(min(pairs * reach[min(t, len(reach) - 1)], n * n / 2) + n * math.comb(len(bits), t)) for t in range(min(radius, len(bits)) + 1)])
    return out


# ------------------------------------------------------------------ buckets


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def filed(fps: DataFrame, files: list[tuple[int, int]]) -> DataFrame:
    """key, known, fp: one row for each fingerprint and file (label, mask of compared bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for label, m in files:
                key = mix((fp & U64(m)) + mix(np.full(1, label + 1, U64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(fp), m, U64).view(np.int64)), batch.column(0)], names=["key", "known", "fp"])

    return fresh(fps, "fp").mapInArrow(run, "key long, known long, fp long")


def refined(rows: DataFrame, radius: int) -> DataFrame:
    """File the members of large buckets again by radius + 1 groups of the bits not yet compared.

    Members within the radius agree in one of these groups at least, so no link is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, known, fp = (batch.column(c).to_numpy(zero_copy_only=False).view(U64) for c in range(3))
            for m in np.unique(known):
                at = known == m
                free = [b for b in range(64) if not int(m) >> b & 1]
                for g in range(radius + 1):
                    own = U64(_mask(free[g :: radius + 1]))
                    k = mix(key[at] + mix((fp[at] & own) + U64(g + 1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k.view(np.int64)), pa.array(np.full(len(k), m | own, U64).view(np.int64)), pa.array(fp[at].view(np.int64))], names=["key", "known", "fp"]
                    )

    return rows.select("key", "known", "fp").mapInArrow(run, "key long, known long, fp long")


def _forest(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius: each member and the first of its component."""
    n = len(words)
    near = np.zeros((n, n), np.int32)
    for w in range(words.shape[1]):
        near += np.bitwise_count(words[:, w, None] ^ words[None, :, w])
    near = near <= radius
    label = np.arange(n)
    while True:
        low = np.where(near, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(n))
    return label[other], other


def _distance(words: np.ndarray) -> np.ndarray:
    near = np.zeros((len(words), len(words)), np.int32)
    for w in range(words.shape[1]):
        near += np.bitwise_count(words[:, w, None] ^ words[None, :, w])
    return near


def _tree(words: np.ndarray, tied: np.ndarray, radius: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest links that connect what is within the radius; members of one ``tied`` already are.

    ``radius`` is a number, or a matrix with one for each pair.
    """
    near, far = _distance(words), int(np.max(radius)) + 1
    near[near > radius] = far
    near[tied[:, None] == tied[None, :]] = -1
    # Members without a link of their own have no part in a tree.
    able = np.flatnonzero(((near >= 0) & (near < far)).any(axis=1))
    if len(able) == 0:
        return able, able
    near = near[np.ix_(able, able)]
    n = len(able)
    reach, via = near[0].copy(), np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    out[0] = True
    a, b = [], []
    for _ in range(n - 1):
        k = int(np.where(out, far + 1, reach).argmin())
        if 0 <= reach[k] < far:
            a.append(via[k])
            b.append(k)
        out[k] = True
        closer = near[k] < reach
        reach[closer], via[closer] = near[k][closer], k
    return able[np.array(a, np.int64)], able[np.array(b, np.int64)]


def _pairs(words: np.ndarray, tied: np.ndarray, radius: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair within the radius that is not tied."""
    return np.nonzero(np.triu((_distance(words) <= radius) & (tied[:, None] != tied[None, :]), 1))


def _reach(n: np.ndarray, similarity: float) -> np.ndarray:
    """Elements in which two sets of these sizes may differ at ``similarity``; -1 where sizes rule it out."""
    return _row_reach(n[:, None], n[None, :], similarity)


def _row_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _row_reach(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """``_reach`` for one pair a row."""
    n, m = n.astype(float), m.astype(float)
    most = np.floor((1 - similarity) / (1 + similarity) * (n + m) + 1e-6).astype(np.int64)
    return np.where(np.minimum(n, m) < similarity * np.maximum(n, m) - 1e-6, -1, most)


def bucket_links(buckets: DataFrame, similarity: float, every: bool = False) -> DataFrame:
    """``buckets``: ids and ties array<long>, words array<binary> (see ``set_signatures``). Returns a, b.

    Left out are only pairs that the sizes or the parities of the sets rule out. Of the others the
    closest links that connect the bucket, so that a chain of near texts is verified link by link;
    with ``every`` all pairs. Members of one tie are connected as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(0).value_lengths()).astype(np.int64)
            x, tie = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
            if not len(x):
                continue
            raw, _ = utf8(batch.column(2).flatten(), b"")
            w = raw.view("<u8").reshape(len(x), -1)  # signatures are of one length
            at = np.cumsum(size) - size
            i = at[size == 2]
            near = _row_distance(w[i, 1:], w[i + 1, 1:]) <= _row_reach(w[i, 0], w[i + 1, 0], similarity)
            near &= tie[i] != tie[i + 1]
            a, b = [x[i[near]]], [x[i[near] + 1]]
            for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                order = s + np.argsort(x[s : s + n])
                i, j = (_pairs if every else _tree)(w[order, 1:], tie[order], _reach(w[order, 0], similarity))
                a.append(x[order[i]])
                b.append(x[order[j]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return buckets.select("ids", "ties", "words").mapInArrow(run, "a long, b long")


def fp_bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """``rows``: key, fp with at most BUCKET rows of a key. Returns a, b within the radius."""
    lists = rows.groupBy("key").agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            size = np.asarray(col.value_lengths())
            at = np.concatenate([[0], np.cumsum(size)])
            two = at[:-1][size == 2]
            x, y = flat[two], flat[two + 1]
            near = np.bitwise_count((x ^ y).view(U64)) <= radius
            a, b = [x[near]], [y[near]]
            for s, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                z = np.sort(flat[s : s + n])
                i, j = _forest(z.view(U64)[:, None], radius)
                a.append(z[i])
                b.append(z[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return lists.select("fps").mapInArrow(run, "a long, b long")


def hamming_links(fps: DataFrame, radius: int, parts: int | None = None) -> tuple[DataFrame, dict]:
    """Links a, b that connect all distinct fingerprints ``fp`` within ``radius`` bits, and the plan.

    Not every pair is returned: in a bucket, members are tied to the first of those they reach, so
    the components are whole and the rows stay in proportion to the fingerprints.
    """
    parts = parts or radius + 1
    n, both = bit_agreement(fps)
    groups = group_bits(n, both, parts)
    exact = [(i, _mask(bits)) for i, bits in enumerate(groups)]
    sizes = filed(fps, exact).groupBy("key", "known").agg(F.count("*").alias("c")).where("c > 1")
    pairs = {r.known & (2**64 - 1): float(r.pairs) for r in sizes.groupBy("known").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()}
    costs = estimates(n, both, groups, [pairs.get(m, 0.0) for _, m in exact], radius)
    thresholds = allocate(costs, radius)
    files = []
    for bits, t in zip(groups, thresholds, strict=True):
        files += [_mask([b for b in bits if b not in out]) for out in combinations(bits, t)] if t >= 0 else []
    rows = filed(fps, list(enumerate(files)))
    links = None
    depth = 0
    while True:
        depth += 1
        sizes = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        rows = cut(rows.join(shuffled(sizes), "key"), "buckets")
        found = fp_bucket_links(rows.where(f"c <= {BUCKET}"), radius)
        links = found if links is None else links.union(found)
        rows = rows.where(f"c > {BUCKET}")
        if rows.isEmpty():
            break
        rows = refined(rows, radius)
    return links.distinct(), {"groups": groups, "thresholds": thresholds, "estimates": costs, "depth": depth}


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp, component_id: the smallest key reachable over links of at most ``radius`` bits.

    Documents of one fingerprint are one class, so copies cost one row each however many there are.
    Every row is returned, repeated rows too. Null keys are kept and never name a component unless
    it has no other key. An empty table gives an empty result.
    """
    fps = cut(xx_fingerprints(docs, shingle, text, key), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    links, _ = hamming_links(classes, radius)
    roots = components(links)
    member = classes.join(shuffled(roots), classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = cut(member, "roots")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(shuffled(least), "root").select("fp", "component_id")
    return fps.join(shuffled(named), "fp").select(key, "fp", "component_id")


# ------------------------------------------------------------------ near-duplicates of documents


def shingle_levels(docs: DataFrame, shingle: int, bits: int = 22) -> np.ndarray:
    """For each value of a hash's first ``bits`` bits, how common shingles of it are, in half powers of two.

    It only orders the shingles, the rare ones first, so values that share a counter do no harm.
    """
    part = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, _, h, _ in doc_shingles(batch.column(0), shingle):
                np.add.at(n, (h >> U64(64 - bits)).astype(np.int64), 1)
        for k in range(len(n) // part):
            own = n[k * part : (k + 1) * part]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed(own.astype(np.int64))], pa.binary())], names=["part", "n"])

    out = np.zeros(1 << bits, np.uint8)
    rows = fresh(docs, "text").mapInArrow(count, "part long, n binary")
    for r in added_tables(rows, last=lambda n: np.round(2 * np.log2(n + 1)).astype(np.uint8).tobytes()).collect():  # 64 rows of 64 KB
        out[r.part * part : (r.part + 1) * part] = np.frombuffer(r.n, np.uint8)
    return out


def unique_shingles(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of documents: its range, the distinct shingle hashes of each, their offsets, and a hash of each set."""
    for i, j, h, so in doc_shingles(column, shingle):
        doc = np.repeat(np.arange(j - i), np.diff(so))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[once], doc[once]
        at = np.searchsorted(doc, np.arange(j - i + 1))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h), dtype=U64)])
        yield i, j, h, at, total[at[1:]] - total[at[:-1]]


def set_signatures(docs: DataFrame, shingle: int, words: int, similarity: float) -> DataFrame:
    """doc_id, whole (hash of the set of shingles), fp (its SimHash), sig, prefix.

    sig: the set's size, then for each of 64 x ``words`` cells whether an odd number of shingles fall
    into it. Two sets differ in as many shingles at least as their parities differ in cells. prefix:
    the set's rarest shingles, so many that two sets of ``similarity`` have one of them in common.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, shingle))
    cells = 64 * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        bits = 64 - (len(level).bit_length() - 1)
        for batch in batches:
            whole, fp, sig, prefix = [], [], [], []
            for i, j, h, at, sums in unique_shingles(batch.column(1), shingle):
                n = np.diff(at)
                doc = np.repeat(np.arange(j - i), n)
                whole.append(sums)
                fp.append(simhash(h, at))
                for s in range(0, j - i, 512):
                    e = min(s + 512, j - i)
                    cell = (doc[at[s] : at[e]] - s) * cells + (h[at[s] : at[e]] % U64(cells)).astype(np.int64)
                    odd = np.bincount(cell, minlength=(e - s) * cells).reshape(e - s, cells) & 1
                    odd = np.packbits(odd.astype(bool), axis=1, bitorder="little")
                    sig += [int(k).to_bytes(8, "little") + row.tobytes() for k, row in zip(n[s:e], odd, strict=True)]
                rare = h[np.lexsort((h, level[(h >> U64(bits)).astype(np.int64)], doc))]
                keep = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
                prefix += [rare[a : a + k].view(np.int64) for a, k in zip(at[:-1], keep, strict=True)]
            join = lambda parts: pa.array((np.concatenate(parts) if parts else np.empty(0, U64)).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), join(whole), join(fp), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "whole", "fp", "sig", "prefix"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return fresh(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, whole long, fp long, sig binary, prefix array<long>")


def verified_links(docs: DataFrame, classes: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those links a, b of ``classes`` whose sets of shingles have a Jaccard similarity of ``similarity`` or more."""
    ids = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    first = classes.join(shuffled(ids), "id", "left_semi").select(F.col("first").alias("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at, whole in unique_shingles(batch.column(0), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "s"])

    # A doc_id may stand on several texts, so a set is told by its own hash.
    have = fresh(docs, "doc_id", "text").join(shuffled(first.distinct()), "doc_id", "left_semi").select("text").mapInArrow(sets, "id long, s binary")
    have = cut(have.join(shuffled(ids), "id", "left_semi").dropDuplicates(["id"]), "sets")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets_of = lambda c: shuffled(have.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")))
    pairs = links.join(sets_of("a"), "a").join(sets_of("b"), "b")
    return pairs.select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long")


def fingerprint_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links a, b of classes whose SimHashes are within ``radius``, found by the generalised pigeonhole principle.

    Classes of one SimHash are tied to its least, and the least of those within the radius to each other.
    """
    least = cut(classes.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    same = classes.join(shuffled(least), "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    near, _ = hamming_links(least, radius)
    side = lambda c: shuffled(least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id")))
    near = near.join(side("a"), "a").join(side("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return same.union(near).distinct()


def _blocks(member: DataFrame, classes: DataFrame, *block: str) -> DataFrame:
    """ids, ties, words of each block of a bucket that holds two members or more."""
    member = member.join(shuffled(classes.select("id", "sig")), "id")
    lists = member.groupBy("key", *block).agg(F.collect_list("id").alias("ids"), F.collect_list("tie").alias("ties"), F.collect_list("sig").alias("words"))
    return lists.where("size(ids) > 1")


def _tied(member: DataFrame, roots: DataFrame) -> DataFrame:
    """``member`` with tie: the component of each member by the links found so far."""
    return member.join(shuffled(roots), F.col("id") == F.col("node"), "left").withColumn("tie", F.coalesce("root", "id")).drop("node", "root")


def _apart(tied: DataFrame) -> DataFrame:
    """The members of the buckets that are not yet one component."""
    keys = tied.groupBy("key").agg(F.min("tie").alias("one"), F.max("tie").alias("other")).where("one <> other").select("key")
    return tied.join(shuffled(keys), "key")


def _rest_of_large(large: DataFrame, roots: DataFrame, half: int) -> DataFrame:
    """Blocks of large buckets in which those outside the bucket's greatest component meet all others.

    ``large``: key, nb (blocks), i (own block), id. Members of the greatest component are connected
    already, so their pairs are left out.
    """
    tied = cut(_tied(large, roots), "tied")
    counts = tied.groupBy("key", "tie").agg(F.count("*").alias("n"))
    great = counts.groupBy("key").agg(F.max_by("tie", F.struct("n", "tie")).alias("great"), (F.sum("n") - F.max("n")).alias("others"))
    great = great.where("others > 0").withColumn("no", F.expr(f"cast(ceil(others / {half}) as bigint)"))
    tied = tied.join(shuffled(great), "key").withColumn("o", F.expr("pmod(xxhash64(id, 3), no)"))
    side = tied.where("tie <> great").select("key", "id", "tie", "o", F.explode(F.expr("sequence(0L, nb - 1)")).alias("i"))
    every = tied.select("key", "id", "tie", F.explode(F.expr("sequence(0L, no - 1)")).alias("o"), "i")
    return side.union(every).distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2, words: int = 16, bucket: int = 256) -> DataFrame:
    """doc_id, group_id (its smallest doc_id): links between documents of at least ``similarity``.

    Texts with one set of shingles form a class. First classes whose 64-bit SimHashes are within
    ``radius`` are found by the generalised pigeonhole principle and verified on the exact sets. No
    radius that can be searched holds every pair of ``similarity``, so what is still apart is searched
    exactly: such classes share one of the rarest shingles of both (``set_signatures``), whatever the
    size of the table, and those that do form a bucket. The links that tie a bucket's members together
    are verified; then every pair of a bucket that is still in two components, unless sizes or parities
    rule it out. So the groups are the components of all pairs of ``similarity``.

    A bucket of more than ``bucket`` members is dealt into blocks, each with the same few leaders of the
    bucket; whoever is then outside the bucket's greatest component meets all its members. A null or
    empty text has no shingles; all such documents form one class. Rows without a doc_id get no group,
    and rows of one doc_id have a row each. Ids of any type that has an order.
    """
    own = cut(set_signatures(docs, shingle, words, similarity), "sets_of_documents")
    least = F.min_by(F.struct("fp", "sig", "prefix"), "doc_id").alias("s")
    classes = own.groupBy(F.col("whole").alias("id")).agg(F.min("doc_id").alias("first"), least).where("first is not null")
    classes = cut(classes.select("id", "first", "s.fp", "s.sig", "s.prefix"), "classes_of_sets")
    own = cut(own.select("doc_id", "whole"), "classes_of_documents", instead_of=own)
    real = classes.where("size(prefix) > 0")
    verify = lambda links: cut(verified_links(docs, classes, links, shingle, similarity), "verified")
    links = verify(cut(fingerprint_links(real.select("id", "fp"), radius), "links"))
    roots = cut(components(links), "components")
    keys = real.select("id", F.explode("prefix").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    half = max(bucket // 2, 1)
    member = keys.join(shuffled(sizes), "key").withColumn("nb", F.expr(f"if(c <= {bucket}, 1L, cast(ceil(c / {half}) as bigint))"))
    member = cut(member.select("key", "c", "nb", F.expr("pmod(xxhash64(id), nb)").alias("i"), "id"), "members")
    open_ = cut(_apart(_tied(member, roots)), "open", instead_of=member)
    # About a quarter of a block's size: the leaders of a large bucket, members of its first block.
    leaders = open_.where("nb > 1 and i = 0 and pmod(xxhash64(id, 7), 4) = 0").select("key", F.explode(F.expr("sequence(1L, nb - 1)")).alias("i"), "id", "tie")
    tried = cut(bucket_links(_blocks(open_.select("key", "i", "id", "tie").union(leaders), classes, "i"), similarity).distinct(), "links")
    links = links.union(verify(tried))
    roots = cut(components(links), "components")
    # The tree of a bucket of two has its only pair.
    small = cut(_tied(open_.where("nb = 1 and c > 2").select("key", "id"), roots), "tied_small")
    more = bucket_links(_blocks(_apart(small), classes), similarity, every=True)
    large = open_.where("nb > 1").select("key", "nb", "i", "id")
    if not large.isEmpty():
        more = more.union(bucket_links(_blocks(_rest_of_large(large, roots, half), classes, "i", "o"), similarity, every=True))
    more = cut(more.distinct().join(shuffled(tried), ["a", "b"], "left_anti"), "links")
    roots = components(links.union(verify(more)))
    member = classes.select("id", "first").join(shuffled(roots), F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    named = member.join(shuffled(member.groupBy("root").agg(F.min("first").alias("group_id"))), "root").select(F.col("id").alias("whole"), "group_id")
    return own.select("doc_id", "whole").join(shuffled(named), "whole", "left").select("doc_id", "group_id")


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate group.

    Rows without a doc_id name no group and stay.
    """
    groups = near_duplicate_groups(docs, **how)
    gone = groups.where("doc_id <> group_id").select("doc_id").distinct()
    return docs.join(shuffled(gone), "doc_id", "left_anti").select(docs.columns)
