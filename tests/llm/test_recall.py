"""Recall of near copies by similarity class, at two sizes."""

import random
from collections import defaultdict

import pytest

from tidemark.llm import simhash_dedup

CLASSES = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)]


def shingles(words):
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def planted(size, rng):
    """Texts of many lengths, and for some of them copies with a few words changed in each class of similarity."""
    word = lambda: rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "rs", "t"])
    texts = [[word() for _ in range(rng.choice([40, 90, 200, 500, 1500]))] for _ in range(size)]
    pairs = defaultdict(list)
    for i in range(0, size, 3):
        base = texts[i]
        for low, high in CLASSES:
            for _ in range(40):
                copy = list(base)
                for _ in range(rng.randint(1, max(1, len(base) // 40))):
                    copy[rng.randrange(len(copy))] = word()
                a, b = shingles(base), shingles(copy)
                s = len(a & b) / len(a | b)
                if low <= s < high:
                    pairs[low].append((i, len(texts)))
                    texts.append(copy)
                    break
    return texts, pairs


@pytest.mark.parametrize("size", [150, 900])
def test_recall_by_class_of_similarity(spark, size):
    texts, pairs = planted(size, random.Random(size))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    group = {r.doc_id: r.group_id for r in simhash_dedup.near_duplicate_groups(docs).collect()}
    recall = {low: sum(group[a] == group[b] for a, b in found) / len(found) for low, found in pairs.items()}
    assert set(recall) == {low for low, _ in CLASSES} and min(map(len, pairs.values())) >= size // 10
    assert all(r == 1 for r in recall.values()), recall
    alone = set(range(size)) - set(range(0, size, 3))
    assert all(group[k] == k for k in alone), "texts without a copy stay alone"


def test_tables_of_many_tasks_are_added(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.llm.storage import added_tables, packed, unpacked

    rows = spark.range(2000, numPartitions=2000).select((F.col("id") % 3).alias("part"), "id")
    pack = F.udf(lambda i: packed(np.array([i, -i, (1 << 40) * (i % 2)])), "binary")
    got = {r.part: unpacked(r.n).tolist() for r in added_tables(rows.select("part", pack("id").alias("n")), 16).collect()}
    own = lambda k: [i for i in range(2000) if i % 3 == k]
    assert got == {k: [sum(own(k)), -sum(own(k)), (1 << 40) * sum(i % 2 for i in own(k))] for k in range(3)}
    assert added_tables(rows.where("id < 0").select("part", pack("id").alias("n"))).count() == 0
