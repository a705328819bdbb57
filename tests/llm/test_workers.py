"""No task of the near-duplicate stage holds two Python workers at once: executors keep each worker that was ever needed."""

from pyspark.sql.classic.dataframe import DataFrame

from tidemark.llm import components, quality, simhash_dedup
from tidemark.llm.storage import cut


def chained(df):
    """Whether a task of the plan hands rows from one Python step to another; steps on two sides of an exchange are in different tasks."""
    above = []  # of each node over this line: its depth, and whether it is a Python step
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        name = line.lstrip(" :+-*").split("(")[0].split(" ")[0]
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        if name in ("Exchange", "BroadcastExchange"):
            above.append((depth, None))
        elif name.endswith(("InArrow", "InPandas", "EvalPython")):
            since = next((k for k in reversed(range(len(above))) if above[k][1] is None), -1)
            if any(python for _, python in above[since + 1 :]):
                return True
            above.append((depth, True))
        else:
            above.append((depth, False))
    return False


def test_a_task_holds_one_python_worker(spark, sf, monkeypatch):
    seen = []

    def watched(of):
        def run(df, *more, **named):
            seen.append(chained(df))
            return of(df, *more, **named)

        return run

    same = lambda batches: batches
    twice = spark.range(9).mapInArrow(same, "id long").mapInArrow(same, "id long")
    assert chained(twice) and not chained(spark.range(9).mapInArrow(same, "id long").repartition(3).mapInArrow(same, "id long"))
    monkeypatch.setattr(DataFrame, "collect", watched(DataFrame.collect))
    for module in (simhash_dedup, components):
        monkeypatch.setattr(module, "cut", watched(cut))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    simhash_dedup.keep_one_of_each(docs).collect()
    quality.context_vectors(docs)
    assert len(seen) > 10 and not any(seen)


def test_levels_of_shingles_are_those_of_their_counts(spark, sf):
    import numpy as np

    from tidemark.llm.kernels import U64, doc_shingles

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    n = np.zeros(1 << 18, np.int64)
    for _, _, h, _ in doc_shingles(docs.toArrow().column("text"), 5):
        np.add.at(n, (h >> U64(64 - 18)).astype(np.int64), 1)
    assert (simhash_dedup.shingle_levels(docs, 5, 18) == np.round(2 * np.log2(n + 1)).astype(np.uint8)).all()


def test_near_duplicates_broadcast_no_table(spark, monkeypatch):
    """Explodes and Python steps hold many times what Spark estimates, so the driver would hold what it can not foresee."""
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (simhash_dedup, components):
        monkeypatch.setattr(module, "cut", lambda df, *more, _cut=module.cut, **how: _cut(planned(df), *more, **how))
    words = [f"w{k}" for k in range(60)]
    rows = [(d, " ".join(words[d % 7 : 40 + d % 7] + [f"x{d // 3}"])) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = planned(simhash_dedup.keep_one_of_each(docs, bucket=8)).count()
    planned(simhash_dedup.simhash_components(docs)).count()
    assert 0 < kept < 40 and sum("Join" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]
