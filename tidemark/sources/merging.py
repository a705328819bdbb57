"""Keyed merges into partitioned tables: only partitions that hold a changed row are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def upsert(path: str, changes: DataFrame, keys: list[str], partition: str, order: str) -> dict[str, int]:
    """Merge ``changes`` into the Parquet table at ``path``, partitioned by ``partition``; returns what was done.

    Of several changes of a key the last by ``order`` counts, then the greatest by its columns. Rows
    that are stored as they are change nothing, and without changed rows nothing is written. A key may
    move to another partition. Keys of the changes must not be null; the table's columns are those of
    the changes. The merged partitions are written beside the table first and then put in place
    partition by partition; a run that stops in between is made good by running it again, since a
    changed key is taken out of every partition that holds it. One writer at a time.
    """
    spark = changes.sparkSession
    columns = changes.columns
    newest = changes.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in columns if c not in (*keys, order)])).alias("_r")).select(*keys, "_r.*").select(*columns)
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        newest = cut(newest, "first_rows")
        newest.repartition(partition, *keys).write.partitionBy(partition).parquet(path)
        return {"inserted": newest.count(), "updated": 0, "partitions": newest.select(partition).distinct().count()}
    stored = spark.read.schema(changes.schema).parquet(path).select(*columns)
    old = stored.select(*keys, F.struct(*[c for c in columns if c not in keys]).alias("_old"))
    same = F.col("_old").eqNullSafe(F.struct(*[c for c in columns if c not in keys]))
    found = newest.join(old, keys, "left")
    changed = cut(found.where(~same).select(*columns, F.col(f"_old.{partition}").alias("_from"), F.col("_old").isNotNull().alias("_known")), "changed_rows")
    moved = changed.select(F.explode(F.array(partition, "_from")).alias("p")).where("p is not null").distinct()
    parts = [r.p for r in moved.collect()]  # values of the partition column, as many as the table has folders at the most
    if not parts:
        return {"inserted": 0, "updated": 0, "partitions": 0}
    rows = changed.select(*columns).dropDuplicates(keys)
    kept = stored.where(F.col(partition).isin(parts)).join(changed.select(*keys).distinct(), keys, "left_anti")
    merged = cut(kept.unionByName(rows), "merged_partitions")
    left = {r.p for r in merged.select(F.col(partition).alias("p")).distinct().collect()}
    merged.repartition(partition, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for p in parts:
        if p not in left:  # its last row went elsewhere
            fs.delete(_folder(spark, f"{path}/{partition}={p}")[1], True)
    counts = changed.select(*keys, "_known").distinct().groupBy("_known").count().collect()
    by = {r["_known"]: r["count"] for r in counts}
    return {"inserted": by.get(False, 0), "updated": by.get(True, 0), "partitions": len(parts)}
