"""Keyed state in hash buckets: a batch reads and rewrites the buckets of its own keys only.

The data of a batch stand in a folder of its number, one folder per bucket. The manifest of a batch names the folder of every bucket
and is written last, so it commits the batch. A batch whose manifest is there already is not applied again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listing_radar.session import cut_to_table
from listing_radar.sources import manifests as M

BUCKETS = 256


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed batches, the newest last."""
    return sorted(int(name.removesuffix(".json")) for name in M.children(spark, f"{path}/manifests") if name[0] not in "_.")


def read_manifest(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(M.read_text(spark, f"{path}/manifests/{number:012d}.json"))


def read_state(spark: SparkSession, path: str, schema: str, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The state after the newest batch (with a number below ``before``), or some of its buckets; empty before the first one."""
    numbers = [n for n in committed(spark, path) if before is None or n < before]
    folders = read_manifest(spark, path, numbers[-1])["buckets"] if numbers else {}
    wanted = [f"{path}/{folder}" for bucket, folder in folders.items() if only is None or int(bucket) in only]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def fold_batch(spark: SparkSession, path: str, number: int, batch: DataFrame, key: str, schema: str, fold: Callable[[DataFrame, DataFrame], DataFrame],
               buckets: int = BUCKETS, keep: int = 3) -> list[int]:
    """Fold a batch into the state and return the rewritten buckets.

    ``fold(previous, batch)`` gives the new rows of the touched buckets; it must not change keys that the batch doesn't have. The number
    of buckets stays as the first batch set it. States before the last ``keep`` ones are deleted.
    """
    numbers = committed(spark, path)
    if number in numbers:
        return []
    earlier = [n for n in numbers if n < number]
    before = read_manifest(spark, path, earlier[-1]) if earlier else {"count": buckets, "buckets": {}}
    count, folders = before["count"], dict(before["buckets"])
    batch = cut_to_table(batch)
    touched = sorted(r.b for r in batch.select(bucket_of(F.col(key), count).alias("b")).distinct().collect())  # at most ``count``
    if touched:
        state = fold(read_state(spark, path, schema, number, touched), batch)
        written = state.withColumn("bucket", bucket_of(F.col(key), count)).hint("rebalance", "bucket")
        written.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number:012d}")
        folders |= {str(b): f"data/batch={number:012d}/bucket={b}" for b in touched}
    M.write_text(spark, f"{path}/manifests/{number:012d}.json", json.dumps({"count": count, "buckets": folders}))
    _drop_before(spark, path, keep)
    return touched


def _drop_before(spark: SparkSession, path: str, keep: int) -> None:
    numbers = committed(spark, path)
    kept = {folder for n in numbers[-keep:] for folder in read_manifest(spark, path, n)["buckets"].values()}
    for number in numbers[:-keep]:
        for folder in set(read_manifest(spark, path, number)["buckets"].values()) - kept:
            M.delete(spark, f"{path}/{folder}")
        M.delete(spark, f"{path}/manifests/{number:012d}.json")
