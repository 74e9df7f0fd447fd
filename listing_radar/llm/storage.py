"""Stage tables in the shared folder of the cluster, and bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Most rows and bytes that one Arrow batch hands to a Python task; a single longer text is still whole.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, as in tests on one machine, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.mkdtemp(prefix="corpus-"), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here and sizes are true.

    The table lives as long as the folder; every call writes a new one, so a failed or repeated run overwrites nothing.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a Python worker, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Up to so many ids are sent to every task to pick their rows; beyond, the same join is shuffled.
BROADCAST_IDS = 200_000


def rows_of(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``df`` whose ``key`` is among the (distinct) ``ids``."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")
