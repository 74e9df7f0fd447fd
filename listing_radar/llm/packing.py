"""Packing by concatenation: prefix sums over partition totals place every token, fixed windows cut the stream.

The first pass writes each document's ids with its partition and its place in the partition. The totals of the partitions, one
row each, are summed up to global offsets; the second pass reads the written ids and cuts them at the windows. Only the last
sequence can need padding.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from listing_radar.llm.bpe import encoded_slices, ship_vocabulary
from listing_radar.llm.storage import bound_batches, stage

SEQUENCE_TOKENS, END_ID = 4096, 2


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by ``end_id``."""
    ends = bounds[1:] + np.arange(len(bounds) - 1)
    out, own = np.empty(len(ids) + len(ends), dtype=np.uint32), np.ones(len(ids) + len(ends), dtype=bool)
    out[ends], own[ends] = end_id, False
    out[own] = ids
    return out, bounds + np.arange(len(bounds))


def binary_rows(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of ids as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])


def _token_rows(batches, name: str, end_id: int):
    part, at = TaskContext.get().partitionId(), 0
    for batch, lo, hi, ids, bounds in encoded_slices(batches, name):
        ids, bounds = with_end(ids, bounds, end_id)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(hi - lo, part, dtype=np.int32)), pa.array(at + bounds[:-1]), batch.column(0).slice(lo, hi - lo),
            pa.array(np.diff(bounds)), binary_rows(ids, bounds)], names=["part", "place", "id", "doc_tokens", "ids"])
        at += int(bounds[-1])


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", width: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: id, start, length, ids (binary), doc_tokens, sequence_id, offset, padded_length.

    A document's ids are those of its text followed by ``end_id``; null and empty texts have that id only. Documents follow each
    other in the order of the written table, one piece per window they touch, so each id lies in exactly one piece and offsets are
    gapless. ``padded_length`` is ``width``, or for the last sequence its own length if that is a power of two. Repeated rows and
    null ids are documents like any other; other columns are not looked at.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    tokens = stage(docs.mapInArrow(
        functools.partial(_token_rows, name=ship_vocabulary(spark, vocabulary), end_id=end_id),
        f"part int, place long, id {dict(docs.dtypes)['id']}, doc_tokens long, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    everything = Window.orderBy("part")  # one row per partition of the input
    offsets = totals.select("part", (F.sum("n").over(everything) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("at", F.col("base") + F.col("place"))
    pieces = F.expr(f"""transform(sequence(at div {width}, (at + doc_tokens - 1) div {width}), s -> named_struct(
        'sequence_id', s, 'start', greatest(s * {width} - at, 0L), 'until', least((s + 1) * {width} - at, doc_tokens)))""")
    cut = placed.withColumn("cuts", pieces).withColumn("pieces", F.expr("""transform(cuts, c -> named_struct(
        'sequence_id', c.sequence_id, 'start', c.start, 'length', c.until - c.start,
        'ids', substring(ids, cast(4 * c.start + 1 as int), cast(4 * (c.until - c.start) as int))))"""))
    rows = cut.select("id", "doc_tokens", "at", "all", F.explode("pieces").alias("p"))
    used = F.col("all") - F.col("p.sequence_id") * width
    own = (used < width) & (F.bit_count(used) == 1)
    return rows.select(
        F.col("id").alias(id_col), F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.col("p.ids").alias("ids"), "doc_tokens",
        F.col("p.sequence_id").alias("sequence_id"), (F.col("at") + F.col("p.start") - F.col("p.sequence_id") * width).alias("offset"),
        F.when(own, used).otherwise(F.lit(width)).cast("long").alias("padded_length"))
