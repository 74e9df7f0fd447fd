"""Token-id output: best-fit-decreasing packing into rows of an id matrix, written as Parquet.

Each task packs blocks of its documents. Documents longer than a row are split without loss; full rows stand alone, the rests go,
longest first, into the open row with the least sufficient room, found in a segment tree over the rooms. Every written row holds
the padded ids, the cumulative segment lengths and the places at which positions start again.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from listing_radar.llm.bpe import encoded_slices, ship_vocabulary
from listing_radar.llm.packing import END_ID, SEQUENCE_TOKENS, with_end
from listing_radar.llm.storage import bound_batches, new_table_path

#: Tokens that a task packs together; bounds its memory, and the unfilled rows to a few per block.
BLOCK_TOKENS = 2 << 20


class RoomTree:
    """Open rows by their room; a segment tree counts the rows under each range of rooms."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, and that room; it is no longer open then."""
        count, at = self.count, self.size + need
        while not count[at]:
            while at & 1:  # a right child has nothing to its right under its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Numbers of the pieces in each row; every length is between 1 and ``width``."""
    rows: list[list[int]] = []
    tree = RoomTree(width)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[piece]
        found = tree.take(length) if length < width else None
        row, room = found if found else (len(rows), width)
        if not found:
            rows.append([])
        rows[row].append(piece)
        if room > length:
            tree.add(room - length, row)
    return rows


def _pack_block(ids, doc_ids: pa.Array, bounds: np.ndarray, part: int, first_row: int, width: int, pad: int) -> pa.RecordBatch:
    counts = np.diff(bounds)
    pieces = -(-counts // width)
    doc = np.repeat(np.arange(len(counts)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
    length = np.minimum(counts[doc] - start, width)
    rows = best_fit_decreasing(length.tolist(), width)
    order = np.array([p for row in rows for p in row], dtype=np.int64)
    segments = np.array([len(row) for row in rows], dtype=np.int64)
    row_of = np.repeat(np.arange(len(rows)), segments)
    ends = np.cumsum(length[order])
    used = np.bincount(row_of, weights=length[order], minlength=len(rows)).astype(np.int64)
    offset = ends - length[order] - np.repeat(np.cumsum(used) - used, segments)
    matrix = np.full(len(rows) * width, pad, dtype="<u4")
    places, sources = row_of * width + offset, bounds[:-1][doc[order]] + start[order]
    for place, source, n in zip(places.tolist(), sources.tolist(), length[order].tolist(), strict=True):  # one copy per segment
        matrix[place : place + n] = ids[source : source + n]

    def lists(values, ends=None) -> pa.Array:
        bounds_ = np.concatenate([[0], np.cumsum(segments)])
        if ends is not None:
            values, bounds_ = np.insert(values, bounds_[1:], ends), bounds_ + np.arange(len(bounds_))
        values = values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(bounds_.astype(np.int32)), values)

    fixed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((4 * width * np.arange(len(rows) + 1)).astype(np.int32)), pa.py_buffer(matrix)])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(first_row + np.arange(len(rows))), fixed, pa.array(used.astype(np.int32)),
         lists(offset, used), lists(offset), lists(doc_ids.take(pa.array(doc[order]))), lists(start[order]), lists(counts[doc[order]])],
        names=["part", "row", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_starts", "doc_tokens"])


def _matrix_rows(batches, name: str, width: int, end_id: int, pad: int):
    part, row = TaskContext.get().partitionId(), 0
    held: list = []

    def flush():
        ids = np.concatenate([h[1] for h in held])
        steps = np.concatenate([np.diff(h[2]) for h in held])
        out = _pack_block(ids, pa.concat_arrays([h[0] for h in held]), np.concatenate([[0], np.cumsum(steps)]), part, row, width, pad)
        return out.num_rows, [out.slice(k, 256) for k in range(0, out.num_rows, 256)]

    for batch, lo, hi, ids, bounds in encoded_slices(batches, name):
        held.append((batch.column(0).slice(lo, hi - lo), *with_end(ids, bounds, end_id)))
        if sum(len(h[1]) for h in held) >= BLOCK_TOKENS:
            n, out = flush()
            yield from out
            row, held = row + n, []
    if held:
        yield from flush()[1]


def write_token_matrix(df: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = SEQUENCE_TOKENS,
                       end_id: int = END_ID, pad: int = 0) -> DataFrame:
    """Write the packed rows to ``path`` and return them as read back.

    A row (part, row) holds ``width`` little-endian unsigned 32-bit ids, of which ``n_tokens`` are not padding, ``cu_seqlens``
    (from 0 to n_tokens), ``position_resets`` (the places of the row at which positions start again at 0, one per segment), and for each
    segment its document, its start there and that document's number of ids. Null and empty texts have the end id only. Rows with
    a null or repeated id are documents of their own; other columns are not looked at; an empty table gives an empty output.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    schema = (f"part int, row long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
              f"doc_ids array<{dict(docs.dtypes)['id']}>, doc_starts array<int>, doc_tokens array<int>")
    rows = docs.mapInArrow(functools.partial(_matrix_rows, name=ship_vocabulary(spark, vocabulary), width=width, end_id=end_id, pad=pad), schema)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def segments(matrix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per segment, read from the written rows: id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    cut = matrix.withColumn("s", F.expr("""transform(doc_ids, (d, k) -> named_struct('id', d, 'start', doc_starts[k], 'doc_tokens', doc_tokens[k],
        'offset', cu_seqlens[k], 'length', cu_seqlens[k + 1] - cu_seqlens[k], 'ids', substring(ids, 4 * cu_seqlens[k] + 1, 4 * (cu_seqlens[k + 1] - cu_seqlens[k]))))"""))
    rows = cut.select(F.expr("cast(part as bigint) * 4294967296 + row").alias("sequence_id"), F.explode("s").alias("s"))
    return rows.select(F.col("s.id").alias(id_col), F.col("s.start").cast("long").alias("start"), F.col("s.length").cast("long").alias("length"), "s.ids",
                       F.col("s.doc_tokens").cast("long").alias("doc_tokens"), "sequence_id", F.col("s.offset").cast("long").alias("offset"))


def token_output(df: DataFrame, vocabulary: str, **settings) -> DataFrame:
    """The matrix written to a new table in the shared folder."""
    return write_token_matrix(df, vocabulary, new_table_path(df.sparkSession, "token-matrix"), **settings)
