"""Repeated passages by longest-previous-factor arrays over the suffixes that can repeat.

Every window of ``length`` bytes is anchored at the least-hashed short gram in it, so equal windows have equal anchors, wherever
they stand. The windows of one anchor form a run; runs are counted by anchor and by content, with map-side combining. Runs of
equal content are repeats as they stand. What is left, anchors met in different contexts, is gathered by anchor in bounded
blocks, whose contexts are put in suffix order; the previous and the next smaller position in that order give the longest
earlier match of every suffix. Blocks of one frequent anchor are settled against each other by their distinct windows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from listing_radar.llm import flat
from listing_radar.llm.storage import bound_batches, rows_of, stage

LENGTH, GRAM = 200, 32
#: Most contexts of one anchor in a block, and bytes of contexts after which a task puts a chunk of blocks in order.
BLOCK_CONTEXTS, CHUNK_BYTES = 4_000, 1 << 20

U = np.uint64


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        keys, step = np.minimum(keys[:-step], keys[step:]), 2 * step
    return np.minimum(keys[: len(keys) - (width - step)], keys[width - step :]) if step < width else keys


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: text number, first window, number of windows, anchor hash, content hash."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    bits = U(int(n).bit_length())
    sums = flat.prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = flat.range_hashes(sums, at, at + gram)
    least = sliding_least(grams >> bits << bits | at.astype(np.uint64), length - gram + 1)
    anchor = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= offsets[text + 1]
    joined = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(valid & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(valid & ~np.concatenate([joined, [False]]))
    content = flat.mix(flat.range_hashes(sums, first, last + length) + (anchor[first] - first).astype(np.uint64) * U(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    return text[first], first, last - first + 1, grams[anchor[first]], content


def _run_rows(batches, length: int, gram: int):
    for batch in batches:
        data, offsets = flat.texts(batch.column(2))
        for lo, hi in flat.slices(offsets):
            base = offsets[lo]
            size = offsets[hi] - base
            # a text longer than a slice is worked through in parts that share length - 1 bytes
            for part in range(0, max(int(size) - length + 1, 1), flat.SLICE_BYTES if hi == lo + 1 else max(int(size), 1)):
                end = min(part + flat.SLICE_BYTES + length - 1, size) if hi == lo + 1 else size
                own = np.array([0, end - part]) if hi == lo + 1 else offsets[lo : hi + 1] - base
                text, first, count, anchor, content = anchored_runs(data[base + part : base + end], own, length, gram)
                if not len(first):
                    continue
                rows = pa.array(lo + text)
                place = part + first - own[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place << 8 | count)],
                    names=["anchor", "content", "id", "print", "run"])


def _context_rows(batches, length: int):
    """Cut the wanted contexts out of the texts; columns id, print, body, wanted."""
    for batch in batches:
        data, offsets = flat.texts(batch.column(2))
        data = data.tobytes()
        ids, prints = batch.column(0), batch.column(1)
        for i, wanted in enumerate(batch.column(3).to_pylist()):
            for k in range(0, len(wanted), 1_000):
                some = wanted[k : k + 1_000]
                cut = [data[offsets[i] + (w["run"] >> 8) : offsets[i] + (w["run"] >> 8) + (w["run"] & 255) - 1 + length] for w in some]
                again = pa.array([i] * len(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["anchor"] for w in some], pa.int64()), pa.array([w["block"] for w in some], pa.int32()), pa.array([w["frequent"] for w in some], pa.bool_()),
                     ids.take(again), prints.take(again), pa.array([w["run"] >> 8 for w in some], pa.int64()), pa.array([w["n"] for w in some], pa.int64()), pa.array(cut, pa.binary())],
                    names=["anchor", "block", "frequent", "id", "print", "place", "n", "context"])


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, ranks) of all positions by their first ``width`` bytes for doubling widths up to ``length``, least first."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * length + 8, dtype=np.uint8)])
    key = np.zeros(n + 2 * length, dtype=np.uint64)
    for k in range(8):
        key = key << U(8) | padded[k : k + len(key)]
    width, levels = 8, []
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        levels.append((width, rank.astype(np.int32)))
        if width == length:
            return levels
        step = min(width, length - width)
        key, width = rank[:-step] * np.int64(len(rank)) + rank[step:], width + step


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, or -1; values are distinct. Jumps over known answers."""
    n = len(values)
    at = np.arange(n) - 1
    guarded = np.append(values, np.iinfo(values.dtype).min)  # place -1
    while True:
        larger = guarded[at] > values
        if not larger.any():
            return at
        at = np.where(larger, at[at], at)


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``length``; in steps of 8 bytes below it."""
    same = levels[-1][1][a] == levels[-1][1][b]
    shared = np.where(same, length, 0)
    for width, rank in reversed(levels[:-1]):
        more = ~same & (shared + width < length) & (rank[a + shared] == rank[b + shared])
        shared = np.where(more, shared + width, shared)
    return shared


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at ``starts`` (ascending): the longest match that starts earlier, and the suffix ranks.

    In suffix order, ties in the order of position, the longest earlier match of a suffix is one with the nearest suffix
    before or after it that starts at a smaller position. Values are exact from ``length`` on, which is where they end.
    """
    levels = suffix_ranks(data, length)
    rank = levels[-1][1][starts]
    order = np.argsort(rank, kind="stable")
    position = starts[order]
    before = previous_smaller(position)
    after = len(position) - 1 - previous_smaller(position[::-1])[::-1]
    found = np.zeros(len(starts), dtype=np.int64)
    for other, known in ((before, before >= 0), (after, after < len(position))):
        at = np.flatnonzero(known)
        found[at] = np.maximum(found[at], common_prefix(levels, position[at], position[other[at]], length))
    out = np.empty(len(starts), dtype=np.int64)
    out[order] = found
    return out, rank


def _settle(table: pa.Table, length: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of a chunk of whole blocks, and the distinct windows of frequent anchors' blocks."""
    if pc.any(table.column("frequent")).as_py():  # blocks of one anchor may meet here: position must follow id, text and place
        order = [(c, "ascending") for c in ("anchor", "id", "print", "place")]
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
    data, offsets = flat.texts(table.column("context"))
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = offsets[owner] + inner
    factor, rank = longest_previous_factors(data, starts, length)
    earlier = factor >= length
    times = np.bincount(rank, minlength=int(rank.max(initial=0)) + 1)
    n, place = np.asarray(table.column("n")), np.asarray(table.column("place"))
    frequent = np.asarray(table.column("frequent"))
    hit = earlier if keep_first else (times[rank] > 1) & (n[owner] == 1)
    joined = hit[1:] & hit[:-1] & (owner[1:] == owner[:-1])
    first, last = np.flatnonzero(hit & ~np.concatenate([[False], joined])), np.flatnonzero(hit & ~np.concatenate([joined, [False]]))
    ids, prints = table.column("id").combine_chunks(), table.column("print").combine_chunks()

    def rows(at, begin, end, window, count):
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), prints.take(pa.array(at)), pa.array(begin), pa.array(end), pa.array(window, pa.int64()), pa.array(count, pa.int64())],
            names=["id", "print", "begin", "end", "window", "n"])

    if len(first):
        yield rows(owner[first], place[owner[first]] + inner[first], place[owner[first]] + inner[last] + length, [None] * len(first), [0] * len(first))
    if frequent.any():
        own = np.flatnonzero(~earlier & frequent[owner])
        value = np.empty(len(own), dtype=np.uint64)
        for k in range(0, len(own), 1 << 16):
            some = starts[own[k : k + (1 << 16)]]
            value[k : k + (1 << 16)] = flat.range_hashes(flat.prefix_hashes(data[some[0] : some[-1] + length]), some - some[0], some - some[0] + length)
        count = np.maximum(times[rank[own]], n[owner[own]])
        for k in range(0, len(own), 1 << 16):
            part = slice(k, k + (1 << 16))
            at = owner[own[part]]
            yield rows(at, place[at] + inner[own[part]], place[at] + inner[own[part]] + length, value[part].view(np.int64), np.minimum(count[part], 2))


def _settle_blocks(batches, length: int, keep_first: bool):
    """Rows sorted by anchor, block, id, print and place; the blocks of a chunk stay whole."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(7).nbytes
        if size < CHUNK_BYTES:
            continue
        table = pa.Table.from_batches(held)
        keys = np.stack([np.asarray(table.column("anchor")), np.asarray(table.column("block"))])
        changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(changes):
            yield from _settle_table(table.slice(0, changes[-1]), length, keep_first)
            held = table.slice(changes[-1]).combine_chunks().to_batches()
            size = sum(b.column(7).nbytes for b in held)
    if held:
        yield from _settle_table(pa.Table.from_batches(held), length, keep_first)


def _settle_table(table: pa.Table, length: int, keep_first: bool):
    """Drop repeated rows of one id and text, then settle about ``CHUNK_BYTES`` at a time, cut between blocks."""
    anchor, block, place, prints = (np.asarray(table.column(c)) for c in ("anchor", "block", "place", "print"))
    again = np.zeros(len(anchor), dtype=bool)
    again[1:] = (anchor[1:] == anchor[:-1]) & (block[1:] == block[:-1]) & (place[1:] == place[:-1]) & (prints[1:] == prints[:-1])
    if again.any():  # equal text and place: the same row only if the ids are equal too
        ids = table.column("id").to_pylist()
        again &= np.array([i > 0 and ids[i] == ids[i - 1] for i in range(len(ids))])
        table = table.filter(pa.array(~again))
        anchor, block = (np.asarray(table.column(c)) for c in ("anchor", "block"))
    if not len(anchor):
        return
    changes = np.flatnonzero((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])) + 1
    _, offsets = flat.texts(table.column("context"))
    cut, ends = [0], np.append(changes, len(anchor))
    for end in ends:
        if offsets[end] - offsets[cut[-1]] >= CHUNK_BYTES or end == len(anchor):
            yield from _settle(table.slice(cut[-1], end - cut[-1]), length, keep_first)
            cut.append(end)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.print") == F.col(f"{b}.print"))


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("print"), body.alias("body"))


def repeated_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """(id, print, ranges): byte ranges to remove per row of ``df``, rows without any left out; ``print`` is the text's hash.

    With ``keep_first`` a byte goes if a ``length``-byte string over it also starts earlier, in the order of id, text hash and
    place; without, if it also starts anywhere else. Null and short texts have no ranges. Rows that repeat an id and text share
    one entry; they count as repeats of each other only without ``keep_first``. Null ids are values like any other.
    """
    gram = min(GRAM, length // 2)
    if length - gram + 1 > 255:
        gram = length - 254
    spark = df.sparkSession
    bound_batches(spark)
    docs = _docs(df, id_col, text_col)
    kind = dict(docs.dtypes)["id"]
    runs = stage(docs.where(F.octet_length("body") >= length).mapInArrow(
        functools.partial(_run_rows, length=length, gram=gram), f"anchor long, content long, id {kind}, print long, run long"), "runs")
    met = runs.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("mixed")).where("n > 1").drop("n")
    met = stage(met, "met-anchors")  # read back, so that both sides of the join are shuffled for it and a frequent anchor can be split
    shared = stage(runs.join(met, "anchor"), "shared-runs")
    by_content = stage(shared.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "print", "run")).alias("first"), F.first("mixed").alias("mixed")), "contexts")
    begin, count = F.shiftright("run", 8), F.col("run").bitwiseAND(F.lit(255))
    whole = shared.drop("mixed").join(by_content.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"])
    if keep_first:
        whole = whole.where(~F.struct("id", "print", "run").eqNullSafe(F.col("first")))
    whole = whole.select("id", "print", begin.alias("begin"), (begin + count - 1 + length).alias("end"))

    apart = by_content.where("mixed").select("anchor", "n", "first.*")
    sizes = apart.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK_CONTEXTS).cast("int").alias("blocks"))
    dealt = apart.join(sizes, "anchor").select(
        "id", "print", F.struct("anchor", "run", F.least("n", F.lit(2)).alias("n"), F.pmod(F.xxhash64("print", "run"), "blocks").cast("int").alias("block"),
                                (F.col("blocks") > 1).alias("frequent")).alias("w"))
    wanted = stage(dealt.groupBy("id", "print").agg(F.collect_list("w").alias("wanted")), "wanted")
    source = rows_of(docs, wanted.select("print").distinct(), "print")
    cut = source.alias("a").join(wanted.alias("b"), _same("a", "b")).select("a.id", "a.print", "a.body", "b.wanted")
    contexts = cut.mapInArrow(functools.partial(_context_rows, length=length),
                              f"anchor long, block int, frequent boolean, id {kind}, print long, place long, n long, context binary")
    ordered = contexts.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "id", "print", "place")
    settled = stage(ordered.mapInArrow(functools.partial(_settle_blocks, length=length, keep_first=keep_first),
                                       f"id {kind}, print long, begin long, end long, window long, n long"), "settled")
    single = settled.where("window is not null")
    total = single.groupBy("window").agg(F.sum("n").alias("all"), F.min(F.struct("id", "print", "begin")).alias("first"))
    across = single.join(total, "window")
    across = across.where(~F.struct("id", "print", "begin").eqNullSafe(F.col("first"))) if keep_first else across.where("n = 1 and all > 1")
    every = whole.unionByName(settled.where("window is null").select("id", "print", "begin", "end")).unionByName(across.select("id", "print", "begin", "end"))
    return stage(every.groupBy("id", "print").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")), "ranges")


def union_of(ranges: list[dict]) -> list[tuple[int, int]]:
    """Disjoint ranges with gaps between them."""
    out: list[list[int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(r) for r in out]


def _left_over(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [0, *[x for span in spans for x in span], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def _digest_rows(batches):
    """Columns id, body, ranges."""
    for batch in batches:
        data, offsets = flat.texts(batch.column(1))
        data = data.tobytes()
        out = []
        for i, ranges in enumerate(batch.column(2).to_pylist()):
            raw, spans = data[offsets[i] : offsets[i + 1]], union_of(ranges)
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_left_over(raw, spans)).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c)) for c in zip(*out, strict=True))] if out else
                                         [batch.column(0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """Id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``df``, after removal to the byte."""
    ranges = repeated_ranges(df, id_col, text_col, length, keep_first)
    docs = _docs(df, id_col, text_col)
    changed = rows_of(docs, ranges.select("print").distinct(), "print").alias("a").join(ranges.alias("b"), _same("a", "b")).select("a.id", "a.body", "b.ranges")
    digests = changed.mapInArrow(_digest_rows, f"id {dict(docs.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    same = docs.select("id", "print", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("kept_sha256")).alias("a").join(
        ranges.select("id", "print").alias("b"), _same("a", "b"), "left_anti")
    same = same.select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    return digests.unionByName(same).withColumnRenamed("id", id_col)


def inside_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they cover only in part."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _text_rows(batches, text_at: int, length_at: int):
    """All columns of the table, then ranges: replace the text, and its length where there is a column for it."""
    for batch in batches:
        texts, columns = [], list(batch.columns[:-1])
        for text, ranges in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            raw = (text or "").encode()
            texts.append(_left_over(raw, inside_characters(raw, union_of(ranges))).decode())
        columns[text_at] = pa.array(texts, pa.string())
        if length_at >= 0:
            columns[length_at] = pa.array([len(t) for t in texts], columns[length_at].type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``df`` with the repeated passages cut from its texts, no character broken; every row stays, perhaps with an empty text.

    Columns keep names and order, whatever they are called; ``length_col``, if present, gets the new number of characters where a
    text has changed.
    """
    ranges = repeated_ranges(df, id_col, text_col, length, keep_first)
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at, text_at = df.columns.index(id_col), df.columns.index(text_col)
    length_at = df.columns.index(length_col) if length_col in df.columns else -1
    body = F.coalesce(F.col(f"c{text_at}"), F.lit(""))
    keyed = inner.withColumns({"id": F.col(f"c{at}"), "print": F.xxhash64(body)})
    mine = [f"a.c{i}" for i in range(len(df.columns))]
    changed = rows_of(keyed, ranges.select("print").distinct(), "print").alias("a").join(ranges.alias("b"), _same("a", "b")).select(*mine, "b.ranges")
    same = keyed.alias("a").join(ranges.select("id", "print").alias("b"), _same("a", "b"), "left_anti").select(*mine)
    cut = changed.mapInArrow(functools.partial(_text_rows, text_at=text_at, length_at=length_at), inner.schema)
    return cut.unionByName(same).toDF(*df.columns)
