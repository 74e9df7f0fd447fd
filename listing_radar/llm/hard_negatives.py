"""Hard negatives by windows of scores over Hilbert-ordered blocks with zone maps.

Vectors become integers. The candidates are written in the order of a Hilbert curve through their components and cut into blocks, a
row of Parquet each, with the least and greatest value of every dimension. For an anchor, interval arithmetic over these values bounds
the scores that a block can hold. First the blocks that can hold one of its best rows of the same label are read, where a bound of
these is known from the anchor's own block; then those whose bounds meet the windows of its positives. Other blocks are not read by it.

Anchors are near each other in groups, since they follow the same curve; a group meets the zone maps, and then eight blocks, at a
time. Only the first few rows per anchor and window leave such a meeting, so no task holds all candidates of an anchor.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from listing_radar.llm.storage import bound_batches, stage

#: Bits of each dimension's place on the curve, and the factor of the integer components.
BITS, SCALE = 4, 256
#: Components from here on would not keep their products within 64 bits; their rows take no part.
LARGEST = 1 << 16
#: Rows of a block, blocks that are read together, zone maps and anchors that meet, blocks that an anchors' group spans at most.
BLOCK, TOGETHER, ZONES, ANCHORS, SPAN = 1024, 8, 4096, 4096, 128
LOWEST = -(1 << 62)


def hilbert_keys(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points (n x dimensions, each from 0 to 2^bits - 1), as rows of bytes that sort like them."""
    x = np.ascontiguousarray(places.T).astype(np.uint32)
    for bit in range(bits - 1, 0, -1):
        at, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(len(x)):
            inverted = (x[i] & at) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(inverted, low, swapped)
            x[i] ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint32)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip
    planes = [(x >> np.uint32(bit) & np.uint32(1)).astype(np.uint8) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``a`` with those of ``b``; in floating point where every sum is exact there."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)


def score_bounds(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor (row) can have with a vector inside each box (column)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, lows) + products(down, highs), products(up, highs) + products(down, lows)


def _key_rows(batches, middle: float, spread: float):
    """(id, label, anchor, v) to integer components and the place on the curve."""
    for batch in batches:
        sizes = np.asarray(batch.column(3).value_lengths())
        for size in np.unique(sizes).tolist():
            part = pa.Table.from_batches([batch]).take(pa.array(np.flatnonzero(sizes == size))).combine_chunks()
            values = np.asarray(part.column(3).combine_chunks().flatten().cast(pa.float64())).reshape(-1, size)
            whole = np.floor(SCALE * values).astype("<i4")
            places = np.clip(((values - middle) / (4 * spread) + 0.5) * (1 << BITS) if spread else np.zeros_like(values), 0, (1 << BITS) - 1).astype(np.uint32)
            for name, rows in (("q", whole.view(np.uint8).reshape(len(whole), -1)), ("place", hilbert_keys(places))):
                part = part.append_column(name, _binary(rows))
            yield from part.drop_columns(["v"]).append_column("size", pa.array(np.full(len(whole), size, dtype=np.int32))).to_batches()


def _binary(rows: np.ndarray) -> pa.Array:
    bounds = (rows.shape[1] * np.arange(len(rows) + 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Binary rows of ``size`` integers each as one matrix; a row may hold several vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]].view("<i4").reshape(-1, size).astype(np.int64)


def _codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Places of values in ``known``, -1 where absent."""
    return np.asarray(pc.index_in(values, value_set=known).fill_null(-1))


def _block_rows(batches, positives: int, block: int):
    """Rows (id, label, anchor, q, size) in order to blocks of rows of one size, with zone maps and the anchors' bounds."""
    from pyspark import TaskContext

    part, number, held = TaskContext.get().partitionId(), 0, None

    def build(rows: pa.Table) -> pa.RecordBatch:
        size = rows.column("size")[0].as_py()
        q = _matrix(rows.column("q"), size)
        ids, labels = rows.column("id").combine_chunks(), rows.column("label").combine_chunks()
        at = np.flatnonzero(np.asarray(rows.column("anchor").combine_chunks().cast(pa.int8())))
        kind, name = _codes(labels, labels.unique()), _codes(ids, ids.unique())
        floors = np.full(len(at), LOWEST, dtype=np.int64)
        for lo in range(0, len(at), 256):
            some = at[lo : lo + 256]
            scores = np.where((kind[some][:, None] == kind) & (name[some][:, None] != name), products(q[some], q), LOWEST)
            if len(q) >= positives:
                floors[lo : lo + 256] = np.partition(scores, len(q) - positives, axis=1)[:, len(q) - positives]
        values = [part, number, size, ids.to_pylist(), labels.to_pylist(), q.astype("<i4").tobytes(), q.min(axis=0).tolist(), q.max(axis=0).tolist(),
                  pc.min(labels).as_py(), pc.max(labels).as_py(), at.tolist(), floors.tolist()]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(ids.type), pa.list_(labels.type), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()),
                 labels.type, labels.type, pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=_BLOCK_NAMES)

    for batch in batches:
        held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
        while held.num_rows:
            same = int(np.searchsorted(np.asarray(held.column("size").combine_chunks()), held.column("size")[0].as_py(), side="right"))
            if same < block and same == held.num_rows:
                break  # more of them may come
            yield build(held.slice(0, min(same, block)).combine_chunks())
            held, number = held.slice(min(same, block)), number + 1
    while held is not None and held.num_rows:
        yield build(held.slice(0, block).combine_chunks())
        held, number = held.slice(block), number + 1


_BLOCK_NAMES = ["part", "block", "size", "ids", "labels", "q", "lows", "highs", "low_label", "high_label", "anchors", "floors"]


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.int64)


def _windows(positives: pa.ChunkedArray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, least and greatest score of every window, one per positive, in order."""
    column = positives.combine_chunks()
    counts = np.asarray(column.value_lengths().fill_null(0))
    scores = np.asarray(column.flatten().field("score")).astype(np.int64)
    return np.repeat(np.arange(len(column)), counts), -(-low * scores // 100), high * scores // 100


def _needed(key, anchors: pa.Table, zones: pa.Table, low: int, high: int) -> pa.Table:
    """The blocks that some anchor of the group must read: for its positives, or for their windows once they are known."""
    size, group = key[1].as_py(), key[0].as_py()
    hit = np.zeros(zones.num_rows, dtype=bool)
    if anchors.num_rows and zones.num_rows:
        lows, highs = _lists(zones.column("lows")), _lists(zones.column("highs"))
        windowed = "positives" in anchors.column_names
        low_label, high_label = zones.column("low_label").combine_chunks(), zones.column("high_label").combine_chunks()
        for lo in range(0, anchors.num_rows, 256):
            some = anchors.slice(lo, 256).combine_chunks()
            least, most = score_bounds(_matrix(some.column("q"), size), lows, highs)
            labels = some.column("label").combine_chunks()
            for label in labels.unique():
                own = np.flatnonzero(np.asarray(pc.equal(labels, label).cast(pa.int8())))
                if windowed:
                    pure = np.asarray(pc.and_(pc.equal(low_label, label), pc.equal(high_label, label)).cast(pa.int8())) > 0
                    owner, start, end = _windows(some.column("positives").take(pa.array(own)), low, high)
                    for w in range(len(owner)):
                        if start[w] <= end[w]:
                            hit |= ~pure & (most[own[owner[w]]] >= start[w]) & (least[own[owner[w]]] <= end[w])
                else:
                    among = np.asarray(pc.and_(pc.less_equal(low_label, label), pc.greater_equal(high_label, label)).cast(pa.int8())) > 0
                    floors = np.asarray(some.column("floor").combine_chunks())[own]
                    hit |= among & (most[own] >= floors[:, None]).any(axis=0)
    at = np.flatnonzero(hit)
    return pa.table({"group": pa.array(np.full(len(at), group, dtype=np.int64)), "size": pa.array(np.full(len(at), size, dtype=np.int32)),
                     "part": zones.column("part").take(pa.array(at)), "block": zones.column("block").take(pa.array(at))})


def _firsts(owner: np.ndarray, score: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of every owner, by score from above, then by the rank of the id."""
    order = np.lexsort((rank, -score, owner))
    new = np.concatenate([[True], np.diff(owner[order]) != 0]) if len(order) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < most]


def _read(key, anchors: pa.Table, blocks: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """First rows of some blocks for a group of anchors: same-label rows per anchor, or other rows per window of an anchor."""
    size = key[1].as_py()
    windowed = "positives" in anchors.column_names
    names, labels = anchors.column("id").combine_chunks(), anchors.column("label").combine_chunks()
    known, kinds = names.unique(), labels.unique()
    own_name, own_kind, q = _codes(names, known), _codes(labels, kinds), _matrix(anchors.column("q"), size)
    if windowed:
        window_owner, start, end = _windows(anchors.column("positives"), low, high)
        first = np.searchsorted(window_owner, np.arange(len(q) + 1))
    else:
        floors = np.asarray(anchors.column("floor").combine_chunks())
    best_owner, best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64), names.slice(0, 0)
    for b in range(blocks.num_rows):
        one = blocks.slice(b, 1)
        vectors = _matrix(one.column("q"), size)
        ids, of = one.column("ids").combine_chunks().flatten(), one.column("labels").combine_chunks().flatten()
        name, kind = _codes(ids, known), _codes(of, kinds)
        least, greatest = score_bounds(q, _lists(one.column("lows")), _lists(one.column("highs")))
        if windowed:
            meets = np.zeros(len(q), dtype=bool)
            meets[window_owner[(start <= end) & (greatest[window_owner, 0] >= start) & (least[window_owner, 0] <= end)]] = True
        else:
            meets = greatest[:, 0] >= floors
        reading = np.flatnonzero(meets)
        for lo in range(0, len(reading), 256):
            some = reading[lo : lo + 256]
            scores = products(q[some], vectors)
            same = own_kind[some][:, None] == kind
            if windowed:
                lowest = np.full(len(q), 1 << 62, dtype=np.int64)
                np.minimum.at(lowest, window_owner, start)
                highest = np.full(len(q), LOWEST, dtype=np.int64)
                np.maximum.at(highest, window_owner, end)
                row, col = np.nonzero(~same & (scores >= lowest[some][:, None]) & (scores <= highest[some][:, None]))
                score, anchor = scores[row, col], some[row]
                n = np.diff(first)[anchor]
                window = np.repeat(first[:-1][anchor], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                score, col = np.repeat(score, n), np.repeat(col, n)
                inside = (score >= start[window]) & (score <= end[window])
                owner, score, col = window[inside], score[inside], col[inside]
            else:
                row, col = np.nonzero(same & (own_name[some][:, None] != name) & (scores >= floors[some][:, None]))
                owner, score = some[row], scores[row, col]
            ranked = np.unique(np.asarray(ids), return_inverse=True)[1]
            keep = _firsts(owner, score, ranked[col], most)
            best_owner, best_score = np.concatenate([best_owner, owner[keep]]), np.concatenate([best_score, score[keep]])
            best_id = pa.concat_arrays([best_id, ids.take(pa.array(col[keep]))])
        keep = _firsts(best_owner, best_score, np.unique(np.asarray(best_id), return_inverse=True)[1] if len(best_id) else best_owner, most)
        best_owner, best_score, best_id = best_owner[keep], best_score[keep], best_id.take(pa.array(keep))
    number = anchors.column("anchor").combine_chunks()
    if not windowed:
        return pa.table({"anchor": number.take(pa.array(best_owner)), "window": pa.array(np.zeros(len(best_owner), np.int32)), "id": best_id, "score": best_score})
    return pa.table({"anchor": number.take(pa.array(window_owner[best_owner])), "window": pa.array((best_owner - first[:-1][window_owner[best_owner]]).astype(np.int32)),
                     "id": best_id, "score": best_score})


def write_blocks(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, block: int = BLOCK) -> DataFrame:
    """The candidates in Hilbert order as a written table: part, block, size, ids, labels, q (vectors), lows, highs, low_label,
    high_label, anchors (their places in the block), floors (a bound of their positives' scores)."""
    bound_batches(df.sparkSession)
    given = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    fine = F.expr(f"size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {LARGEST})")
    given = given.where("id is not null and label is not null").where(fine)
    add = lambda f: F.sum(F.aggregate("v", F.lit(0.0), f))
    n, total, squares = given.agg(F.sum(F.size("v")), add(lambda a, x: a + x), add(lambda a, x: a + x.cast("double") * x)).first()
    middle = total / n if n else 0.0
    spread = max(squares / n - middle**2, 0.0) ** 0.5 if n else 0.0
    kinds = dict(given.dtypes)
    keyed = given.mapInArrow(functools.partial(_key_rows, middle=middle, spread=spread), f"id {kinds['id']}, label {kinds['label']}, anchor boolean, q binary, place binary, size int")
    ordered = keyed.repartitionByRange("size", "place", "id").sortWithinPartitions("size", "place", "id").select("id", "label", "anchor", "q", "size")
    schema = (f"part int, block long, size int, ids array<{kinds['id']}>, labels array<{kinds['label']}>, q binary, lows array<int>, highs array<int>, "
              f"low_label {kinds['label']}, high_label {kinds['label']}, anchors array<int>, floors array<long>")
    return stage(ordered.mapInArrow(functools.partial(_block_rows, positives=positives, block=block), schema), "blocks")


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5,
                   negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``df`` where ``anchors`` is true.

    A component x counts as floor(256 * x), a score is the integer inner product, higher scores come first, ties by the smaller id.
    An anchor's positives are its first other rows of the same label; for each of them the first rows of other labels follow whose
    score is between ``low`` and ``high`` percent of the positive's. Windows without such rows give none.

    Rows with a null id, label or vector, an empty vector, or a component that is null, not finite or beyond ``LARGEST`` take no
    part. Vectors of different length are never compared. A repeated row is a row of its own, but no row of the anchor's own id is
    its positive. Other columns are not looked at; an empty table gives no rows.
    """
    blocks = write_blocks(df, anchors, id_col, vector_col, label_col, positives, block)
    n_blocks, n_anchors = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()
    groups, chunks = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_blocks // ZONES))
    span = max(1, min(SPAN, ANCHORS * n_blocks // max(n_anchors, 1)))
    kinds = dict(blocks.dtypes)
    id_type = kinds["ids"][6:-1]
    own = F.expr("""transform(arrays_zip(anchors, floors), a -> named_struct('at', a.anchors, 'id', ids[a.anchors], 'label', labels[a.anchors],
        'q', substring(q, 4 * size * a.anchors + 1, 4 * size), 'floor', a.floors))""")
    group = F.pmod(F.xxhash64("part", F.floor(F.col("block") / span)), F.lit(groups))
    asked = stage(blocks.select("part", "block", "size", group.alias("group"), F.explode(own).alias("a")).select(
        F.expr(f"(cast(part as long) * {1 << 32} + block) * {block} + a.at").alias("anchor"), "group", "size", "a.id", "a.label", "a.q", "a.floor"), "anchors")
    zones = blocks.select("part", "block", "size", "lows", "highs", "low_label", "high_label", F.pmod(F.xxhash64("part", "block"), F.lit(chunks)).alias("chunk"))

    def meet(anchors: DataFrame, most: int) -> DataFrame:
        """First rows per anchor and window among the blocks that the zone maps leave."""
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        needs = anchors.withColumn("chunk", every(chunks)).groupBy("group", "size", "chunk").cogroup(
            zones.withColumn("group", every(groups)).groupBy("group", "size", "chunk")).applyInArrow(
            functools.partial(_needed, low=low, high=high), "group long, size int, part int, block long")
        needs = stage(needs.withColumn("together", F.floor(F.col("block") / TOGETHER)), "needed-blocks")
        tile = ["group", "size", "part", "together"]
        tiles = needs.select(*[F.col(c).alias(f"tile_{c}") for c in tile]).distinct()
        read = blocks.select("part", "block", "ids", "labels", "q", "lows", "highs").join(needs, ["part", "block"])
        asking = anchors.join(tiles, F.expr("group = tile_group and size = tile_size"))
        met = asking.groupBy(*[f"tile_{c}" for c in tile]).cogroup(read.groupBy(*tile)).applyInArrow(
            functools.partial(_read, most=most, low=low, high=high), f"anchor long, window int, id {id_type}, score long")
        first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        return stage(met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most), "first-rows")

    found = meet(asked, positives)
    best = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # at most ``positives``
    told = stage(asked.join(best, "anchor"), "windows")
    chosen = meet(told, negatives)
    rows = chosen.join(told.select("anchor", F.col("id").alias("anchor_id"), "positives"), "anchor")
    positive = F.element_at("positives", F.col("window") + 1)
    return rows.select("anchor_id", positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), positive["score"].alias("positive_score"),
                       F.col("score").alias("negative_score"))
