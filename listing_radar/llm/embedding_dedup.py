"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors of one label are folded first. The number of cells grows with the vectors of the largest label. A vector is compared
within its own cell, and visits each other cell for which its lead (how much nearer its own centre is) is small: of two linked
vectors u and v with centres a and b, the leads of u over b and of v over a add up to (u - v)(a - b), at most sqrt(2 - 2c) * |a - b| at
cosine c, so the lesser one is at most half of that. Visiting up to this half, one of the two visits the other's cell, and no link is
lost. A pair that meets in both cells counts in the lower one, a pair that meets in one counts there for both.
A cell's vectors meet in blocks of bounded size; a block pair returns link counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from listing_radar.llm.components import connected_components
from listing_radar.llm.storage import bound_batches, stage

ROUNDS = 4
#: Distinct vectors of the largest label for which there is a cell, least and most cells (every task holds the centres), and vectors
#: from which these are fitted (chosen by hash).
PER_CELL, FEWEST, MOST, FITTED = 256, 8, 4096, 500_000
#: Vectors of a cell per block, and per set of other members that a block meets at a time.
BLOCK = 1024


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as unit rows in double precision."""
    values = np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _sum_rows(batches, centres: np.ndarray):
    """Sum and number of unit vectors per cell of this task, one row per cell and dimension."""
    total, count = np.zeros_like(centres), np.zeros(len(centres))
    for batch in batches:
        rows = unit_rows(batch.column(0))
        if rows.shape[1:] != centres.shape[1:]:
            continue
        cell = (rows @ centres.T).argmax(axis=1)
        np.add.at(total, cell, rows)
        count += np.bincount(cell, minlength=len(centres))
    k, d = np.nonzero(np.broadcast_to(count[:, None] > 0, centres.shape))
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[k, d])], names=["cell", "dim", "s"])


def fit_cells(vectors: DataFrame, dims: int, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of spherical k-means over the vectors (id, v) of ``dims`` components; sums are taken on the cluster."""
    same = vectors.where(F.size("v") == dims)
    seeds = same.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()
    centres = np.array([r.v for r in seeds], dtype=np.float64).reshape(len(seeds), dims)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for _ in range(rounds):
        sums = same.select("v").mapInArrow(functools.partial(_sum_rows, centres=centres), "cell int, dim int, s double").groupBy("cell", "dim").agg(F.sum("s").alias("s"))
        moved = np.zeros_like(centres)
        found = sums.toArrow()  # cells x dimensions
        moved[np.asarray(found["cell"]), np.asarray(found["dim"])] = np.asarray(found["s"])
        norms = np.linalg.norm(moved, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, moved / np.maximum(norms, 1e-12), centres)
    return centres


def cell_count(largest: int) -> int:
    """Cells for ``largest`` distinct vectors of one label, a power of two."""
    return min(MOST, max(FEWEST, 1 << max(1, largest // PER_CELL).bit_length() - 1))


def _visit_rows(batches, centres: np.ndarray, least: float):
    """(id, label, n, v) to one row per cell to meet in, with the vector's own cell and the set of cells that it meets in."""
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) else None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.asarray(batch.column(3).value_lengths())
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            part = table.take(pa.array(at))
            if size != centres.shape[1] or not len(centres):  # other dimensions have one cell
                meets, home = np.ones((len(at), 1), dtype=bool), np.zeros(len(at), dtype=np.int64)
            else:
                near = unit_rows(part.column(3).combine_chunks()) @ centres.T
                home = near.argmax(axis=1)
                lead = near[np.arange(len(at)), home][:, None] - near
                meets = lead <= 0.5 * (2 - 2 * least) ** 0.5 * apart[home] + 1e-9
            row, cell = np.nonzero(meets)
            sets = np.packbits(meets, axis=1, bitorder="little")
            met = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer((sets.shape[1] * np.arange(len(sets) + 1)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sets))])
            taken = part.append_column("home", pa.array(home.astype(np.int32))).append_column("met", met).take(pa.array(row)).combine_chunks()
            for name, values in (("size", np.full(len(row), size, dtype=np.int32)), ("cell", cell.astype(np.int32))):
                taken = taken.append_column(name, pa.array(values))
            yield from taken.to_batches(max_chunksize=2_000)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component in a small graph."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _block_links(table, least):
    """Links between the own vectors (role 1) and the others (role 2) of one block pair: their number, and the least id reached."""
    coded = table.column("id").combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    ids, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    place[np.asarray(order)] = np.arange(len(order))
    node, n, role = place[np.asarray(coded.indices)], np.asarray(table.column("n")), np.asarray(table.column("role"))
    cell, home, sets = table.column("cell")[0].as_py(), np.asarray(table.column("home")), table.column("met").combine_chunks()
    rows = unit_rows(table.column("v").combine_chunks())
    a, b = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
    x, y = np.nonzero(rows[a] @ rows[b].T >= least)
    x, y = a[x], b[y]
    differ = node[x] != node[y]
    x, y = x[differ], y[differ]
    if not len(x):
        return pa.table({"id": ids.slice(0, 0), "links": pa.array([], pa.int64()), "low": ids.slice(0, 0)})
    # the set of cells of each own vector with a link tells whether the pair also meets in the other's cell
    linked, which = np.unique(x, return_inverse=True)
    flags = np.array([np.frombuffer(s.as_py(), dtype=np.uint8) for s in sets.take(pa.array(linked))]).reshape(len(linked), -1)
    elsewhere = flags[which, home[y] >> 3] >> (home[y] & 7) & 1 > 0
    visitor = home[y] != cell
    counts = ~visitor | ~elsewhere | (cell < home[y])
    both = counts & visitor
    links = np.bincount(node[x[counts]], weights=n[y[counts]], minlength=len(ids)) + np.bincount(node[y[both]], weights=n[x[both]], minlength=len(ids))
    low = _forest(len(ids), node[x], node[y])
    at = np.unique(np.concatenate([node[x], node[y]]))
    return pa.table({"id": ids.take(pa.array(at)), "links": links[at].astype(np.int64), "low": ids.take(pa.array(low[at]))})


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, cells: int | None = None) -> DataFrame:
    """Id, n_links, component_id and kept for every row of ``df``.

    Vectors of one label (not null) and number of components are linked if their cosine in double precision is at least
    ``least``. Null, empty and zero vectors, and those with null or non-finite components, are linked with nothing. A row with a
    null id is linked with nothing and kept, its component is null. Repeated rows of one id count as one vector, the first by
    value, and share its result. Other columns are not looked at. ``cells`` follow the data where not given.
    """
    bound_batches(df.sparkSession)
    given = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    fine = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    usable = given.where("id is not null and label is not null and size(v) > 0").where(fine).groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    usable = stage(usable, "vectors")
    reps = stage(usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "label", "n", "v"), "representatives")
    usual = reps.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    centres = np.zeros((0, 0))
    if usual:
        same = reps.where(F.size("v") == usual.d)
        largest, total = same.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
        share = min(1.0, FITTED / total)  # in expectation
        some = same.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else same
        centres = fit_cells(some.select("id", "v"), usual.d, cells or cell_count(largest))
    kinds = dict(reps.dtypes)
    visits = stage(reps.mapInArrow(functools.partial(_visit_rows, centres=centres, least=least),
                                   f"id {kinds['id']}, label {kinds['label']}, n long, v {kinds['v']}, home int, met binary, size int, cell int"), "visits")
    where = ["label", "size", "cell"]
    met = visits.groupBy(*where).agg(F.ceil(F.sum((F.col("home") == F.col("cell")).cast("int")) / BLOCK).alias("homes"), F.ceil(F.count("*") / BLOCK).alias("members"))
    met = met.where("homes > 0")
    dealt = visits.join(met, where).withColumn("h", F.xxhash64("id"))
    own = dealt.where("home = cell").select("*", F.explode(F.sequence(F.lit(0), F.col("members").cast("int") - 1)).alias("col")).withColumn("row", F.pmod("h", "homes").cast("int")).withColumn("role", F.lit(1))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("homes").cast("int") - 1)).alias("row")).withColumn("col", F.pmod(F.xxhash64("h", F.lit(3)), "members").cast("int")).withColumn("role", F.lit(2))
    columns = ["id", "n", "v", "home", "met", *where, "row", "col", "role"]
    found = own.select(*columns).unionByName(other.select(*columns)).groupBy(*where, "row", "col").applyInArrow(
        lambda key, table: _block_links(table, least), f"id {kinds['id']}, links long, low {kinds['id']}")
    found = stage(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    copies = usable.join(reps.select(F.col("id").alias("rep"), "label", "v", "n"), ["label", "v"]).select("id", "rep", "n")
    copies = stage(copies, "copies")
    comps = connected_components(found.select(F.col("id").alias("u"), F.col("low").alias("v")).unionByName(copies.select(F.col("id").alias("u"), F.col("rep").alias("v"))))
    linked = copies.join(counts.withColumnRenamed("id", "rep"), "rep", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    component = F.coalesce("component", "id")
    return given.select("id").join(linked, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"))
