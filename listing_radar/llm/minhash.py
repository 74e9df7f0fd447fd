"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A text's set holds its distinct word shingles (A-Z folded, words ``[^\\x20\\x09-\\x0D]+``), as 64-bit hashes. The sketch throws
every element into one of ``t`` bins per round and keeps the least value of a bin; round i counts before round i + 1, and after
``t`` rounds the bin is fixed, so that every coordinate is filled after 2t rounds at most, mostly after two or three. Two sets
agree in a coordinate with the probability of their similarity.

Equal sets are folded into one representative first. Documents that share a band are compared with one of the bucket, the one that
meets most others; documents of one bucket that are not yet connected are then compared with each other, whatever the size of the bucket, so no
link between different sets is lost after banding. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from listing_radar.llm import flat
from listing_radar.llm.components import connected_components
from listing_radar.llm.storage import bound_batches, rows_of, stage

#: 44 bands of 6 coordinates: a pair at similarity 0.8 shares no band with probability 1.6e-6, one at 0.2 shares one with 0.003.
BANDS, ROWS = 44, 6
#: Coordinates of which four bits each are compared before a pair is verified: of the banded sketch for the first pairs, of a longer
#: sketch for documents that are compared with many others.
SIGNED, FINE = 256, 512
U = np.uint64


def fast_sketch(elements: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Sketches (texts x t) of the element runs given by ``bounds``; rows of empty runs stay at the largest value."""
    n = len(bounds) - 1
    top = np.iinfo(np.uint64).max
    sketch = np.full(n * t, top, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for i in range(2 * t):
        if not len(elements):
            break
        value = flat.mix(elements + U((2 * i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        place = (value >> U(32)) * U(t) >> U(32) if i < t else np.full(len(value), i - t, dtype=np.uint64)
        np.minimum.at(sketch, owner * t + place.astype(np.int64), (U(i) << U(32)) | (value & U(0xFFFFFFFF)))
        open_rows = (sketch.reshape(n, t) == top).any(axis=1)
        going_on = open_rows[owner]
        elements, owner = elements[going_on], owner[going_on]
    return sketch.reshape(n, t)


def unique_runs(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each run, sorted, and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(parts) if parts else values, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))


def _sets(batches, size: int):
    """(ids, distinct shingles, bounds) of bounded groups of rows."""
    for batch in batches:
        data, offsets = flat.texts(batch.column(1))
        for lo, hi in flat.slices(offsets):
            part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, firsts = flat.words(part, own)
            yield batch.column(0).slice(lo, hi - lo), *unique_runs(*flat.shingles(flat.word_hashes(part, starts, ends), firsts, size))


def sign_planes(sketch: np.ndarray, coordinates: int) -> np.ndarray:
    """Four bits of each coordinate, bit by bit: 64 coordinates to a long, the longs of the first bit first."""
    nibbles = np.zeros((len(sketch), coordinates), dtype=np.uint8)
    nibbles[:, : sketch.shape[1]] = (flat.mix(sketch) & U(15)).astype(np.uint8)
    return np.concatenate([np.packbits(nibbles >> p & 1, axis=1, bitorder="little") for p in range(4)], axis=1).view(np.uint64)


def _fine_rows(batches, size: int):
    for ids, elements, bounds in _sets(batches, size):
        signs = sign_planes(fast_sketch(elements, bounds, FINE), FINE)
        sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), _lists(signs, signs.shape[1]), sets], names=["id", "n_shingles", "signs", "elements"])


def _sketch_rows(batches, size: int, bands: int, rows: int):
    for ids, elements, bounds in _sets(batches, size):
        counts = np.diff(bounds)
        sketch = fast_sketch(elements, bounds, bands * rows)
        key = np.arange(bands, dtype=np.uint64)[None, :] + U(1)
        for k in range(rows):
            key = flat.mix(key * U(0xD6E8FEB86659FD93) + sketch.reshape(len(ids), bands, rows)[:, :, k])
        signs = sign_planes(sketch[:, :SIGNED], SIGNED)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.mix(elements + U(s)))]) for s in (1, 2)]
        prints = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(counts), *map(pa.array, prints), _lists(key, bands), _lists(signs, signs.shape[1])],
            names=["id", "n_shingles", "print_1", "print_2", "bands", "signs"])


def _set_rows(batches, size: int):
    for ids, elements, bounds in _sets(batches, size):
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64)))], names=["id", "elements"])


def similar(percent: int) -> Column:
    """Exact test on the arrays ``a`` and ``b`` of distinct elements."""
    return F.expr(f"100 * size(array_intersect(a, b)) >= {percent} * (size(a) + size(b) - size(array_intersect(a, b)))")


def _may_link(percent: int, coordinates: int) -> Column:
    """What linked pairs of sizes na, nb satisfy: a bound on the sizes, and on the coordinates that agree.

    A coordinate of a pair at the least similarity agrees in its four bits with probability p; 5.5 standard deviations are
    allowed below the mean, so such a pair is lost with a probability of 2e-8.
    """
    p, words = percent / 100 + (1 - percent / 100) / 16, coordinates // 64
    most = int(coordinates * (1 - p) + 5.5 * (coordinates * p * (1 - p)) ** 0.5)
    unequal = " + ".join("bit_count(" + " | ".join(f"(sa[{k * words + g}] ^ sb[{k * words + g}])" for k in range(4)) + ")" for g in range(words))
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {unequal} <= {most}")


def _described(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with sizes and signs of both ends."""
    side = reps.select("id", "n_shingles", "signs")
    return pairs.join(side.select(F.col("id").alias("u"), F.col("n_shingles").alias("na"), F.col("signs").alias("sa")), "u").join(
        side.select(F.col("id").alias("v"), F.col("n_shingles").alias("nb"), F.col("signs").alias("sb")), "v")


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar. Each text is read once and only sets of needed documents move."""
    pairs = stage(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    needed = stage(needed, "needed")
    texts = rows_of(docs, needed).select("id", "body")
    sets = texts.mapInArrow(functools.partial(_set_rows, size=size), f"id {dict(docs.dtypes)['id']}, elements array<bigint>").dropDuplicates(["id"])
    sets = stage(sets, "sets")
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("elements").alias("a")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("elements").alias("b")), "v")
    return stage(both.where(similar(percent)).select("u", "v"), "links")


def minhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                  bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Id, n_shingles, component_id and kept for every row of ``df``.

    Texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets. The component id is the least id
    reachable by links. Null, empty and blank texts have no shingles and are linked with nothing. A row with a null id is
    linked with nothing and kept, its component is null. Rows of one id are one document: the first set by value counts for
    its links, and all of them are kept or dropped together. Other columns of ``df`` are not looked at.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    id_type = dict(docs.dtypes)["id"]
    sketches = stage(docs.mapInArrow(
        functools.partial(_sketch_rows, size=size, bands=bands, rows=rows),
        f"id {id_type}, n_shingles long, print_1 long, print_2 long, bands array<bigint>, signs array<bigint>"), "sketches")
    usable = sketches.where("n_shingles > 0 and id is not null")
    reps = stage(usable.groupBy("print_1", "print_2").agg(
        F.min("id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands"), F.min("signs").alias("signs")), "representatives")
    copies = usable.select("id", "print_1", "print_2").join(reps.select("print_1", "print_2", F.col("id").alias("v")), ["print_1", "print_2"])
    copies = copies.where("id <> v").select(F.col("id").alias("u"), "v")

    slots = reps.select("id", F.explode("bands").alias("band"))
    buckets = slots.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(slots.join(buckets, "band"), "shared-slots")
    # the pivot of a bucket is the member that meets most others over all bands: in a group of copies, mostly their origin
    popular = shared.groupBy("id").agg(F.sum("n").alias("met"))
    pivots = shared.join(popular, "id").groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("met"), F.col("id").alias("pivot"))).alias("p"))
    pivots = pivots.select(F.col("band").alias("slot"), "p.pivot")
    members = stage(shared.join(pivots, F.col("band") == F.col("slot")).select("band", "id", "pivot", "n"), "members")
    first = _described(members.where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct(), reps)
    links = _verified(docs, first.where(_may_link(percent, SIGNED)).select("u", "v"), size, percent)
    comps = connected_components(links.unionByName(copies))
    comps = stage(comps, "components")

    # documents of one bucket that are still apart: compare those outside the pivot's component with all others
    apart = members.where("n > 2").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    centre = comps.select(F.col("node").alias("pivot"), F.col("component").alias("pc"))
    apart = apart.join(centre, "pivot", "left").withColumn("pc", F.coalesce("pc", "pivot"))
    outside = stage(apart.where("c <> pc").select("band", "id", "c", "pc"), "outside")
    open_bands = outside.select("band").distinct()
    inside = stage(apart.join(open_bands, "band", "left_semi").select("band", "id", "c"), "inside")
    side = rows_of(docs, inside.select("id").distinct()).select("id", "body").mapInArrow(
        functools.partial(_fine_rows, size=size), f"id {id_type}, n_shingles long, signs array<bigint>, elements array<bigint>").dropDuplicates(["id"])
    side = stage(side, "fine-sketches")
    near = outside.join(side, "id").select("band", "pc", F.col("id").alias("u"), F.col("c").alias("cu"), F.col("n_shingles").alias("na"), F.col("signs").alias("sa"), F.col("elements").alias("a"))
    far = inside.join(side, "id").select("band", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("n_shingles").alias("nb"), F.col("signs").alias("sb"), F.col("elements").alias("b"))
    # the exact test is part of the join's condition: no pair leaves the join that is not a link
    late = near.join(far, (near["band"] == far["band"]) & F.expr("cu <> cv and (cv = pc or u < v)") & _may_link(percent, FINE) & similar(percent))
    late = stage(late.select("u", "v").distinct(), "late-links")
    if not late.isEmpty():
        comps = connected_components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late))
    return sketches.join(comps.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id").eqNullSafe(F.col("id"))).alias("kept"))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    dropped = minhash_dedup(df, id_col, text_col, **settings).where("not kept").select(F.col(id_col).alias("_dropped")).distinct()
    return df.join(dropped, df[id_col] == dropped["_dropped"], "left_anti")
