"""Hard negatives against all pairs on small tables: clusters that zone maps can tell apart, ties, repeated rows, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_radar.llm import hard_negatives as H
from listing_radar.llm.hard_negatives import hard_negatives, hilbert_keys, score_bounds, write_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int"


def brute(rows, is_anchor, low=80, high=100):
    fine = [(i, [math.floor(256 * float(x)) for x in v], k) for i, v, k, *_ in rows
            if i is not None and k is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 65536 for x in v)]
    out = []
    for a, q, k in (r for r in fine if is_anchor(r[0])):
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, kind) for i, v, kind in fine if len(v) == len(q))
        for p, i, _ in [s for s in scored if s[2] == k and s[1] != a][:5]:
            fits = [(n, j) for n, j, kind in scored if kind != k and low * -p <= 100 * -n <= high * -p]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(fits[:5])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 6)) * 3
    out = [(i, (centres[i % 12] + rng.normal(size=6) * 0.2).astype(np.float32).tolist(), i % 4 if i % 5 else (i + 1) % 4, "x", 1) for i in range(900)]
    out += [(1000 + i, [1.0, 2.0, 0.5, 0.0, 0.0, 1.0], i % 3, "x", 1) for i in range(300)]  # a third are copies of one vector
    out += [(2000, None, 1, "x", 1), (2001, [1.0] * 6, None, "x", 1), (2002, [1.0, None] + [1.0] * 4, 1, "x", 1), (2003, [float("nan")] * 6, 1, "x", 1), (2010, [float("inf")] * 6, 1, "x", 1),
            (2020, [], 1, "x", 1), (2030, [1e6] * 6, 1, "x", 1), (None, [1.0] * 6, 1, "x", 1), (2040, [0.0] * 6, 1, "x", 1), (2050, [1.0, 2.0], 1, "x", 1), (2060, [2.0, 1.0], 2, "x", 1),
            (2070, [3.0, 1.0], 1, "x", 1), (2080, [60000.0] * 6, 1, "x", 1), (2081, [60000.0] * 6, 1, "x", 1), (2082, [59999.0] * 6, 2, "x", 1)]
    return out + out[:3] + out[20:22]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_all_pairs(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    anchor = F.col("vec_id") % 10 == 0
    want = brute(rows, lambda i: i % 10 == 0)
    assert got(hard_negatives(df, anchor)) == want
    monkeypatch.setattr(H, "ANCHORS", 16)
    monkeypatch.setattr(H, "ZONES", 4)
    monkeypatch.setattr(H, "TOGETHER", 2)
    assert got(hard_negatives(df, anchor, block=32)) == want
    assert got(hard_negatives(df, F.col("vec_id") == 20, low=50, high=90, block=64)) == brute(rows, lambda i: i == 20, 50, 90)


def test_string_ids_and_empty_tables(spark, rows):
    named = spark.createDataFrame([(f"v{i}", v, None if k is None else f"k{k}") for i, v, k, *_ in rows[:200]], "vec_id string, embedding array<double>, label string")
    want = sorted((f"v{a}", f"v{p}", rank, f"v{n}", s, t) for a, p, rank, n, s, t in brute(rows[:200], lambda i: i == 60))
    assert got(hard_negatives(named, F.col("vec_id") == "v60")) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(spark.createDataFrame(rows[:50], SCHEMA), F.lit(False)).count() == 0


def test_zone_maps_leave_blocks_out(spark, rows):
    df = spark.createDataFrame(rows[:900], SCHEMA)
    blocks = write_blocks(df, F.col("vec_id") == 36, block=32)
    tables = blocks.toArrow()
    anchor = next(r for r in tables.to_pylist() if r["anchors"])
    q = np.frombuffer(anchor["q"], "<i4").reshape(-1, 6)[anchor["anchors"][0]].astype(np.int64)[None]
    least, most = score_bounds(q, H._lists(tables.column("lows")), H._lists(tables.column("highs")))
    assert (most[0] >= anchor["floors"][0]).mean() < 0.5  # fewer than half of the blocks can hold a positive
    for r, lo, hi in zip(tables.to_pylist(), least[0], most[0], strict=True):
        scores = np.frombuffer(r["q"], "<i4").reshape(-1, 6).astype(np.int64) @ q[0]
        assert lo <= scores.min() and scores.max() <= hi and len(r["ids"]) <= 32


def test_curve_passes_from_neighbour_to_neighbour():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
        keys = hilbert_keys(grid, bits)
        path = grid[sorted(range(len(grid)), key=lambda i: keys[i].tobytes())]
        assert (np.abs(np.diff(path.astype(int), axis=0)).sum(axis=1) == 1).all()
