"""Cells of embeddings: links planted at the threshold across cells are all found and counted once, with fewer meetings than all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_radar.llm import embedding_dedup as E
from listing_radar.llm import queries as Q


def planted(rng, n, dims, least=0.93):
    """Unit vectors, and for each of them one at a cosine just above, just below or well above the threshold."""
    base = rng.normal(size=(n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.choice([least + 1e-6, least - 1e-6, 0.95, 0.99], size=(n, 1))
    return np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])


def expected(ids, vectors, labels):
    product = vectors @ vectors.T
    linked = (product >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(ids), dtype=bool)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == low).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), low, strict=True)}
        low = new


@pytest.mark.parametrize(("cells", "block"), [(None, 1024), (1, 1024), (40, 1024), (64, 7)])
def test_no_planted_link_is_lost_or_counted_twice(spark, cells, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(5)
    vectors = planted(rng, 350, 24)
    vectors = np.concatenate([vectors, vectors[:40] + 0.02 * rng.normal(size=(40, 24))])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids, labels = rng.permutation(len(vectors)).astype(np.int64), (np.arange(len(vectors)) % 350) % 2
    df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, vectors, labels, strict=True)], "vec_id long, embedding array<double>, label int")
    want = expected(ids, vectors, labels)
    assert sum(n for n, _ in want.values()) > 400
    assert {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_dedup(df, cells=cells).collect()} == want


def test_query_with_planted_links(spark, tmp_path):
    """The given vectors hold no link, so shifted copies of them are planted beside them."""
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    shifted = [given.select((F.col("vec_id") + k * 100_000).alias("vec_id"), F.transform("embedding", lambda x, i: (x + F.when(i == k % 7, s).otherwise(0.0)).cast("float")).alias("embedding"), "label")
               for k, s in ((1, 0.35), (2, 0.45), (3, 0.2))]
    rows = given.select("vec_id", "embedding", "label")
    for more in shifted:
        rows = rows.unionByName(more)
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    table = spark.read.parquet(str(tmp_path / "embeddings.parquet")).toArrow().to_pydict()
    vectors = np.array(table["embedding"], dtype=np.float32).astype(np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    want = expected(np.array(table["vec_id"]), vectors, np.array(table["label"]))
    assert sum(n > 0 for n, _ in want.values()) > 100
    assert {r.vec_id: (r.n_links, r.component_id) for r in Q.op1_embedding_dedup(spark, str(tmp_path)).collect()} == want


def test_visits_grow_less_than_the_cells():
    """On random vectors, the worst case, a vector meets a falling share of the cells."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(4000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_pydict({"id": np.arange(4000), "label": np.zeros(4000, dtype=np.int64), "n": np.ones(4000, dtype=np.int64), "v": pa.array(vectors.tolist())})
    shares = []
    for cells in (16, 64, 256):
        centres = vectors[rng.choice(4000, cells, replace=False)]
        for _ in range(4):
            home = (vectors @ centres.T).argmax(axis=1)
            centres = np.array([vectors[home == k].sum(axis=0) if (home == k).any() else centres[k] for k in range(cells)])
            centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        shares.append(sum(b.num_rows for b in E._visit_rows([batch], centres, 0.93)) / 4000 / cells)
    assert shares[0] < 0.7 and shares[1] < 0.45 and shares[2] < 0.25, shares
    assert [E.cell_count(n) for n in (0, 255, 1030, 5681, 10**6, 10**9)] == [8, 8, 8, 16, 2048, 4096]
