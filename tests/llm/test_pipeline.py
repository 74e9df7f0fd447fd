"""The pipeline's stages on planted documents."""

import os
import random

import pytest

import corpus_pipeline
from listing_radar.llm import queries as Q

WORDS = "the of and alpha beta gamma delta river stone cloud märz señor x1 . ,".split()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(Q.vocabulary()), reason="no vocabulary file")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(900)) * rng.randrange(2) for _ in range(n))


@needs_vocabulary
def test_stages_catch_what_is_planted(spark, tmp_path):
    rng = random.Random(9)
    texts = [prose(rng, 120) for _ in range(300)]
    rows = [(i, t + (" vile brute" if i % 5 == 1 else ""), "en", "s", len(t)) for i, t in enumerate(texts)]
    passage = prose(rng, 60)
    rows += [(1000, texts[2], "en", "s", 1), (1001, texts[3] + " tail", "en", "s", 1), (1002, "short", "en", "s", 5), (1003, "junk " * 100, "en", "s", 5), (1004, None, "en", "s", None)]
    rows += [(1010 + k, prose(rng, 70) + " " + passage + " " + prose(rng, 70), "en", "s", 1) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "suffix_dedup":
            left = [r.text for r in docs.where("doc_id between 1010 and 1012").collect()]
            assert sum(passage in t for t in left) == 1 and len(left) == 3
    quality, toxic, near = seen[:3]
    assert not quality & {1002, 1003, 1004} and len(quality) >= 300
    assert not toxic & {i for i in range(300) if i % 5 == 1} and {i for i in range(300) if i % 5 != 1} <= toxic
    assert {1000, 1001} & near == set() and {2, 3} <= near
    assert sum(r.length for r in docs.collect()) > 10_000 and set(seen[4]) == set(seen[3])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == seen[4]


def test_registered_names():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{n}" for n in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5
    with pytest.raises(KeyError):
        Q.queries()["op14"]
