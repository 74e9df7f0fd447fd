"""The rows of every stage of the pipeline against a small brute-force version fed with that stage's input."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import groups, needs_vocabulary, removed, shingle_set

import corpus_pipeline
from listing_radar.llm import queries as Q
from listing_radar.llm.quality_rules import STOP_WORDS

WORDS = "the of and alpha beta gamma delta river stone cloud märz señor X1 . ,".split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(900)) * rng.randrange(2) for _ in range(n))


def good(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return False
    n, chars = len(words), sum(map(len, words))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    stops = set(STOP_WORDS) | {w[0].upper() + w[1:] for w in STOP_WORDS}
    return (2 <= chars / n <= 12 and sum(c in "#*$%&|<>" for c in text) <= 0.1 * n and text.count("!") <= 0.3 * n
            and sum(c.isupper() for c in text) <= 0.3 * chars and sum(w in stops for w in words) >= 0.02 * n and len(lines) - len(set(lines)) <= 0.5 * len(lines))


def grams(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return set(words) | {(gap, a, b) for gap in (1, 2, 3) for a, b in zip(words, words[gap:])}


def not_toxic(docs, labels, order, alpha=3.0, beta=1.0, l1=12.0, l2=1.0, epochs=6):
    """Ids that one model with weights by n-gram scores below one half; ``order`` has the ids in the order of training."""
    features = {i: [*grams(text), None] for i, text in docs.items()}  # None is the bias, without an L1 term
    z, n = {}, {}

    def weight(f):
        limit, value = 0.0 if f is None else l1, z.get(f, 0.0)
        return 0.0 if abs(value) <= limit else (math.copysign(limit, value) - value) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for i in order:
            ws = [weight(f) for f in features[i]]
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(ws))))) - labels[i]
            for f, w in zip(features[i], ws):
                old = n.get(f, 0.0)
                n[f] = old + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(old)) / alpha * w
    return {i for i, found in features.items() if sum(map(weight, found)) < 0}


@needs_vocabulary
def test_rows_of_every_stage(spark, tmp_path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(Q.vocabulary())
    rng = random.Random(12)
    texts = [prose(rng, 110) for _ in range(160)]
    rows = [(i, t + (" vile brute" if i % 4 == 1 else "")) for i, t in enumerate(texts)]
    passage = prose(rng, 60)
    rows += [(500 + k, prose(rng, 70) + " " + passage + " " + prose(rng, 70)) for k in range(3)] + [(510, passage + " " + passage + prose(rng, 60))]
    rows += [(520, texts[2]), (521, texts[6] + " tail"), (522, "tail " + texts[6] + " more"), (523, texts[3][: len(texts[3]) // 2] + prose(rng, 60))]
    rows += [(530, None), (531, "short"), (532, "junk " * 100), (533, prose(rng, 60).upper()), (534, prose(rng, 60) + " !" * 40), (535, "\n".join(["the same line of words"] * 20)),
             (536, "\n".join(prose(rng, 6) for _ in range(20))), (537, prose(rng, 60) + " # $" * 9), (538, "w" * 30 + " " + " ".join(f"{'x' * 14}{k} the" for k in range(60)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = {i: int(i % 4 == 1) for i in range(160)}
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = {"": spark.read.parquet(f"{tmp_path}/documents.parquet")}
    for name, function in corpus_pipeline.STAGES:
        function(spark, list(given.values())[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        given[name] = spark.read.parquet(f"{tmp_path}/{name}")
    got = {name: {r.doc_id: tuple(r) for r in df.select(*COLUMNS).collect()} for name, df in given.items() if name != "packing"}
    assert all(given[name].count() == len(out) for name, out in got.items())

    assert got["quality_rules"] == {i: r for i, r in got[""].items() if good(r[1])}
    before = got["quality_rules"]
    learnt = {i for i in before if i in labels and zlib.crc32(str(i).encode()) % 5}
    hashed = given["quality_rules"].select("doc_id", F.expr("pmod(crc32(cast(doc_id as string)), 5)").alias("m")).where("m <> 0").join(
        spark.createDataFrame(list(labels.items()), "doc_id long, label int"), "doc_id").orderBy(F.xxhash64("doc_id", "label", F.lit(11)))
    order = [r.doc_id for r in hashed.collect()]
    assert set(order) == learnt
    clean = not_toxic({i: r[1] for i, r in before.items()}, labels, order)
    assert got["toxicity"] == {i: before[i] for i in clean} and 0 < len(clean) < len(before)

    before = got["toxicity"]
    sets = {i: shingle_set(r[1], 5) for i, r in before.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert linked and got["minhash"] == {i: before[i] for i in set(groups(sets, linked).values())}

    before = got["minhash"]
    left = {i: t.decode() for i, t in removed([(i, r[1]) for i, r in before.items()], 200, True).items()}
    want = {i: (i, left[i], r[2], r[3], len(left[i]) if left[i] != r[1] else r[4]) for i, r in before.items()}
    assert got["suffix_dedup"] == want and any(left[i] != r[1] for i, r in before.items())

    ids = {i: np.array([*library.encode(r[1], add_special_tokens=False).ids, 2], dtype="<u4") for i, r in got["suffix_dedup"].items()}
    pieces, at = [], 0
    for r in given["suffix_dedup"].select("doc_id").collect():
        start = 0
        while start < len(ids[r.doc_id]):
            length = min(len(ids[r.doc_id]) - start, 4096 - at % 4096)
            pieces.append((r.doc_id, start, length, zlib.crc32(ids[r.doc_id][start : start + length].tobytes())))
            start, at = start + length, at + length
    fields = ("doc_id", "start", "length", "ids_crc32")
    assert sorted(tuple(r) for r in given["packing"].select(*fields).collect()) == sorted(pieces) and at > 4096

    # run() may order the documents otherwise, so its cuts are taken as they are
    out = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.sequence_id, r.offset))
    place, reached = 0, dict.fromkeys(ids, 0)
    for r in out:
        assert 4096 * r.sequence_id + r.offset == place and reached[r.doc_id] == r.start
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        place, reached[r.doc_id] = place + r.length, reached[r.doc_id] + r.length
    assert place == at and reached == {i: len(x) for i, x in ids.items()}
