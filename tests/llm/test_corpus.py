"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import json
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_radar.llm import queries as Q
from listing_radar.llm.bpe import Bpe, decode, encode
from listing_radar.llm.chat_format import canonical_turns, conversation_digests, format_turns, read_turns
from listing_radar.llm.components import connected_components
from listing_radar.llm.embedding_dedup import embedding_dedup
from listing_radar.llm.minhash import fast_sketch, keep_representatives, minhash_dedup
from listing_radar.llm.packing import pack
from listing_radar.llm.quality_rules import keep_good, quality_rules
from listing_radar.llm.suffix_dedup import longest_previous_factors, remove_repeats, repeat_digests
from listing_radar.llm.token_output import best_fit_decreasing, segments, token_output
from listing_radar.llm.toxicity import Ftrl, fold_scores, reject_toxic, toxicity
from listing_radar.llm.url_filter import url_filter

WORDS = "the of and alpha beta gamma delta river stone cloud märz señor x1 . ,".split()
DOCS = "doc_id long, text string, component_id string, kept string"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(Q.vocabulary()), reason="no vocabulary file")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, 70 + 10 * i) for i in range(6)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(10 + i, t + " tail" + str(i)) for i, t in enumerate(base[:4])]
    out += [(20, base[0]), (21, base[1][:400] + prose(rng, 30)), (22, prose(rng, 20) + base[2][100:500])]
    out += [(30, None), (31, ""), (32, " \t\n"), (33, "one two"), (34, "one  TWO"), (35, "a" * 700), (36, "word " * 3000), (37, "é" * 300 + prose(rng, 5))]
    out += [(None, base[3]), (None, None), (40, base[4]), (40, base[4])]
    return [(i, t, "x", None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def test_quality_counts(spark, docs, rows):
    got = by_id(quality_rules(docs))
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 1000 else set(range(len(w)))
        if i is not None:
            r = got[i][0]
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered)), i
            assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality_rules(docs.limit(0)).count() == 0
    lines = spark.createDataFrame([(1, "a b\n \na b\na b\n\nc *#|<>$%&")], "doc_id long, text string")
    r = quality_rules(lines).first()
    assert (r.n_dup_lines, r.n_symbols, r.n_lines) == (2, 8, 4)
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2}


def test_url_rules_and_trees(spark):
    given = [("http://a.example.org/es/1", "example.org/es/", "block"), ("http://example.org/en/12?x", "example.org/en/1", "block"), ("https://ORG/a", "org/", "allow"),
             ("http://x.com/de/", "com/de/", "block"), ("http://x.com/fr/a", "com/fr/", "allow"), ("http://x.org?y=/a", None, None), ("no scheme", None, None), (None, None, None),
             ("http://forg/a", None, None), ("x://y://z/" + "p" * 20_000, None, None)]
    pages = spark.createDataFrame([(i if i else None, u, "clash") for i, (u, _, _) in enumerate(given)] + [(1, given[1][0], "again")], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter(pages).collect()}
    for i, (url, rule, verdict) in enumerate(given):
        r = got[i if i else None]
        assert r.rule == rule and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
        if i in (6, 7):
            assert (r.host, r.path) == ("", "")
    assert got[2].host == "org" and got[5].path == "" and got[9].host == "y:"
    assert url_filter(pages.limit(0)).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(2)
    texts = [prose(rng, 40) + (" vile brute" if i % 4 == 0 else "") for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9999, None, "x"), (None, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(3, None)], "doc_id long, toxic int")
    got = toxicity(docs, labels, s=Ftrl(bits=18, l1=2.0)).collect()
    assert len(got) == 602
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity(docs, flipped, s=Ftrl(bits=18, l1=2.0)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)  # labels of held-out rows have no influence
    clean = reject_toxic(docs, labels, s=Ftrl(bits=18, l1=2.0))
    assert clean.columns == docs.columns and clean.count() < 480
    assert [r.score for r in toxicity(docs.limit(1), labels.limit(0)).collect()] == [0.5]


def test_folds_leave_out_held_out_rows(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + (" vile brute" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, "x"), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(3, 0), (900, None)], "doc_id long, toxic int")
    s = Ftrl(bits=18, l1=2.0)
    got = {r.doc_id: r for r in fold_scores(docs, labels, s=s).collect()}
    remainder = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    assert set(got) == {i for i in remainder if remainder[i]}
    assert sum((r.score >= 0.5) == r.label for r in got.values()) >= 0.97 * len(got)
    # neither held-out labels nor those of a row's own fold have an influence on its score
    for changed, fold in ((0, None), (2, 2)):
        other = spark.createDataFrame([(i, int((i % 4 == 0) != (remainder[i] == changed))) for i, _ in rows], "doc_id long, toxic int")
        again = {r.doc_id: r.score for r in fold_scores(docs, other, s=s).collect()}
        assert all(again[i] == r.score for i, r in got.items() if fold is None or remainder[i] == fold)


def test_url_copies_do_not_fill_the_training_sample(spark):
    by_hash = spark.createDataFrame([(f"http://h{i}.org/{i}",) for i in range(100)] + [(f"http://h{i}.com/de/{i}",) for i in range(100)], "url string").orderBy(F.xxhash64("url"))
    urls = [r.url for r in by_hash.collect()]
    hot = next(u for u in urls if ".org/" in u)
    urls = urls[urls.index(hot):]  # nothing hashes lower than the hot URL
    pages = [(i, u) for i, u in enumerate(urls)] + [(1000 + i, hot) for i in range(300)] + [(5000, "http://new.com/zz/7"), (5001, "http://new.org?7")]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(pages, "page_id long, url string"), training_rows=150).collect()}
    assert len(got) == len(pages) and (got[5000].rule, got[5001].rule) == (None, None)
    assert (got[5000].verdict, got[5001].verdict) == ("block", "allow")


def test_toxicity_does_not_depend_on_the_length_of_texts(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 250) + (" vile brute" if i % 4 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    whole = {r.doc_id: r for r in toxicity(docs, labels, s=Ftrl(bits=18, l1=2.0)).collect()}
    spilled = {r.doc_id: r.score for r in toxicity(docs, labels, s=Ftrl(bits=18, l1=2.0, shard_bytes=100_000)).collect()}
    assert spilled == {i: r.score for i, r in whole.items()}
    held = [r for r in whole.values() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)


def shingle_set(text, size):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()


def groups(ids, linked):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_minhash_is_the_graph_of_all_pairs(docs, rows):
    sets = {i: shingle_set(t, 4) for i, t, *_ in rows if i is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = groups(sets, linked)
    got = by_id(minhash_dedup(docs, size=4))
    assert sum(map(len, got.values())) == len(rows)
    assert {i: got[i][0].component_id for i in sets} == comp and len(linked) > 5
    assert all(r.kept == (r.component_id == i) for i in sets for r in got[i]) and all(r.kept and r.component_id is None for r in got[None])
    assert all(got[i][0].n_shingles == len(s) for i, s in sets.items())
    assert minhash_dedup(docs.limit(0)).count() == 0
    kept = keep_representatives(docs, size=4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for c in comp.values()} | {None}


def test_minhash_family_of_edits(spark):
    """Copies with edits of different weight: many share bands without being linked."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = "edit" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingle_set(t, 5) for i, t in enumerate(texts)}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in minhash_dedup(docs).collect()} == groups(sets, linked)


def test_fast_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    one = rng.integers(0, 2**63, 1, dtype=np.uint64)
    s = fast_sketch(np.concatenate([a, b, one]), np.array([0, 400, 800, 801, 801]), 264)
    assert (s[:3] < np.iinfo(np.uint64).max).all() and (s[3] == np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 400)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(7, 7), (None, 3)]
    whole = [e for e in edges if e[0] is not None and e[0] != e[1]]
    comp = groups({x for e in whole for x in e}, whole)
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()} == comp
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed(rows, length, keep_first):
    """Per distinct row, by definition."""
    raw = sorted({(i is not None, i or 0, t) for i, t in rows if t}, key=lambda r: (r[0], r[1]))
    places = defaultdict(list)
    for n, (_, _, t) in enumerate(raw):
        b = t.encode()
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((n, p))
    out = {}
    for n, (known, i, t) in enumerate(raw):
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            where = places[b[p : p + length]]
            if where[0] != (n, p) if keep_first else len(where) > 1:
                cover[p : p + length] = True
        out[i if known else None] = bytes(np.frombuffer(b, np.uint8)[~cover])
    return out


@pytest.mark.parametrize("keep_first,blocks", [(False, 4_000), (True, 4_000), (False, 2), (True, 2)])
def test_repeats_by_definition(docs, rows, keep_first, blocks, monkeypatch):
    monkeypatch.setattr("listing_radar.llm.suffix_dedup.BLOCK_CONTEXTS", blocks)
    single = docs.where("doc_id is null or doc_id <> 40")
    want = removed([(i, t) for i, t, *_ in rows if i != 40], 200, keep_first)
    got = by_id(repeat_digests(single, keep_first=keep_first))
    for i, left in want.items():
        assert hashlib.sha256(left).hexdigest() in {r.kept_sha256 for r in got[i]}, i
    assert all((r.n_bytes, r.n_removed, r.n_spans) == (0, 0, 0) for i in (30, 31) for r in got[i])
    assert repeat_digests(docs.limit(0)).count() == 0


def test_repeated_row_and_whole_characters(spark):
    text = "é" * 150 + "y" + "z" * 10
    df = spark.createDataFrame([(1, text, 7, "b"), (1, text, 7, "b"), (2, "a" + text, 9, "b"), (3, None, None, "b")], "doc_id long, text string, n_chars int, body string")
    out = by_id(remove_repeats(df))
    assert out[1][0].text == out[1][1].text and out[3][0].text is None and out[2][0].text.startswith("a")
    assert out[2][0].n_chars == len(out[2][0].text) < 12 and out[2][0].body == "b"
    assert all(r.n_removed == r.n_bytes for r in by_id(repeat_digests(df))[1])


def test_longest_previous_factors_are_exact_from_length_on():
    rng = random.Random(3)
    data = "".join(rng.choice("ab") for _ in range(300)) * 2
    raw = np.frombuffer(data.encode(), dtype=np.uint8)
    starts = np.arange(len(raw) - 24)
    factor, _ = longest_previous_factors(raw, starts, 24)
    for p in starts:
        assert (factor[p] >= 24) == any(data[q : q + 24] == data[p : p + 24] for q in range(p))


@needs_vocabulary
def test_bpe_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    known, own = tokenizers.Tokenizer.from_file(Q.vocabulary()), Bpe(Q.vocabulary())
    rng = random.Random(6)
    pool = "aAbBeE zZ's'tΣσςİéÉe\u0301\xa0\u2003\x1c\x1f\t\n\x85.,!!--<|endoftext|>1234٣½ßẞ中文字한국\U0001f600ﬁ\u3000\u200b_"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += ["", "<|startoftext|><|endoftext|>", "a<|endoftext|>b <|endoftext|", "!" * 3000, "ab" * 3000, "aaaa" * 7 + "b", None]
    want = [known.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, bounds = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    own.ordered = False
    own.clear()
    ids, bounds = own.encode(texts[:200])
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want[:200]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = encode(df, Q.vocabulary())
    assert {r.doc_id: r.ids for r in found.collect()} == dict(enumerate(want))
    back = {r.doc_id: r.text for r in decode(found, Q.vocabulary()).collect()}
    assert back == {i: known.decode(x, skip_special_tokens=False) for i, x in enumerate(want)}


@needs_vocabulary
@pytest.mark.parametrize("packed", [lambda d: pack(d, Q.vocabulary(), width=64), lambda d: segments(token_output(d, Q.vocabulary(), width=64))])
def test_packing_loses_nothing(docs, rows, packed):
    own = Bpe(Q.vocabulary())
    got, seqs = defaultdict(list), defaultdict(list)
    for r in packed(docs).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        got[r.doc_id].append((r.start, ids.tolist()))
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    for i, text, *_ in rows:
        if i not in (None, 40):
            assert [x for _, part in sorted(got[i]) for x in part] == own.encode([text])[0].tolist() + [2], i
    assert packed(docs.limit(0)).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 65) for _ in range(500)]
    out = best_fit_decreasing(lengths, 64)
    assert sorted(p for row in out for p in row) == list(range(500)) and all(sum(lengths[p] for p in row) <= 64 for row in out)
    assert len(out) <= 1.03 * sum(lengths) / 64 + 2
    assert best_fit_decreasing([40, 30, 24, 20], 64) == [[0, 2], [1, 3]]


def test_chat_layouts_and_round_trip(spark):
    said = "<|im_end|><\\|im_start\\|>\\<|\nassistant"
    records = [(1, '{"prompt": "p", "response": "r"}'), (2, '{"instruction": "i", "input": "x", "output": null}'), (3, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}'),
               (4, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}'), (5, "[1]"), (6, None), (7, "{broken"), (8, '{"messages": [{"role": "r", "content": "a"}], "more": {"x": 1}}')]
    got = by_id(canonical_turns(spark.createDataFrame(records, "id long, record string"), "id", "record"), "id")
    turns = {i: [(r.role, r.text) for r in sorted(v, key=lambda r: r.turn or 0)] for i, v in got.items()}
    assert turns == {1: [("user", "p"), ("assistant", "r")], 2: [("user", "i"), ("user", "x")], 3: [("user", "a"), ("assistant", "")], 4: [("user", "h"), ("assistant", "g")],
                     5: [(None, None)], 6: [(None, None)], 7: [(None, None)], 8: [("r", "a")]}
    df = spark.createDataFrame([(1, 0, "us\ner\\n", said), (1, 1, "assistant", said), (1, 2, None, None), (1, 3, "assistant", ""), (None, 0, "assistant", "z")], "id long, turn long, role string, text string")
    read = {(r.id, r.turn): r for r in read_turns(format_turns(df)).collect()}
    assert [(read[1, k].role, read[1, k].text, read[1, k].learnt) for k in range(4)] == [("us\ner\\n", said, ""), ("assistant", said, said), ("", "", ""), ("assistant", "", "")]
    out = by_id(conversation_digests(format_turns(df), "conv_id"), "conv_id")
    assert out[1][0].loss_chars == len(said) and out[1][0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[None][0].n_turns == 1
    assert conversation_digests(format_turns(df.limit(0)), "conv_id").count() == 0


def test_chat_records_with_further_text_stay_whole_or_are_marked(spark):
    asked = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    said = [("user", "q"), ("assistant", "a")]
    cases = [
        ({"prompt": "q", "prompt_id": "x1", "messages": asked}, said),
        ({"prompt": "other", "prompt_id": "x1", "messages": asked}, [(None, None)]),
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("system", "s"), *said]),
        ({"system": "s", "messages": asked, "source": "web"}, [("system", "s"), *said]),
        ({"instruction": "q2", "output": "a2", "history": [["q", "a"], ["q1", None]]}, [*said, ("user", "q1"), ("user", "q2"), ("assistant", "a2")]),
        ({"system": "s", "prompt": "q2", "response": "a2", "history": asked}, [("system", "s"), *said, ("user", "q2"), ("assistant", "a2")]),
        ({"instruction": "q", "output": "a", "history": ["h"]}, [(None, None)]),
        ({"messages": [*asked, {"role": "assistant", "tool_calls": [{"name": "f"}]}]}, [(None, None)]),
        ({"messages": [None, [], *asked], "score": 3}, said),
        ({"messages": ["loose", *asked]}, [(None, None)]),
        ({"messages[].role": "user"}, [(None, None)]),
        ({"prompt": "q", "chosen": "a", "rejected": "b"}, [(None, None)]),
    ]
    df = spark.createDataFrame([(i, json.dumps(record)) for i, (record, _) in enumerate(cases)], "id long, record string")
    got = by_id(canonical_turns(df, "id", "record"), "id")
    assert {i: [(r.role, r.text) for r in sorted(v, key=lambda r: r.turn or 0)] for i, v in got.items()} == {i: turns for i, (_, turns) in enumerate(cases)}
    assert {i for i, v in got.items() if v[0].layout is None} == {i for i, (_, turns) in enumerate(cases) if turns == [(None, None)]}


@pytest.mark.parametrize("block", [1024, 5])
def test_embeddings_by_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr("listing_radar.llm.embedding_dedup.BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.18 * rng.normal(size=8)], int(i % 2)) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(200, rows[0][1], None), (201, [0.0] * 8, 0), (202, None, 0), (203, [1.0, None], 0), (204, [float("nan")] * 8, 0), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0), (207, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(*rows[3], "x")], "vec_id long, embedding array<float>, label int, n_links string")
    fine = {i: (np.array(v, dtype=np.float32).astype(float), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    linked = [(a, b) for a, (v, y) in fine.items() for b, (w, z) in fine.items() if a < b and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
    comp = groups({r[0] for r in rows if r[0] is not None}, linked)
    got = by_id(embedding_dedup(df), "vec_id")
    assert {i: got[i][0].component_id for i in comp} == comp and len(linked) > 20
    assert {i: got[i][0].n_links for i in comp} == {i: sum(i in e for e in linked) for i in comp}
    assert got[None][0].kept and len(got[3]) == 2 and embedding_dedup(df.limit(0)).count() == 0
