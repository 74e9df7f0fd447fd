"""Token ids by the tokenizers library: forgetting, colliding hashes, digests, and matrices read back on their own."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from listing_radar.llm import bpe as B
from listing_radar.llm import queries as Q
from listing_radar.llm.bpe import Bpe, encode_digests
from listing_radar.llm.packing import pack
from listing_radar.llm.token_output import token_output

tokenizers = pytest.importorskip("tokenizers")
POOL = "aAbBeE zZ's'tΣσςİéÉé\xa0 \x1c\x1f\t\n\x85.,!!--<|endoftext|>1234٣½ßẞ中文字한국\U0001f600ﬁ　​_"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(Q.vocabulary())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(16)
    words = ["".join(rng.choice("aéb1'.") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    out = ["".join(rng.choice(POOL) for _ in range(rng.randrange(40))) for _ in range(150)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)]
    return out + ["", None, " \n", "<|endoftext|>", "<|endof", "text|> x<|startoftext|>y", "é" * 900] + out[:10]


def lists(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_forgetting_changes_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(B, "GENERATION_BYTES", 270_000)
    own, dropped, found = Bpe(Q.vocabulary()), 0, []
    for lo in range(0, len(texts), 7):
        before = own.chunks[0]
        found += lists(*own.encode(texts[lo : lo + 7]))
        dropped += own.chunks[0] is not before
    assert dropped > 2 and own.chunks[0].size + own.words[0].size < 2 * (270_000)
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kinds", [1, 3, 64])
def test_chunks_of_one_hash_are_told_apart(library, texts, kinds, monkeypatch):
    whole = B.flat.word_hashes
    monkeypatch.setattr(B.flat, "word_hashes", lambda *a, **k: whole(*a, **k) % np.uint64(kinds) + np.uint64(1))
    own = Bpe(Q.vocabulary())
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert lists(*own.encode(texts)) == want
    assert [x for t in texts for x in lists(*own.encode([t]))] == want


def test_digests_against_the_library(spark, library, texts):
    df = spark.createDataFrame([(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(df, Q.vocabulary()).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((str(i if i % 9 else None), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)
    assert encode_digests(df.limit(0), Q.vocabulary()).count() == 0


def test_documents_and_positions_from_the_matrix_alone(spark, library, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = defaultdict(dict)
    for r in token_output(df, Q.vocabulary(), width=32).collect():
        row = np.frombuffer(r.ids, "<u4")
        assert len(row) == 32 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 32 and not row[r.n_tokens :].any()
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_starts) == len(r.position_resets)
        positions = np.arange(r.n_tokens) - np.repeat(r.position_resets, np.diff(r.cu_seqlens))
        at = np.flatnonzero(positions == 0).tolist()
        assert at == r.position_resets
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, at, [*at[1:], r.n_tokens], strict=True):
            parts[doc][start] = row[a:b].tolist()
    assert {d: [x for _, ids in sorted(p.items()) for x in ids] for d, p in parts.items()} == {
        i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [1, 63, 64, 65, 96, 128])
def test_only_the_last_sequence_may_be_short(spark, n):
    df = spark.createDataFrame([(1, "a " * (n - 1))], "doc_id long, text string")  # n ids with the end
    rows = sorted((r.sequence_id, r.length, r.padded_length) for r in pack(df, Q.vocabulary(), width=64).collect())
    assert sum(r[1] for r in rows) == n and all(r[1:] == (64, 64) for r in rows[:-1])
    left = rows[-1][1]
    assert rows[-1][2] == (left if left & (left - 1) == 0 else 64)
