"""Secret scans against plain expressions over whole texts, and the trigram queries against texts built to match."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from listing_radar.llm import flat
from listing_radar.llm import queries as Q
from listing_radar.llm.secret_scan import RULES, Rule, Scanner, find_secrets, redact_secrets, trigram_query, trigrams_of

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}
PIECES = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", '"', "'", " ", "  ", ":", "=", "abc123", "x", "/+a", "AKIA", "AKIAAKIA", "Z9" * 9, "Q" * 15, "0f" * 12, "0a" * 11,
          "é", "ſecret=abcdefg", "toKen=abcdefg", "\U0001f600", "\n", "eyJ", ".", "ghp_", "abcdef0123456789", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abcdefghijkl"]


def base_spans(text):
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def all_spans(text):
    found = []
    for order, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or "", re.A | (re.I if rule.any_case else 0)):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, rule.kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    out += [None, "", "to", "token" * 3, "é" * 5000 + "token: abcdef", "a" * 300_000, "token = " + "x" * 100_000, "eyJ" * 50_000, "password" + " " * 50_000 + "x"]
    return out + out[:30]


def test_spans_against_plain_search(spark, texts, tmp_path):
    df = spark.createDataFrame([(i if i % 50 else None, t, "kind", i) for i, t in enumerate(texts)], "doc_id long, text string, id string, spans int").repartition(4)
    got = sorted((str(r.doc_id), [f"{s.kind}:{s.start}:{s.end}" for s in r.spans]) for r in find_secrets(df).collect())
    assert got == sorted((str(i if i % 50 else None), all_spans(t)) for i, t in enumerate(texts))
    path = str(tmp_path / "documents.parquet")
    df.select("doc_id", "text").write.parquet(path)
    rows = Q.op11_secret_scan(spark, str(tmp_path)).where("doc_id is not null").collect()
    assert len(rows) == sum(1 for i in range(len(texts)) if i % 50)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert r.spans == ",".join(all_spans(texts[r.doc_id]))
    assert find_secrets(df.limit(0)).count() == 0


def test_redaction_keeps_all_but_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in redact_secrets(df).collect():
        want = texts[r.doc_id]
        if want is not None:
            chars = list(want)
            for span in all_spans(want):
                _, a, b = span.split(":")
                chars[int(a) : int(b)] = "*" * (int(b) - int(a))
            want = "".join(chars)
        assert r.text == want


def test_queries_of_expressions():
    assert trigram_query("AKIA[A-Z0-9]+") == ("and", frozenset({"aki", "kia"}))
    assert trigram_query("[0-9a-f]{24,}") is True
    assert trigram_query("ab?c") is True
    assert trigram_query("abc|abd") == ("or", frozenset({"abc", "abd"}))
    assert trigram_query("x(?:abc)*y") is True
    assert trigram_query("(?:abc){2,}") == ("and", frozenset({"abc", "bca", "cab"}))
    assert trigram_query("ab[cd]e") == ("or", frozenset({("and", frozenset({"abc", "bce"})), ("and", frozenset({"abd", "bde"}))}))
    assert all(trigrams_of(trigram_query(r.pattern)) for r in RULES if r.kind != "hex")


def test_queries_lose_no_match():
    """Every text in which an expression matches is a candidate, over expressions made at random."""
    rng = random.Random(9)

    def expression(depth):
        kind = rng.randrange(7 if depth else 2)
        if kind < 2:
            return "".join(rng.choice("abAB") for _ in range(rng.randrange(1, 4)))
        if kind == 2:
            return "[" + "".join(rng.sample("abAB", 2)) + "]"
        if kind == 3:
            return f"(?:{expression(depth - 1)}|{expression(depth - 1)})"
        if kind == 4:
            return f"(?:{expression(depth - 1)}){rng.choice(['?', '*', '+', '{2}', '{2,3}', '{3,}'])}"
        return expression(depth - 1) + expression(depth - 1)

    matched = left_out = 0
    for _ in range(150):
        rule = Rule("x", expression(4))
        scan = Scanner((rule,))
        texts = ["".join(rng.choice("abAB") for _ in range(rng.randrange(14))) for _ in range(40)]
        data, offsets = flat.texts(pa.array(texts))
        flags = scan.candidates(scan.rules[0][2], scan.postings(data, offsets))
        for text, flag in zip(texts, flags, strict=True):
            hit = re.search(rule.pattern, text) is not None
            assert flag or not hit, (rule.pattern, text)
            matched, left_out = matched + hit, left_out + (not flag)
    assert matched > 300 and left_out > 300
