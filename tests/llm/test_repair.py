"""Conversation repair against a search over whole edit sequences, with nulls, ties, repeated rows and long runs."""

import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_radar.llm import conversation_repair as C
from listing_radar.llm import queries as Q
from listing_radar.llm.conversation_repair import plan, plan_repairs, repair_digests, repaired_turns


def cheapest(rows):
    """(cost, audit, output) of rows (role, text, fault) by trying all edits front to back."""

    @functools.cache
    def best(i, place, room):
        found = []
        if i == len(rows) and place in "0a":
            found.append((0, "", ()))
        if room:
            role = "assistant" if place == "u" else "user"
            cost, audit, out = best(i, role[0], room - 1)
            found.append((cost + 2, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, out = best(i + 1, place, 2)
            found.append((cost + 3, "D" + audit, out))
            if fault < 2:
                fits = {"0": "su", "s": "u", "u": "a", "a": "u"}[place]
                if role[:1] and role[0] in fits:
                    cost, audit, out = best(i + 1, role[0], 2)
                    found.append((cost + fault, "K" + audit, ((role, text), *out)))
                to = "assistant" if place == "u" else "user"
                cost, audit, out = best(i + 1, to[0], 2)
                found.append((cost + 2 + fault, "R" + audit, ((to, text), *out)))
        return min(found) if found else (10**9, "", ())

    return best(0, "0", 2)


def expected(rows):
    """The result for rows (turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.md5(y[2].encode()).digest()))
    seen, told, counts = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 2 if not body else 3 if (role, text) in seen else 1 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        told.append((role, text, fault))
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(tuple(told))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts[2], counts[3], counts[1], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


def test_plan_against_search():
    rng = random.Random(3)
    for _ in range(300):
        symbols = [rng.choice([0, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8]) for _ in range(rng.randrange(9)) for _ in range(rng.choice([1, 1, 2, 5]))]
        rows = tuple((["system", "user", "assistant", "tool"][(x - 1) // 2] if x else "user", "t", (x - 1) % 2 if x else 2) for x in symbols)
        assert plan(np.array(symbols, dtype=np.int8)) == cheapest(rows)[:2], symbols


def test_long_runs_and_many_runs(monkeypatch):
    symbols = np.array([3] * 3000 + [5] * 2001 + [0] * 700 + [3, 5] * 900, dtype=np.int8)
    whole = plan(symbols)
    monkeypatch.setattr(C, "RUNS", 7)
    monkeypatch.setattr(C, "ROWS", 3)
    assert plan(symbols) == whole
    audit = whole[1]
    rows = len(audit) - audit.count("I")
    assert rows == len(symbols) and whole[0] >= 3 * 700
    price = {"K": 0, "D": 3, "R": 2, "I": 2}
    assert sum(price[x] for x in audit) == whole[0]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    texts = ["Yes.", "no", "well?", " ", "", "a b! \n", "é.", "Yes.", None, " "]
    out = [(conv, None if rng.random() < 0.1 else rng.randrange(6), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"]), rng.choice(texts))
           for conv in [*range(60), None] for _ in range(rng.randrange(8))]
    return out + [(100, t, "user" if t % 2 == 0 else "assistant", f"row {t}.") for t in range(2500)] + [(101, 1, "user", "x.")] * 50


def test_repair_against_search(spark, talks):
    df = spark.createDataFrame([(*r, "x", 1) for r in talks], "conv_id long, turn long, role string, text string, id string, place int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair_digests(df).collect()}
    by_conv = {}
    for conv, *row in talks:
        by_conv.setdefault(conv, []).append(tuple(row))
    assert set(got) == set(by_conv)
    for conv, rows in by_conv.items():
        if conv not in (100, 101):
            assert got[conv] == expected(rows), conv
    assert got[100][:7] == (0, 0, 0, 0, 0, 0, "K" * 2500)
    assert got[101][1:7] == (0, 49, 0, 49, 2 + 3 * 49, "K" + "D" * 49 + "I")
    plans = plan_repairs(df)
    turns = repaired_turns(df, plans).where("conv_id = 100").orderBy("place").collect()
    assert [t.text for t in turns] == [f"row {t}." for t in range(2500)]


def test_dropped_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", True), (2, 3, "user", "a.", False), (2, 7, "assistant", "b.", True), (2, 9, "assistant", "c.", None)],
                               "conv_id int, turn int, role string, text string, dropped boolean")
    got = {r.conv_id: tuple(r)[1:] for r in repair_digests(df, dropped=F.col("dropped")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[2] == (5, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:c.").hexdigest())
    assert repair_digests(df.where("conv_id > 5")).count() == 0


def test_query_against_search(spark):
    from zlib import crc32

    folder = "/root/testdata/sf0.001"
    by_conv = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        rows, case = by_conv.setdefault(r.conv_id, []), crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text, role = r.text, "user" if case == 4 else r.role
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        rows += [(r.turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in Q.op12_conversation_repair(spark, folder).collect()}
    assert got == {conv: expected(rows) for conv, rows in by_conv.items()}
