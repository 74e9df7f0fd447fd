"""Conversation structure repair: a run-length dynamic program over role and fault symbols.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. Each row is kept, given the other role, or deleted, and
empty turns are inserted, at least cost. A row's symbol is its role's class and its fault; equal neighbouring symbols are one run.
The step of a symbol is a 4 x 4 matrix over the places of the pattern (start, after s, after u, after a) whose product takes
minima of sums. A run advances the costs still to come through the binary powers of its matrix, which are made once per worker;
then the choices are unrolled from the front, in blocks of bounded size, which gives the audit.

The plan needs symbols only: one byte per row of a conversation, however long it is. The turns are written in a second pass, in
which the texts stream past the plan of their conversation and are never gathered.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from listing_radar.llm.storage import bound_batches, stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: Places in the pattern; a conversation may end where nothing is open.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEVER = 1 << 60
#: Classes of roles, by their initial; any other role, or none, cannot be kept.
CLASSES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
#: Where a kept row leads from each place, None where its role does not fit.
KEPT = {0: (SYSTEM, None, None, None), 1: (USER, USER, None, USER), 2: (None, None, ASSISTANT, None), OTHER: (None,) * 4}
#: Where a turn of the role that fits leads, as inserted or after a change of role.
FITTING = (USER, USER, ASSISTANT, USER)
#: The symbol of rows that must go; other symbols are 1 + 2 * class + truncated.
MUST_GO = 0
#: Runs between two kept cost vectors, and rows of a run that are unrolled at a time.
RUNS, ROWS = 4096, 512


def _options(symbol: int, place: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next place) of a row of ``symbol`` met at ``place``, in the order of letters."""
    out = [("D", DELETE, place)]
    if symbol != MUST_GO:
        role, more = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        if KEPT[role][place] is not None:
            out.append(("K", KEEP + more, KEPT[role][place]))
        out.append(("R", REROLE + more, FITTING[place]))
    return out


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices, or of a matrix and a vector, with minima of sums."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER) if b.ndim == 2 else np.minimum((a + b[None, :]).min(axis=1), NEVER)


@functools.cache
def _inserting() -> np.ndarray:
    """Least cost of getting from place to place by insertions alone; three reach every place that can be reached."""
    once = np.full((4, 4), NEVER, dtype=np.int64)
    np.fill_diagonal(once, 0)
    for place, to in enumerate(FITTING):
        once[place, to] = min(once[place, to], INSERT)
    return min_plus(min_plus(once, once), once)


@functools.cache
def _power(symbol: int, k: int) -> np.ndarray:
    """The matrix of 2^k rows of one symbol, insertions before each row included."""
    if k:
        return min_plus(_power(symbol, k - 1), _power(symbol, k - 1))
    step = np.full((4, 4), NEVER, dtype=np.int64)
    for place in range(4):
        for _, cost, to in _options(symbol, place):
            step[place, to] = min(step[place, to], cost)
    return min_plus(_inserting(), step)


@functools.lru_cache(maxsize=1 << 16)
def advance(symbol: int, n: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs to come before a run of ``n`` rows from those behind it, reduced by their least, and that least."""
    now, k = np.array(after, dtype=np.int64), 0
    while n >> k:
        if n >> k & 1:
            now = min_plus(_power(symbol, k), now)
        k += 1
    low = int(now.min())
    return tuple(min(int(x) - low, NEVER) if x < NEVER else NEVER for x in now), low


@functools.cache
def _at_end() -> tuple[int, ...]:
    accept = np.array([0 if place in ENDS else NEVER for place in range(4)], dtype=np.int64)
    return tuple(int(x) for x in min_plus(_inserting(), accept))


@functools.lru_cache(maxsize=1 << 16)
def _unroll(symbol: int, n: int, place: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The letters of ``n`` rows of one symbol met at ``place``, least first among the cheapest, and the place behind them."""
    vectors = [np.array(after, dtype=np.int64)]
    for _ in range(n):
        vectors.append(min_plus(_power(symbol, 0), vectors[-1]))
    letters, left = [], n
    while left:
        now, then = vectors[left], vectors[left - 1]
        choices = [(letter, to, left - 1) for letter, cost, to in _options(symbol, place) if cost + then[to] == now[place]]
        if INSERT + now[FITTING[place]] == now[place]:
            choices.append(("I", FITTING[place], left))
        letter, place, left = min(choices)
        letters.append(letter)
    return "".join(letters), place


def plan(symbols: np.ndarray) -> tuple[int, str]:
    """Least cost of a conversation given by its rows' symbols, and the letters of the cheapest edits, the least by ASCII."""
    starts = np.flatnonzero(np.diff(symbols, prepend=-1)) if len(symbols) else np.zeros(0, np.int64)
    kinds, lengths = symbols[starts], np.diff(np.append(starts, len(symbols)))
    kept, cost, now = {}, 0, _at_end()
    for run in range(len(starts) - 1, -1, -1):
        if (run + 1) % RUNS == 0 or run == len(starts) - 1:
            kept[run] = now
        now, low = advance(int(kinds[run]), int(lengths[run]), now)
        cost += low
    cost += now[START]
    parts, place = [], START
    for first in range(0, len(starts), RUNS):
        upto = min(first + RUNS, len(starts))
        behind = [kept[upto - 1]]
        for run in range(upto - 1, first, -1):
            behind.append(advance(int(kinds[run]), int(lengths[run]), behind[-1])[0])
        for run in range(first, upto):
            symbol, left, after = int(kinds[run]), int(lengths[run]), behind[upto - 1 - run]
            while left:
                n = min(left, ROWS)
                left -= n
                letters, place = _unroll(symbol, n, place, advance(symbol, left, after)[0] if left else after)
                parts.append(letters)
    while place not in ENDS:
        parts.append("I")
        place = FITTING[place]
    return int(cost), "".join(parts)


@dataclass
class _Conversation:
    """What a streaming pass keeps of the conversation that it is in."""

    key: pa.Array
    symbols: list[np.ndarray] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    last_role: int | None = None

    def add(self, turn: pa.Array, role: np.ndarray, fault: np.ndarray) -> None:
        """Rows in order: their turns, classes of roles and faults (0 none, 1 truncated, 2 blank, 3 duplicate)."""
        for name, k in (("truncated", 1), ("blank", 2), ("duplicate", 3)):
            setattr(self, name, getattr(self, name) + int((fault == k).sum()))
        self.symbols.append(np.where(fault >= 2, MUST_GO, 1 + 2 * role + (fault == 1)).astype(np.int8))
        roles = role if self.last_role is None else np.append(self.last_role, role)
        pairs = 4 * roles[:-1] + roles[1:]
        self.illegal += int((~np.isin(pairs, [4 * 0 + 1, 4 * 1 + 2, 4 * 2 + 1])).sum())
        self.last_role = int(role[-1])
        known = turn.drop_null()
        if len(known):
            values = np.asarray(known)
            self.first_turn = int(values[0]) if self.first_turn is None else self.first_turn
            self.turns += int((np.diff(values) != 0).sum()) + (self.last_turn != int(values[0]))
            self.last_turn = int(values[-1])

    def row(self) -> list:
        symbols = np.concatenate(self.symbols) if self.symbols else np.zeros(0, np.int8)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return [min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal, *plan(symbols)]


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = ["id", *(part.split()[0] for part in PLAN.split(", "))]


def _plan_batch(done: list[_Conversation]) -> pa.RecordBatch:
    columns = list(zip(*(c.row() for c in done), strict=True))
    values = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.large_string()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c.key for c in done]), *values], names=_NAMES)


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers of a column's values, equal for equal values; null is a value."""
    return np.asarray(column.dictionary_encode(null_encoding="encode").indices)


def _plan_rows(batches):
    """Rows (id, turn, role, print, class, fault, later, dropped) sorted by id, turn, role and print to one plan per id."""
    now, last, done = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = _codes(batch.column(0))
        fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
        copy = ~fresh
        for k in (1, 2, 3):
            code = _codes(batch.column(k))
            copy[1:] &= code[1:] == code[:-1]
        head = [batch.column(k)[0].as_py() for k in range(4)]
        if now is not None and last[0] == head[0]:
            fresh[0], copy[0] = False, last == head
        role, fault = np.asarray(batch.column(4)), np.asarray(batch.column(5)).copy()
        later = np.asarray(batch.column(6).cast(pa.int8())) > 0
        stays = np.asarray(batch.column(7).cast(pa.int8())) == 0
        fault[(fault != 2) & (later | copy)] = 3
        bounds = np.unique(np.concatenate([[0], np.flatnonzero(fresh), [len(ids)]]))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if fresh[lo]:
                if now is not None:
                    done.append(now)
                now = _Conversation(batch.column(0).slice(lo, 1))
            at = lo + np.flatnonzero(stays[lo:hi])
            if len(at):
                now.add(batch.column(1).take(pa.array(at)), role[at], fault[at])
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(4)]
        if len(done) >= 2_000:
            yield _plan_batch(done)
            done = []
    if now is not None:
        yield _plan_batch([*done, now])


def _described(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, dropped: Column) -> DataFrame:
    """Rows (id, turn, role, text, print, class, fault, dropped); null roles and texts are one blank."""
    rows = df.select(F.col(conv_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), dropped.alias("dropped"))
    shown, initial = F.rtrim("text", F.lit(SPACE)), F.substring("role", 1, 1)
    kind = F.coalesce(*[F.when(initial == letter, F.lit(k)) for letter, k in CLASSES.items()], F.lit(OTHER))
    fault = F.when(shown == "", 2).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    return rows.select("id", "turn", "role", "text", F.unhex(F.md5("text")).alias("print"), kind.cast("tinyint").alias("class"), fault.cast("tinyint").alias("fault"), "dropped")


def plan_repairs(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped: Column | None = None) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    A row's first fault counts: blank (nothing but white space), duplicate (role and text stood earlier in the conversation),
    truncated (its last other character is none of ``.!?``). Blank and duplicate rows must go. ``audit`` holds the cheapest edits'
    initials (Keep, Rerole, Delete, Insert), the least by ASCII. Rows for which ``dropped`` is true name their conversation
    only, so one with no other row has zeros and an empty audit. Null roles and texts are one blank; a role whose initial is not s, u or
    a can't be kept. Rows without a turn come first, rows of one turn are in the order of role and of the text's MD5, and equal rows
    follow each other. A null conversation id is a conversation. An empty table gives no row; other columns are not looked at.
    """
    bound_batches(df.sparkSession)
    dropped = F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))
    rows = _described(df, conv_col, turn_col, role_col, text_col, dropped).drop("text")
    met = rows.where("not dropped and fault <> 2").groupBy("id", "role", "print").agg(
        F.min(F.col("turn").isNotNull().cast("int")).alias("placed"), F.min("turn").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = met.select(F.col("id").alias("_id"), F.col("role").alias("_role"), F.col("print").alias("_print"), "placed", "first")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("role") == F.col("_role")) & (F.col("print") == F.col("_print"))
    later = F.when(F.col("placed") == 0, F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))  # rows without a turn come first
    told = rows.join(met, same, "left").withColumn("later", F.coalesce(later, F.lit(False)))
    # a dropped row comes after the others of its conversation, so that it cannot stand between two equal ones
    ordered = told.repartition("id").sortWithinPartitions("id", "dropped", "turn", "role", "print").select("id", "turn", "role", "print", "class", "fault", "later", "dropped")
    return ordered.mapInArrow(_plan_rows, f"id {dict(rows.dtypes)['id']}, {PLAN}").withColumnRenamed("id", conv_col)


def _turn_rows(batches):
    """Per conversation its plan, then its rows in order, to the rows of the repaired conversation."""
    key, audit, at, rows_left, place, number = None, "", 0, 0, START, 0
    out: list[list] = [[], [], [], []]

    def emit(role: str, text: str, to: int) -> None:
        nonlocal place, number
        for column, value in zip(out, (key, number, role, text), strict=True):
            column.append(value)
        place, number = to, number + 1

    def insertions() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            emit(*_FILLED[place])
            at += 1

    for batch in batches:
        for one, kind, role, text, edits in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if kind == 0:
                key, audit, at, rows_left, place, number = one, edits, 0, len(edits) - edits.count("I"), START, 0
                continue
            insertions()
            letter = audit[at]
            at, rows_left = at + 1, rows_left - 1
            if letter == "K":
                emit(role, text, KEPT[CLASSES[role[0]]][place])
            elif letter == "R":
                emit(_FILLED[place][0], text, FITTING[place])
            if not rows_left:
                insertions()
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (batch.column(0).type, pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "place", "role", "text"])
            out = [[], [], [], []]


#: The turn that fits at each place.
_FILLED = tuple(("assistant" if to == ASSISTANT else "user", "", to) for to in FITTING)


def repaired_turns(df: DataFrame, plans: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   dropped: Column | None = None) -> DataFrame:
    """Rows (id, place, role, text) of the repaired conversations, each conversation's rows in order within one partition.

    ``plans`` is the result of ``plan_repairs`` for the same rows. Kept rows stand as they are, a changed role is ``user`` or
    ``assistant``, inserted turns have an empty text. A conversation without rows gives none.
    """
    bound_batches(df.sparkSession)
    dropped = F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))
    rows = _described(df, conv_col, turn_col, role_col, text_col, dropped).where("not dropped")
    lines = rows.select("id", F.lit(1).alias("kind"), "turn", "role", "print", "text", F.lit(None).cast("string").alias("audit"))
    heads = plans.select(F.col(conv_col).alias("id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("print"), F.lit(None).cast("string").alias("text"), "audit")
    ordered = heads.unionByName(lines).repartition("id").sortWithinPartitions("id", "kind", "turn", "role", "print")
    return ordered.select("id", "kind", "role", "text", "audit").mapInArrow(_turn_rows, f"id {dict(rows.dtypes)['id']}, place long, role string, text string").withColumnRenamed("id", conv_col)


def _line_rows(batches):
    """Rows (id, place, role, text) in order to one digest of ``role:text`` lines per id."""
    key, state, keys, digests = None, None, [], []
    for batch in batches:
        for i, (place, role, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
            if place == 0:
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = batch.column(0).slice(i, 1), hashlib.sha256()
            state.update((("\n" if place else "") + f"{role}:{text}").encode())
        if len(keys) >= 2_000:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(digests)], names=["id", "sha256"])
            keys, digests = [], []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([*keys, key]), pa.array([*digests, state.hexdigest()])], names=["id", "sha256"])


def repair_digests(df: DataFrame, conv_col: str = "conv_id", dropped: Column | None = None, **columns) -> DataFrame:
    """The plans with repaired_sha256: the digest of the repaired conversation's ``role:text`` lines, of the empty string without any."""
    plans = stage(plan_repairs(df, conv_col, dropped=dropped, **columns), "repair-plans")
    turns = repaired_turns(df, plans, conv_col, dropped=dropped, **columns)
    digests = turns.mapInArrow(_line_rows, f"id {dict(plans.dtypes)[conv_col]}, sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    return plans.join(digests, plans[conv_col].eqNullSafe(digests["id"]), "left").select(*plans.columns, F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))
