"""Secret scans: a trigram inverted index picks the texts in which a rule can match, and only those are searched.

Each rule's regular expression is turned into a Boolean query of trigrams that every match must contain, from the sets of strings
that its parts can stand for. A segment (the texts of one bounded batch) has a posting list for every trigram that some query
names, as a set of its texts; the lists are intersected and united as the query says, and the rule's expression verifies the texts
that are left. Trigrams fold A-Z to a-z, so one index serves rules of either case. A rule whose expression names no trigram scans
every text.

Texts are searched as UTF-8. All classes in the expressions hold ASCII characters only, so matches never cut a character, and their
bytes are told in code points afterwards.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from re import _constants as sre, _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from listing_radar.llm import flat
from listing_radar.llm.storage import bound_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.encode("ascii"), re.IGNORECASE if self.any_case else 0)


#: The order of kinds is the order of spans with one start. No expression can begin again inside a run that it has just read, which
#: keeps the search linear on long runs. A run of hex digits is read whole, so runs that are too short may fail in the expression.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("forge_token", r"(?<![A-Za-z0-9_])gh[opsru]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"(?<![A-Za-z0-9-])xox[abeoprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

#: Most strings that a part's exact, first or last set holds before it is told by its trigrams.
STRINGS = 32


# --- Boolean queries: True, ("and", parts), ("or", parts) or a trigram -------------------------------------------------


def both(*queries):
    parts = frozenset(p for q in queries if q is not True for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q]))
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def either(queries):
    parts = frozenset(queries)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_strings(strings) -> object:
    """What a text must contain if it contains one of the strings."""
    return either(both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings)


@dataclass(frozen=True)
class _Part:
    """What is known of the strings that a part of an expression matches: all of them, or how they begin and end; and a query."""

    exact: frozenset | None
    first: frozenset
    last: frozenset
    query: object = True


_ANYTHING = _Part(None, frozenset([""]), frozenset([""]))
_NOTHING = _Part(frozenset([""]), frozenset([""]), frozenset([""]))


def _shortened(strings, keep_front: bool) -> frozenset:
    """At most two characters at the border: more is said by the query already."""
    cut = frozenset(s[:2] if keep_front else s[len(s) - min(2, len(s)) :] for s in strings)
    return cut if len(cut) <= STRINGS else frozenset([""])


def _open(part: _Part) -> _Part:
    """The part without its exact strings, which its query now tells."""
    if part.exact is None:
        return part
    return _Part(None, _shortened(part.exact, True), _shortened(part.exact, False), both(part.query, _of_strings(part.exact)))


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        strings = frozenset(x + y for x in a.exact for y in b.exact)
        return _Part(strings, strings, strings, both(a.query, b.query))
    begins = a.exact if a.exact is not None and len(a.exact) * len(b.first) <= STRINGS else None
    ends = b.exact if b.exact is not None and len(b.exact) * len(a.last) <= STRINGS else None
    a_last, b_first = (a.exact or a.last), (b.exact or b.first)
    across = _of_strings(x + y for x in a_last for y in b_first) if len(a_last) * len(b_first) <= STRINGS**2 else True
    a_open, b_open = _open(a), _open(b)
    first = _shortened([x + y for x in begins for y in b.first], True) if begins else a_open.first
    last = _shortened([x + y for x in a.last for y in ends], False) if ends else b_open.last
    return _Part(None, first, last, both(a_open.query, b_open.query, across))


def _or(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= STRINGS:
        strings = frozenset().union(*(p.exact for p in parts))
        return _Part(strings, strings, strings)
    parts = [_open(p) for p in parts]
    return _Part(None, _shortened(frozenset().union(*(p.first for p in parts)), True), _shortened(frozenset().union(*(p.last for p in parts)), False), either(p.query for p in parts))


def _one(item) -> _Part:
    """What one item of a parsed expression matches, with A-Z folded."""
    kind, value = item
    if kind is sre.LITERAL:
        strings = frozenset([chr(value).lower()])
        return _Part(strings, strings, strings)
    if kind is sre.IN:
        letters: set[str] = set()
        for what, given in value:
            if what is sre.LITERAL:
                letters.add(chr(given).lower())
            elif what is sre.RANGE and given[1] - given[0] < 128:
                letters |= {chr(c).lower() for c in range(given[0], given[1] + 1)}
            else:
                return _ANYTHING
        strings = frozenset(letters)
        return _Part(strings, strings, strings) if len(strings) <= STRINGS else _ANYTHING
    if kind is sre.SUBPATTERN:
        return _sequence(value[-1])
    if kind is sre.BRANCH:
        return _or([_sequence(p) for p in value[1]])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        part = _sequence(inner)
        if most == 1:
            return part if least else _or([part, _NOTHING])
        if not least:
            return _ANYTHING
        part = functools.reduce(_then, [part] * min(least, 3))
        return part if least == most <= 3 else _then(_open(part), _ANYTHING) if most != least else _open(part)
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return _NOTHING
    return _ANYTHING


def _sequence(items) -> _Part:
    return functools.reduce(_then, [_one(i) for i in items], _NOTHING)


def trigram_query(pattern: str) -> object:
    """The Boolean query of trigrams (folded) that every text with a match of ``pattern`` satisfies; True if it names none."""
    return _open(_sequence(parser.parse(pattern))).query


def trigrams_of(query) -> set[str]:
    """All trigrams that a query names."""
    if query is True:
        return set()
    return set().union(*(trigrams_of(p) for p in query[1])) if isinstance(query, tuple) else {query}


# --- one segment ------------------------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Scanner:
    """Rules with their queries, and the numbers of the trigrams that the queries name."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(rule, rule.compiled(), trigram_query(rule.pattern)) for rule in rules]
        named = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.number = {t: k for k, t in enumerate(named)}
        keys = np.array([int.from_bytes(t.encode("latin-1"), "big") for t in named], dtype=np.int64)
        self.slot = np.full(1 << 24, -1, dtype=np.int16)
        self.slot[keys] = np.arange(len(named))

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each named trigram the texts that hold it, as a row of flags."""
        lists = np.zeros((len(self.number), len(offsets) - 1), dtype=bool)
        for lo in range(0, max(len(data) - 2, 0), flat.SLICE_BYTES):
            part = _FOLD[data[lo : lo + flat.SLICE_BYTES + 2]].astype(np.int32)
            slot = self.slot[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(slot >= 0)
            text = np.searchsorted(offsets, lo + at, side="right") - 1
            inside = lo + at + 3 <= offsets[text + 1]
            lists[slot[at[inside]], text[inside]] = True
        return lists

    def candidates(self, query, lists: np.ndarray) -> np.ndarray:
        """The texts of the segment that satisfy a query, as flags."""
        if query is True:
            return np.ones(lists.shape[1], dtype=bool)
        if isinstance(query, str):
            return lists[self.number[query]]
        return functools.reduce(np.logical_and if query[0] == "and" else np.logical_or, [self.candidates(p, lists) for p in query[1]])

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, first byte, rule, end byte) of all matches, in that order."""
        lists, found = self.postings(data, offsets), []
        raw = data.tobytes()
        for number, (rule, pattern, query) in enumerate(self.rules):
            for text in np.flatnonzero(self.candidates(query, lists) & (np.diff(offsets) > 0)).tolist():
                lo, hi = int(offsets[text]), int(offsets[text + 1])
                for match in pattern.finditer(raw[lo:hi]):
                    if match.end(rule.group) - match.start(rule.group) >= rule.least:
                        found.append((text, match.start(), number, match.end()))
        return sorted(found)


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _span_rows(batches, rules: tuple[Rule, ...]):
    scan = scanner(rules)
    kinds = pa.array([r.kind for r in rules], pa.string())
    for batch in batches:
        data, offsets = flat.texts(batch.column(1))
        for a, b in flat.slices(offsets, 4 * flat.SLICE_BYTES):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            spans = np.array(scan.spans(part, own), dtype=np.int64).reshape(-1, 4)
            text = spans[:, 0]
            points = np.zeros((len(spans), 2), dtype=np.int64)
            for t in np.unique(text):
                of = np.flatnonzero(text == t)
                before = np.concatenate([[0], np.cumsum((part[own[t] : own[t + 1]] & 0xC0) != 0x80)])
                points[of] = before[spans[of][:, [1, 3]]]
            bounds = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays([kinds.take(pa.array(spans[:, 2])), pa.array(points[:, 0]), pa.array(points[:, 1])], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds), structs)], names=["id", "spans"])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row, in code points, the end exclusive, by start, then in the order of rules.

    Matches of one rule are the leftmost ones that do not overlap; a match whose group is too short is dropped afterwards. Null and
    empty texts have no spans. Null and repeated ids are rows like any other, other columns are not looked at, and an empty table
    gives none. A text is searched whole, in one task.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    schema = f"id {dict(rows.dtypes)['id']}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInArrow(functools.partial(_span_rows, rules=rules), schema).withColumnRenamed("id", id_col)


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redacted_rows(batches, rules: tuple[Rule, ...]):
    scan = scanner(rules)
    for batch in batches:
        data, offsets = flat.texts(batch.column(1))
        for a, b in flat.slices(offsets, 4 * flat.SLICE_BYTES):
            part, own = data[offsets[a] : offsets[b]].copy(), offsets[a : b + 1] - offsets[a]
            for text, start, _, end in scan.spans(part, own):
                part[own[text] + start : own[text] + end] = ord("*")
            body = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(own.astype(np.int64)), pa.py_buffer(part)]).cast(pa.string())
            body = pc.if_else(batch.column(1).slice(a, b - a).is_null(), pa.scalar(None, pa.string()), body)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), body], names=["id", "text"])


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, text) of every row, each character of a span replaced by ``*``; lengths stay, null texts stay null. Else as ``find_secrets``."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(functools.partial(_redacted_rows, rules=rules), f"id {dict(rows.dtypes)['id']}, text string").withColumnRenamed("id", id_col)
