"""Chat formatting: a fingerprint of each record's field paths selects the mapping that turns it into canonical turns.

Records are JSON objects. The fingerprint is a hash of the sorted paths of all fields that hold a value (``messages[].role``);
each declared layout lists the paths it must and may have, and its fingerprints are worked out beforehand, so finding the layout
of a record is one look-up. A record with further fields takes the layout that leaves the least text out, and is marked instead
of shortened if any is left out. Turns are then written between ``<|im_start|>`` and ``<|im_end|>``; the same strings inside texts are
escaped reversibly, and the text of each assistant turn is under the loss mask.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from listing_radar.llm.storage import bound_batches

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``turns`` lists (role, field) pairs, with fields of one record; or ``items`` names a list whose objects hold ``role_field``
    and ``text_field``, with roles renamed by ``roles``. ``order`` names a field with the place of the record's first turn.
    ``system`` names a field that comes first, ``history`` a list of earlier turns that comes next: lists of user and assistant
    texts in turn, or objects with role and content.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    items: str | None = None
    role_field: str = "role"
    text_field: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    order: str | None = None
    system: str | None = None
    history: str | None = None

    def covers(self, path: str) -> bool:
        """Whether the turns hold what is at ``path``; objects and lists in the place of a text are written as JSON."""
        whole = [field for _, field in self.turns]
        if not self.turns:
            prefix = f"{self.items}[]." if self.items else ""
            whole += [prefix + self.role_field, prefix + self.text_field]
        if self.system:
            whole.append(self.system)
        if self.history:
            whole += [f"{self.history}[][]", f"{self.history}[].role", f"{self.history}[].content"]
        return any(path == w or path.startswith((w + ".", w + "[")) for w in whole)


_EARLIER = ("system", "history[][]", "history[].role", "history[].content")
LAYOUTS = (
    Layout("prompt", ("prompt",), ("response", "completion", *_EARLIER), (("user", "prompt"), (LEARNT_ROLE, "response"), (LEARNT_ROLE, "completion")),
           system="system", history="history"),
    Layout("instruction", ("instruction",), ("input", "output", *_EARLIER), (("user", "instruction"), ("user", "input"), (LEARNT_ROLE, "output")),
           system="system", history="history"),
    Layout("messages", ("messages[].role",), ("messages[].content", *_EARLIER), items="messages", system="system", history="history"),
    Layout("conversations", ("conversations[].from",), ("conversations[].value", *_EARLIER), items="conversations", role_field="from", text_field="value",
           roles=(("human", "user"), ("gpt", LEARNT_ROLE), ("system", "system")), system="system", history="history"),
    Layout("turn", ("turn",), ("role", "text"), items=None, role_field="role", text_field="text", order="turn"),
)


#: Last names of fields that tell about a record and are no part of its conversation; names that end in ``_id`` are, too.
METADATA = frozenset(("id", "uuid", "source", "lang", "language", "model", "dataset", "split", "timestamp", "created_at", "url", "license"))


def _inside(prefix: str, key: str) -> str:
    """A key with a mark of paths in it never looks like a path."""
    key = re.sub(r"([.\[\\])", r"\\\1", key) if "." in key or "[" in key else key
    return f"{prefix}.{key}" if prefix else key


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all fields that hold something other than null or an empty list or object."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, _inside(prefix, k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, prefix + "[]") for v in value))
    return set() if value is None else {prefix}


def field_texts(value, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of all strings that are not blank and no metadata."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k not in METADATA and not k.endswith("_id"):
                yield from field_texts(v, _inside(prefix, k))
    elif isinstance(value, list):
        for v in value:
            yield from field_texts(v, prefix + "[]")
    elif isinstance(value, str) and value.strip():
        yield prefix, value


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def known_fingerprints(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    """Every admissible set of paths of every layout; the first declared layout wins."""
    found: dict[str, Layout] = {}
    for layout in layouts:
        for k in range(len(layout.optional) + 1):
            for some in itertools.combinations(layout.optional, k):
                found.setdefault(fingerprint(layout.required + some), layout)
    return found


def turns_of(record: dict, layout: Layout) -> Iterator[tuple[int | None, str, str]]:
    """(place, role, text) of a record; null text is empty, a missing place is None."""
    text = lambda value: "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if layout.system and record.get(layout.system) is not None:
        yield None, "system", text(record[layout.system])
    for item in (record.get(layout.history) or []) if layout.history else []:
        if isinstance(item, dict):
            yield None, text(item.get("role")), text(item.get("content"))
        elif isinstance(item, list):
            for k, said in enumerate(item):
                if said is not None:
                    yield None, ("user", LEARNT_ROLE)[k % 2], text(said)
    if layout.turns:
        for role, field in layout.turns:
            if record.get(field) is not None:
                yield None, role, text(record[field])
        return
    names = dict(layout.roles)
    for item in record[layout.items] if layout.items else [record]:
        if isinstance(item, dict):
            role = text(item.get(layout.role_field))
            yield record.get(layout.order) if layout.order else None, names.get(role, role), text(item.get(layout.text_field))


def whole_turns(record: dict, paths: set[str], layouts: tuple[Layout, ...]) -> tuple[Layout, list] | None:
    """The layout that leaves no text out, the first declared of several, and its turns; None if there is none.

    A text beside a layout's own fields is not left out if it is also the text of a turn.
    """
    texts = list(field_texts(record))
    for layout in layouts:
        # single values in the place of turns, or no list of them
        lists = [name for name in (layout.items, layout.history) if name]
        if not set(layout.required) <= paths or any(f"{name}[]" in paths or not isinstance(record.get(name) or [], list) for name in lists):
            continue
        turns = list(turns_of(record, layout))
        said = {text for _, _, text in turns}
        if all(layout.covers(path) or value in said for path, value in texts):
            return layout, turns
    return None


def whole_text(text: str) -> str:
    """``text`` with half surrogate pairs replaced, so that it can be written."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def turn_number(place) -> int | None:
    """A turn's place as a 64-bit number, also where it stands as a text or with a fraction of 0; anything else is a ValueError."""
    if place is None:
        return None
    if isinstance(place, bool) or not isinstance(place, (int, float, str)) or isinstance(place, str) and len(place) > 40:
        raise ValueError("a turn's place is no number")
    number = int(place)  # a text that is no number and an infinite one are errors
    if isinstance(place, float) and number != place or not -(2**63) <= number < 2**63:
        raise ValueError("a turn's place is no 64-bit number")
    return number


def _record_rows(raw: str | None, known: dict[str, Layout], layouts: tuple[Layout, ...]) -> list[tuple]:
    """(turn, role, text, fingerprint, layout) of one record, or its one row without a layout."""
    mark = fingerprint(())
    try:
        record = json.loads(raw or "null")
        paths = field_paths(record) if isinstance(record, dict) else set()
        mark = fingerprint(paths)
        layout = known.get(mark) if paths else None
        # extra fields beside a layout's own do not hide it, unless they hold text that no turn has
        found = (layout, turns_of(record, layout)) if layout else whole_turns(record, paths, layouts)
        if found is not None:
            numbered = [(turn_number(place), whole_text(role), whole_text(text)) for place, role, text in found[1]]
            return [(k if place is None else place, role, text, mark, found[0].name) for k, (place, role, text) in enumerate(numbered)]
    except (ValueError, OverflowError, RecursionError):
        pass
    return [(None, None, None, mark, None)]


def _turn_rows(batches, layouts: tuple[Layout, ...]):
    known = known_fingerprints(layouts)
    types = [("id", None), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fingerprint", pa.string()), ("layout", pa.string())]
    for batch in batches:
        at, rows = [], []
        for i, raw in enumerate(batch.column(1).to_pylist()):
            found = _record_rows(raw, known, layouts)
            at.extend([i] * len(found))
            rows.extend(found)
        columns = [pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), types[1:], strict=True)] if rows else [pa.array([], t) for _, t in types[1:]]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=[n for n, _ in types])


def canonical_turns(df: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, turn, role, text, fingerprint, layout), one row per turn of every JSON record.

    A record that is null, no object, not readable or of no declared layout gives one row with a null layout, role and text; so
    does one with text that the turns of no layout would hold, apart from ``METADATA``, one whose turn's place is no 64-bit number,
    and one nested too deep to read. Its conversation is never cut short. Half surrogate pairs become U+FFFD.
    Records of one id may be several, as for a conversation whose turns are rows.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(record_col).cast("string").alias("record"))
    return rows.mapInArrow(functools.partial(_turn_rows, layouts=layouts),
                           f"id {dict(rows.dtypes)['id']}, turn long, role string, text string, fingerprint string, layout string")


def escape(text: Column) -> Column:
    """Put one more backslash into every ``<|`` or ``<\\|``; afterwards no ``<|`` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_turns(turns: DataFrame) -> DataFrame:
    """(id, turn, formatted, mask_start, mask_length) of rows (id, turn, role, text): one segment per turn.

    A conversation's output is its segments in the order of turn. The mask is given in code points within the segment; it is
    empty for roles other than the assistant's. Null texts and roles are empty; a line break in a role is written as ``\\n``.
    """
    role = F.regexp_replace(F.regexp_replace(F.coalesce("role", F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), escape(role), F.lit("\n"))
    return turns.select("id", "turn", F.concat(head, body, F.lit(END + "\n")).alias("formatted"), F.length(head).cast("long").alias("mask_start"),
                        F.when(F.col("role") == LEARNT_ROLE, F.length(body)).otherwise(0).cast("long").alias("mask_length"))


def read_turns(segments: DataFrame) -> DataFrame:
    """(id, turn, role, text, learnt, n_chars) read back from formatted segments; ``learnt`` is the unescaped text under the mask."""
    inner = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START) + len(END) + 1})")
    role = unescape(F.substring_index(inner, "\n", 1))
    role = F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")
    text = unescape(F.expr(f"substring(formatted, mask_start + 1, length(formatted) - mask_start - {len(END) + 1})"))
    learnt = F.when(F.col("mask_length") > 0, unescape(F.expr("substring(formatted, cast(mask_start + 1 as int), cast(mask_length as int))"))).otherwise("")
    return segments.select("id", "turn", role.alias("role"), text.alias("text"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("n_chars"))


def _digest_rows(batches):
    """Rows sorted by id and turn; a conversation is hashed as it streams by and is never held whole."""
    last, state, ids, rows = object(), None, None, []

    def close():
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([state[0]]), pa.array([state[1].hexdigest()]), pa.array([state[2]]), pa.array([state[3].hexdigest()]), pa.array([state[4]])],
            names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for i, (key, role, text, learnt, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
            if state is None or key != last:
                if state is not None:
                    rows.append(close())
                last, state, ids = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], batch.column(0).slice(i, 1)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += n
        if len(rows) >= 500:
            yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            rows = []
    if state is not None:
        yield pa.Table.from_batches([*rows, close()]).combine_chunks().to_batches()[0]


def conversation_digests(segments: DataFrame, id_col: str) -> DataFrame:
    """Per conversation, read back from the output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns of one place are in the order of role and text. A null id is a conversation of its own.
    """
    read = read_turns(segments)
    ordered = read.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text", "learnt", "n_chars")
    return ordered.mapInArrow(_digest_rows, f"id {dict(read.dtypes)['id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
