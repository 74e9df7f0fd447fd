"""Elements of XML documents at any depth, read by a streaming parser (expat).

``from_xml`` needs the depth of every element in its schema, while entries, folders and places stand at any depth; it also takes a
document for good whose root is followed by further text. A document is parsed once: it gives its elements, or one row with its
fault. Namespaces are dropped; undeclared prefixes are no fault.
"""

from __future__ import annotations

import re
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType

#: Comments, instructions and CDATA, which no repair touches, or an & that starts no entity of XML.
_LOOSE = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", re.S)
#: A batch of elements is handed on at this many characters.
_FLUSH = 4 << 20


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _parser():
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    return parser


def _repaired(text: str | None) -> bytes:
    """Entities that XML does not know are text."""
    text = _LOOSE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], (text or "").lstrip("\ufeff \t\r\n"))
    return text.encode("utf-8", "replace")


class Fault(ValueError):
    """What keeps a document from being read."""


def elements(data: bytes, tag: str, above: tuple[str, ...] = (), roots: tuple[str, ...] = ()) -> list[tuple[int, str, list[str]]]:
    """(number in document order, XML without namespaces, ``nombre`` of the nearest ancestors called ``above``) of all elements.
    A document that is no whole XML document, or whose root is none of ``roots``, is a Fault."""
    ready, opened, outer, count, first = [], [], {name: [] for name in above}, 0, True
    parser = _parser()

    def add(piece):
        for _, parts, _ in opened:
            parts.append(piece)

    def start(name, attributes):
        nonlocal count, first
        name = _local(name)
        if first and roots and name not in roots:
            raise Fault(f"root element {name} instead of {' or '.join(roots)}")
        first = False
        if name == tag:
            opened.append((count, [], [outer[a][-1] if outer[a] else "" for a in above]))
            count += 1
        plain = {}
        for key in sorted(attributes, key=lambda k: ":" in k):  # an attribute's own name goes before a prefixed one
            if key != "xmlns" and not key.startswith("xmlns:"):
                plain.setdefault(_local(key), attributes[key])
        if opened:
            add(f"<{name}" + "".join(f" {k}={quoteattr(v)}" for k, v in plain.items()) + ">")
        if name in outer:
            outer[name].append(plain.get("nombre", "").strip())

    def end(name):
        name = _local(name)
        if opened:
            add(f"</{name}>")
        if name in outer:
            outer[name].pop()
        if name == tag:
            number, parts, names = opened.pop()
            ready.append((number, "".join(parts), names))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: add(escape(text)) if opened else None
    try:
        parser.Parse(data, True)
    except expat.ExpatError as problem:
        raise Fault(f"ExpatError: {problem}") from problem
    return ready


def element_rows(files: DataFrame, tag: str, above: tuple[str, ...] = (), roots: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of that local name, with ``seq``, ``xml`` and ``above``, and null as ``error``; for a document with a fault
    one row with its ``error`` alone. Documents that have an ``error`` already keep it."""
    kept = [c for c in files.columns if c not in ("content", "error")]
    given = "error" in files.columns

    def read(batches):
        for batch in batches:
            at, found, size = [], [], 0

            def out(batch, at, found):
                rest = batch.select(kept).take(pa.array(at, pa.int32()))
                seq, xml, names, errors = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays([*rest.columns, pa.array(seq, pa.int64()), pa.array(xml, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(errors, pa.string())],
                                                  names=[*kept, "seq", "xml", "above", "error"])

            for i in range(batch.num_rows):
                error = batch.column("error")[i].as_py() if given else None
                try:
                    if error is not None:
                        raise Fault(error)
                    rows = [(*row, None) for row in elements(_repaired(batch.column("content")[i].as_py()), tag, above, roots)]
                except Fault as problem:
                    rows = [(-1, None, None, str(problem)[:200])]
                for row in rows:
                    at.append(i)
                    found.append(row)
                    size += len(row[1] or "")
                    if size > _FLUSH:
                        yield out(batch, at, found)
                        at, found, size = [], [], 0
            if found:
                yield out(batch, at, found)

    schema = files.select(*kept).schema.add("seq", "long").add("xml", "string").add("above", ArrayType(StringType())).add("error", "string")
    return files.select(*kept, "content", *(["error"] if given else [])).mapInArrow(read, schema)
