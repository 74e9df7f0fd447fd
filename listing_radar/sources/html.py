"""One Python pass over page markup; everything after it is column work.

The browser-grade markup model is not rebuilt here: a streaming reader keeps the stack of open tags and
notes what the selectors ask for. Selectors may use a tag name, ``.class``, ``#id``, ``[attr=value]`` and
``[attr*=value]``, and commas.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from listing_radar.sources.jsonld import NODE, listing_nodes

FACTS = (
    "title string, h1 string, canonical string, meta map<string,string>, json_ld array<string>, "
    "links array<struct<pos:int,href:string,text:string>>, text string, roots array<string>, "
    "blocks array<struct<selector:int,pos:int,tag:string,title:string,href:string,marked_href:string,"
    "cells array<string>,text:string>>, overrides map<string,string>"
)

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NOTED = {"title", "h1", "a", "td", "script"}
_HIDDEN = {"script", "style", "template", "noscript"}
_CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "article", "section", "h1", "h2", "h3"}, "li": {"li"}, "tr": {"tr"},
              "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_HEADING = "h2, h3, .heading, .title-text, strong"
#: References without their semicolon, outside of scripts and style sheets, where none are read.
_UNENDED = re.compile(r"(?is)(<(script|style)\b.*?</\2\s*>)|&(?!#?\w+;)")
_SIMPLE = re.compile(r"^([a-zA-Z0-9*]*)((?:[.#][\w-]+|\[[^\]]+\])*)$")


#: Pages whose facts a worker holds together; an Arrow batch may have many more.
PAGES_AT_ONCE = 128


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches, a few at a time."""
    for batch in batches:
        for start in range(0, len(batch), PAGES_AT_ONCE):
            yield batch.iloc[start:start + PAGES_AT_ONCE]


def compile_selector(selector: str):
    """Test for one comma list of simple selectors."""
    tests = []
    for part in selector.split(","):
        found = _SIMPLE.match(part.strip())
        if not found:
            raise ValueError(f"unsupported selector: {part.strip()}")
        tag, wants = found.group(1).lower(), []
        for piece in re.findall(r"[.#][\w-]+|\[[^\]]+\]", found.group(2)):
            if piece[0] == ".":
                wants.append(("class~", piece[1:], None))
            elif piece[0] == "#":
                wants.append(("=", "id", piece[1:]))
            else:
                name, operator, value = re.match(r"\[([\w:-]+)\s*(\*?=)?\s*['\"]?([^'\"\]]*)", piece).groups()
                wants.append((operator or "has", name.lower(), value))
        tests.append((tag, wants))

    def matches(tag: str, attrs: dict[str, str]) -> bool:
        def holds(operator: str, name: str, value: str | None) -> bool:
            if operator == "class~":
                return name in (attrs.get("class") or "").split()
            actual = attrs.get(name)
            return actual is not None and (operator == "has" or (actual == value if operator == "=" else value in actual))

        return any(t in ("", "*", tag) and all(holds(*w) for w in wants) for t, wants in tests)

    return matches


class _Node:
    __slots__ = ("tag", "attrs", "parts", "shown", "tests", "title", "href", "marked", "cells", "order")

    def __init__(self, tag: str, attrs: dict[str, str], tests: list[int], order: int):
        self.tag, self.attrs, self.tests, self.order = tag, attrs, tests, order
        self.parts: list[str] | None = None
        self.shown: list[str] | None = None
        self.title = self.href = self.marked = None
        self.cells: list[str] = []


class _Reader(HTMLParser):
    def __init__(self, blocks: list, roots: list, overrides: dict, mark: str):
        super().__init__(convert_charrefs=True)
        self.block_tests, self.root_tests, self.override_tests = blocks, roots, overrides
        self.mark, self.heading = mark, compile_selector(_HEADING)
        self.open: list[_Node] = []
        self.facts = {"title": None, "h1": None, "canonical": None, "meta": {}, "json_ld": [], "links": [], "blocks": [],
                      "roots": [None] * len(roots), "overrides": {}}
        self.body: list[str] = []
        self.count = 0

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        while self.open and tag in _CLOSED_BY.get(self.open[-1].tag, ()):
            self._close(self.open.pop())
        tests = [i for i, test in enumerate(self.block_tests) if test(tag, values)]
        node = _Node(tag, values, tests, self.count)
        named = any(test(tag, values) for test in self.override_tests.values())
        if tests or named or tag in _NOTED or self.heading(tag, values):
            node.parts = []
        if any(test(tag, values) for test in self.root_tests):
            node.shown = []
        self.count += 1
        facts = self.facts
        if tag == "link" and values.get("rel") == "canonical" and facts["canonical"] is None:
            facts["canonical"] = values.get("href")
        if tag == "meta" and "content" in values:
            facts["meta"].setdefault(values.get("property") or values.get("name") or "", values["content"])
        if tag == "a" and values.get("href"):
            for outer in [*self.open, node]:
                outer.href = outer.href or values["href"]
                if self.mark and self.mark in values["href"]:
                    outer.marked = outer.marked or values["href"]
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(node.tag == tag for node in self.open):
            while self.open:
                node = self.open.pop()
                self._close(node)
                if node.tag == tag:
                    break

    def handle_data(self, data):
        visible = bool(data.strip()) and not any(node.tag in _HIDDEN for node in self.open)
        for node in self.open:
            if node.parts is not None:
                node.parts.append(data)
            if visible and node.shown is not None:
                node.shown.append(data)
        if visible and not any(node.tag in ("head", "title") for node in self.open):
            self.body.append(data)

    def _close(self, node: _Node) -> None:
        facts, text = self.facts, "".join(node.parts or ())
        if node.tag in ("title", "h1") and facts[node.tag] is None:
            facts[node.tag] = text.strip()
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json" and text.strip():
            facts["json_ld"].append(text.strip())
        if node.tag == "a" and node.attrs.get("href"):
            facts["links"].append((node.order, node.attrs["href"], text))
        if self.heading(node.tag, node.attrs):
            for outer in self.open:
                if outer.title is None or node.order < outer.title[0]:
                    outer.title = (node.order, text)
        if node.tag == "td":
            for outer in self.open:
                outer.cells.append(text)
        for i, test in enumerate(self.root_tests):
            if test(node.tag, node.attrs) and (facts["roots"][i] is None or node.order < facts["roots"][i][0]):
                facts["roots"][i] = (node.order, " ".join(node.shown or ()))
        for name, test in self.override_tests.items():
            found = facts["overrides"].get(name)
            if test(node.tag, node.attrs) and (found is None or node.order < found[0]):
                facts["overrides"][name] = (node.order, text.strip())
        for selector in node.tests:
            title = node.title[1] if node.title else None
            facts["blocks"].append((selector, node.order, node.tag, title, node.href, node.marked, list(node.cells), text))

    def finish(self) -> dict:
        self.close()
        while self.open:
            self._close(self.open.pop())
        facts = self.facts
        facts["text"] = " ".join(self.body)
        facts["links"].sort(key=lambda link: link[0])
        facts["blocks"].sort(key=lambda block: (block[1], block[0]))
        facts["roots"] = [root[1] if root else None for root in facts["roots"]]
        facts["overrides"] = {name: value[1] for name, value in facts["overrides"].items()}
        return facts


def _read_page(html: str | None, tests, override_tests, link_mark: str) -> tuple[dict, str | None]:
    try:
        reader = _Reader(*tests, override_tests, link_mark)
        reader.feed(html or "")
        return reader.finish(), None
    except Exception as problem:  # whatever is wrong with one page must not end the job
        return _Reader(*tests, override_tests, link_mark).finish(), f"{type(problem).__name__}: {problem}"[:200]


@functools.lru_cache(maxsize=4096)
def _own_tests(roots: tuple[str, ...], overrides: tuple[tuple[str, str], ...]) -> tuple[list, dict, str | None]:
    """Compiled selectors of a source, and what is wrong with them."""
    try:
        return [compile_selector(s) for s in roots], {name: compile_selector(s) for name, s in overrides if s}, None
    except (ValueError, AttributeError) as problem:
        return [], {}, f"{type(problem).__name__}: {problem}"[:200]


def html_facts(pages: DataFrame, blocks: list[str] | None = None, roots: list[str] | None = None,
               overrides: dict[str, str] | None = None, link_mark: str = "", nodes: bool = False,
               selectors: tuple[str, str] | None = None, ended_references: bool = False) -> DataFrame:
    """Adds the markup facts of every page (column ``html``); the html itself is dropped.

    ``blocks`` are selectors whose elements are listed with title, first link, cells and text, ``roots``
    selectors whose first element's text is needed, ``overrides`` named selectors for single facts. With ``nodes``
    the listings of the page's JSON-LD scripts come along. ``selectors`` names two columns with a page's own roots (array) and
    overrides (map), in the place of the common ones; a worker compiles each of them once. A page that cannot be read, or whose
    own selectors cannot, has its facts empty and says so in ``error``. As in browsers ``&amp`` is read without its semicolon, too; with
    ``ended_references`` such text stays as it is.
    """
    kept = [c for c in pages.columns if c != "html"]
    facts_schema = T.StructType.fromDDL(FACTS)
    extra = [T.StructField("error", T.StringType())]
    if nodes:
        extra.append(T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(f"script_no int, {NODE}"))))
    schema = T.StructType([*[pages.schema[c] for c in kept], *facts_schema.fields, *extra])
    names = facts_schema.names
    wanted_blocks, wanted_roots, named = list(blocks or []), list(roots or []), dict(overrides or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = [compile_selector(s) for s in wanted_blocks], [compile_selector(s) for s in wanted_roots]
        override_tests = {name: compile_selector(s) for name, s in named.items()}
        for batch in slices(batches):
            found = []
            for i, html in enumerate(batch["html"]):
                if ended_references:
                    html = _UNENDED.sub(lambda m: m.group(1) or "&amp;", html or "")
                if selectors:
                    own, named_own = batch[selectors[0]].iloc[i], batch[selectors[1]].iloc[i]
                    own_tests, own_overrides, error = _own_tests(tuple(own if own is not None else ()), tuple(sorted((named_own or {}).items())))
                    facts, error = (_read_page("", tests, {}, link_mark)[0], error) if error else _read_page(html, (tests[0], own_tests), own_overrides, link_mark)
                else:
                    facts, error = _read_page(html, tests, override_tests, link_mark)
                row = [facts[n] for n in names] + [error]
                found.append([*row, listing_nodes(facts["json_ld"])] if nodes else row)
            out = batch[kept].copy()
            for i, name in enumerate([*names, *(f.name for f in extra)]):
                out[name] = [row[i] for row in found]
            yield out

    return pages.mapInPandas(read, schema)


def page_links(facts: DataFrame, key: str) -> DataFrame:
    return facts.select(key, F.inline("links"))
