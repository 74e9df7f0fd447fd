"""Embedded structured data: nodes of JSON-LD scripts as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from listing_radar.fixed_values import LISTING_NODE_TYPES
from listing_radar.functions.patterns import parse_spanish_decimal

NODE = (
    "node_no int, type string, name string, url string, brand string, seller string, provider string, "
    "address_text string, street string, locality string, postal_code string, latitude string, longitude string, "
    "rooms string, has_offers boolean, offer_prices array<string>, raw string"
)


def _get(node, *names):
    """Value of the first of the names that is present, keys compared without case."""
    if isinstance(node, dict):
        folded = {}
        for key, value in node.items():
            folded.setdefault(key.lower(), value)
        for name in names:
            if name.lower() in folded:
                return folded[name.lower()]
    return None


def _text(value) -> str | None:
    if isinstance(value, list):
        value = value[0] if value else ""
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(value, bool) or value is None or isinstance(value, dict):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def _nodes(element) -> Iterator[dict]:
    if isinstance(element, list):
        for item in element:
            yield from _nodes(item)
    elif isinstance(element, dict):
        yield element
        yield from _nodes(_get(element, "@graph"))


def _price(value) -> str | None:
    """Numbers keep their value (six decimals), texts stay as written."""
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return f"{value:.6f}" if is_number else _text(value)


def _row(number: int, node: dict, raw: str) -> tuple:
    address, geo, offers = _get(node, "address"), _get(node, "geo"), _get(node, "offers")
    many = offers if isinstance(offers, list) else [offers]
    prices = [_price(_get(offer, key)) for offer in many for key in ("lowPrice", "price", "highPrice")]
    return (
        number, _text(_get(node, "@type")), _text(_get(node, "name", "headline")), _text(_get(node, "url")),
        *[_text(_get(_get(node, k), "name")) for k in ("brand", "seller", "provider")],
        address if isinstance(address, str) else None,
        *[_text(_get(address, k)) for k in ("streetAddress", "addressLocality", "postalCode")],
        _text(_get(geo, "latitude")), _text(_get(geo, "longitude")), _text(_get(node, "numberOfRooms")),
        offers is not None, [p for p in prices if p is not None], raw,
    )


def _script_rows(script: str) -> list[tuple]:
    """Rows of all nodes of a script; none if it is no JSON or too deep."""
    try:
        return [_row(i, node, script) for i, node in enumerate(_nodes(json.loads(script)))]
    except (ValueError, RecursionError):
        return []


def listing_nodes(scripts: list[str]) -> list[tuple]:
    """(script_no, *NODE) of the nodes of a page's scripts that describe a named listing."""
    found = [(number, *row) for number, script in enumerate(scripts) for row in _script_rows(script)]
    return [r for r in found if any(k in (r[2] or "").lower() for k in LISTING_NODE_TYPES) and (r[3] or "").strip(" ")]


def json_ld_nodes(facts: DataFrame, key: str) -> DataFrame:
    """Nodes of all scripts of a page that describe a listing; a script that is not JSON gives no row."""
    scripts = facts.select(key, F.posexplode("json_ld").alias("script_no", "script"))
    if key in T.StructType.fromDDL(NODE).names:
        raise ValueError(f"the page key must not be called {key}: nodes have a column of that name")
    schema = T.StructType([scripts.schema[key], scripts.schema["script_no"], *T.StructType.fromDDL(NODE).fields])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for owner, number, script in batch.itertuples(index=False):
                rows += [(owner, number, *row) for row in _script_rows(script)]
            yield pd.DataFrame(rows, columns=schema.names)

    return scripts.mapInPandas(read, schema).where(is_listing_node())


def is_listing_node() -> Column:
    kind = F.lower(F.coalesce("type", F.lit("")))
    known = F.lit(False)
    for name in LISTING_NODE_TYPES:
        known = known | kind.contains(name)
    return known & (F.trim(F.coalesce("name", F.lit(""))) != "")


def offer_range(prices: Column) -> Column:
    """struct(price_from, price_to) over all prices of a node's offers."""
    plain = F.filter(
        F.transform(prices, lambda p: F.coalesce(
            F.when(p.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$") & ~p.rlike(r"^\d+\.\d{3}$"), p.try_cast("decimal(14,2)")),
            parse_spanish_decimal(p))),
        lambda v: v.isNotNull(),
    )
    return F.struct(
        F.array_min(plain).alias("price_from"), F.when(F.size(plain) > 1, F.array_max(plain)).alias("price_to"))


def node_address(row: DataFrame) -> Column:
    parts = F.array_join(F.filter(F.array("street", "locality", "postal_code"),
                                  lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), ", ")
    has_parts = F.coalesce("street", "locality", "postal_code").isNotNull()
    return F.coalesce(F.col("address_text"), F.when(has_parts, parts))
