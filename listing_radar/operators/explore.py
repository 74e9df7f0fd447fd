"""Read side: filters, orders and facets over the published table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class FilterSpec:
    """Optional predicates; an empty or null setting does not filter. Inactive rows are hidden by default."""

    search: str = ""
    municipalities: list[str] = field(default_factory=list)
    locality: str = ""
    property_type: str = ""
    price_min: float | None = None
    price_max: float | None = None
    bedrooms_min: int | None = None
    built_area_min: float | None = None
    plot_area_min: float | None = None
    commercial_status: str = ""
    construction_status: str = ""
    source_kind: str = ""
    confidence_min: float | None = None
    active_only: bool = True
    with_price_only: bool = False
    exact_location_only: bool = False


def _has(c: Column, value: str) -> Column:
    return F.coalesce(F.lower(c).contains(value.lower()), F.lit(False))


def _max_or_min(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_max{_unit(name)}"), F.col(f"{name}_min{_unit(name)}"), F.lit(0))


def _unit(name: str) -> str:
    return "_sqm" if name.endswith("area") else ""


def predicates(spec: FilterSpec) -> list[Column]:
    out: list[Column] = []
    if spec.search.strip():
        s = spec.search.strip()
        in_types = F.coalesce(F.exists("property_types", lambda t: _has(t, s)), F.lit(False))
        out.append(reduce(lambda a, b: a | b, [
            *[_has(F.col(c), s) for c in ("name", "municipality", "locality", "developer_name")], in_types]))
    if spec.municipalities:
        out.append(F.lower("municipality").isin([m.lower() for m in spec.municipalities]))
    if spec.locality.strip():
        out.append(F.lower("locality") == spec.locality.lower())
    if spec.property_type.strip():
        out.append(F.exists("property_types", lambda t: _has(t, spec.property_type)))
    if spec.price_min is not None:
        out.append(F.coalesce("price_to", "price_from", F.lit(0)) >= spec.price_min)
    if spec.price_max is not None:
        out.append(F.col("price_from") <= spec.price_max)
    for value, name in ((spec.bedrooms_min, "bedrooms"), (spec.built_area_min, "built_area"), (spec.plot_area_min, "plot_area")):
        if value is not None:
            out.append(_max_or_min(name) >= value)
    for value, name in ((spec.commercial_status, "commercial_status"), (spec.construction_status, "construction_status"),
                        (spec.source_kind, "source_kind")):
        if value.strip():
            out.append(F.col(name) == value)
    if spec.confidence_min is not None:
        out.append(F.col("source_confidence") >= spec.confidence_min)
    if spec.active_only:
        out.append(F.col("active"))
    if spec.with_price_only:
        out.append(F.col("price_from").isNotNull())
    if spec.exact_location_only:
        out.append(F.col("location_precision") == "exactCoordinates")
    return out


def explore(promotions: DataFrame, spec: FilterSpec, ids: DataFrame | None = None) -> DataFrame:
    """All predicates of the spec; ``ids`` (added or changed listings) restricts by semi-join."""
    out = promotions.where(reduce(lambda a, b: a & b, predicates(spec), F.lit(True)))
    return out if ids is None else out.join(ids.select("id"), "id", "left_semi")


def explorer_sort(mode: str) -> list[Column]:
    """One of seven orders; the id makes each of them total."""
    area = F.coalesce("built_area_max_sqm", "built_area_min_sqm")
    plot = F.coalesce("plot_area_max_sqm", "plot_area_min_sqm")
    name = F.upper("name")
    orders = {
        "price-asc": [F.col("price_from").asc_nulls_last()],
        "price-desc": [F.col("price_from").desc_nulls_last()],
        "plot-desc": [plot.desc_nulls_last()],
        "area-desc": [area.desc_nulls_last()],
        "confidence": [F.col("source_confidence").desc()],
        "municipality": [F.upper("municipality"), name],
        "recent": [F.col("last_changed_utc").desc(), name],
    }
    return [*orders.get(mode, orders["recent"]), F.col("id").asc()]


def dataset_order() -> list[Column]:
    """Published order: place in Spanish collation, name whatever the case, id."""
    return [F.collate(F.col("municipality"), "es_CI"), F.upper("name"), F.col("id")]


def facet_values(promotions: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values whatever the case; the spelling met first (lowest id) is shown."""
    rows = promotions.where(F.trim(F.coalesce(column, F.lit(""))) != "")
    return rows.groupBy(F.upper(column).alias("_k")).agg(
        F.min_by(column, "id").alias("value"), F.count(F.lit(1)).alias("n")).orderBy("_k").select("value", "n")


def municipality_filter(promotions: DataFrame, municipality: str | None) -> DataFrame:
    return promotions if municipality is None else promotions.where(F.lower("municipality") == municipality.lower())
