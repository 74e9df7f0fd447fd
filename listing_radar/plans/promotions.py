"""Listing run: pages to facts, and facts to the next snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listing_radar import fixed_values as V, schemas
from listing_radar.functions import ids, patterns as P, scores, urls as U
from listing_radar.functions.text import clean_evidence, collapse_whitespace, normalize_text
from listing_radar.operators import changes, dedupe, enrich, geo, quality
from listing_radar.operators.matching import Catalog, match_catalog
from listing_radar.operators.scale import broadcast_if_small
from listing_radar.session import cut_lineage
from listing_radar.sources.html import html_facts
from listing_radar.sources.jsonld import node_address, offer_range

_EVIDENCE_ARRAY = f"array<{schemas.EVIDENCE}>"


def evidence_item(field: str, value: Column, url: Column, at: Column, extractor: str, confidence: str, quality_name: str,
                  fragment: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"), clean_evidence(value, 160).alias("value_text"), url.alias("source_url"),
        at.alias("captured_at_utc"), F.lit(extractor).alias("extractor"),
        F.lit(confidence).cast("decimal(5,2)").alias("confidence"), F.lit(quality_name).alias("quality"),
        clean_evidence(fragment).alias("text_fragment"))


def _range_text(low: Column, high: Column) -> Column:
    return F.concat_ws("-", low.cast("string"), high.cast("string"))


def canonical_url(page_url: Column, canonical: Column, og_url: Column) -> Column:
    """Canonical link, else og:url, else the page itself."""
    stated = F.coalesce(canonical, og_url)
    return F.coalesce(F.nullif(F.when(stated.isNotNull(), U.resolve_url(page_url, stated)), F.lit("")), page_url)


def pattern_evidence(df: DataFrame, extractor: str = "TextPatternExtractor") -> Column:
    """Evidence rows of the text facts: the price always, nine others once per field."""
    text, url, at = F.col("text"), F.col("page_url"), F.col("fetched_at")
    low = F.col("_low") if "_low" in df.columns else None
    have = F.transform("evidence", lambda e: e["field"])
    rows = [
        ("propertyTypes", F.array_join("property_types", ", "), V.PAT_TERMS),
        ("bedrooms", _range_text(F.col("bedrooms_min"), F.col("bedrooms_max")), V.PAT_BEDROOMS),
        ("bathrooms", _range_text(F.col("bathrooms_min"), F.col("bathrooms_max")), V.PAT_BATHROOMS),
        ("builtAreaSqm", _range_text(F.col("built_area_min_sqm"), F.col("built_area_max_sqm")), V.PAT_BUILT_AREA),
        ("plotAreaSqm", _range_text(F.col("plot_area_min_sqm"), F.col("plot_area_max_sqm")), V.PAT_PLOT_AREA),
        ("garageSpaces", _range_text(F.col("garage_spaces_min"), F.col("garage_spaces_max")), V.PAT_GARAGE),
        ("commercialStatus", F.nullif("commercial_status", F.lit("unknown")), V.PAT_COMMERCIAL_EVIDENCE),
        ("constructionStatus", F.nullif("construction_status", F.lit("unknown")), V.PAT_CONSTRUCTION_EVIDENCE),
        ("deliveryDateText", F.col("delivery_date_text"), V.PAT_DELIVERY),
        ("developerName", F.col("developer_name"), V.PAT_DEVELOPER),
    ]
    made = [
        F.when(F.col("price_in_text"), evidence_item(
            "priceFrom", F.col("price_from").cast("string"), url, at, extractor, "0.84", "normalized",
            P.evidence_fragment(text, V.PAT_PRICE, low)))
    ]
    for field, value, pattern in rows:
        wanted = (F.trim(F.coalesce(value, F.lit(""))) != "") & ~F.array_contains(have, field)
        made.append(F.when(wanted, evidence_item(
            field, value, url, at, extractor, "0.78", "normalized", P.evidence_fragment(text, pattern, low))))
    return F.array_compact(F.array(*made))


def add_text_facts(df: DataFrame) -> DataFrame:
    """Fill facts from ``text`` (whitespace-collapsed, whole); stated facts win over patterns."""
    text, low = F.col("text"), F.col("_low")
    found = df.withColumn("_low", P.folded(text)).withColumns(
        {
            "_price": P.price_range(text, low), "_built": P.built_area(text, low), "_plot": P.plot_area(text, low),
            "_beds": P.bedrooms(text, low), "_baths": P.bathrooms(text, low), "_garage": P.garage_spaces(text, low),
            "_delivery": P.delivery(text, low), "_available": P.available_units(text, low),
        }
    )

    def keep(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value)

    out = found.withColumns(
        {
            "price_in_text": F.col("_price.price_from").isNotNull(),
            "price_from": keep("price_from", F.col("_price.price_from")),
            "price_to": keep("price_to", F.col("_price.price_to")),
            "built_area_min_sqm": keep("built_area_min_sqm", F.col("_built.min")),
            "built_area_max_sqm": keep("built_area_max_sqm", F.col("_built.max")),
            "plot_area_min_sqm": keep("plot_area_min_sqm", F.col("_plot.min")),
            "plot_area_max_sqm": keep("plot_area_max_sqm", F.col("_plot.max")),
            "bedrooms_min": keep("bedrooms_min", F.col("_beds.min")),
            "bedrooms_max": keep("bedrooms_max", F.col("_beds.max")),
            "bathrooms_min": keep("bathrooms_min", F.col("_baths.min")),
            "bathrooms_max": keep("bathrooms_max", F.col("_baths.max")),
            "garage_spaces_min": keep("garage_spaces_min", F.col("_garage.min")),
            "garage_spaces_max": keep("garage_spaces_max", F.col("_garage.max")),
            "property_types": F.array_sort(F.array_union("property_types", P.property_types(text, low))),
            "has_private_pool": keep("has_private_pool", P.private_pool(text, low)),
            "has_community_pool": keep("has_community_pool", P.community_pool(text, low)),
            "building_licence_status": keep("building_licence_status", P.licence_status(text, low)),
            "estimated_delivery_date": F.when(F.col("delivery_date_text").isNull(), F.col("_delivery.date")).otherwise(
                F.col("estimated_delivery_date")),
            "delivery_date_text": keep("delivery_date_text", F.col("_delivery.text")),
            "total_units": keep("total_units", P.total_units(text, low)),
            "available_units": keep("available_units", F.col("_available")),
            "developer_name": keep("developer_name", P.developer_name(text, low)),
            "_commercial": P.commercial_status(text, F.col("commercial_status"), low),
            "construction_status": P.construction_status(text, F.col("construction_status"), low),
        }
    )
    single = (F.col("available_units") == 1) & (F.col("_commercial") == "unknown")
    out = out.withColumn("commercial_status", F.when(single, F.lit("lastUnits")).otherwise(F.col("_commercial")))
    out = out.withColumn("evidence", F.concat("evidence", pattern_evidence(out)))
    return out.drop("_price", "_built", "_plot", "_beds", "_baths", "_garage", "_delivery", "_available", "_commercial",
                    "_low", "price_in_text")


def empty_facts(df: DataFrame) -> DataFrame:
    """Add every listing column that is not there yet, empty."""
    starts = {
        "location_precision": F.lit("unknown"), "property_types": F.array().cast("array<string>"),
        "commercial_status": F.lit("unknown"), "construction_status": F.lit("unknown"), "currency": F.lit("EUR"),
        "brochure_urls": F.array().cast("array<string>"), "tags": F.array().cast("array<string>"),
        "warnings": F.array().cast("array<string>"), "evidence": F.array().cast(_EVIDENCE_ARRAY),
        "source_urls": F.array().cast("array<string>"), "consecutive_misses": F.lit(0), "active": F.lit(True),
    }
    missing = {n: starts.get(n, F.lit(None)).cast(k) for n, k in schemas.PROMOTION_FIELDS.items() if n not in df.columns}
    return df.withColumns(missing)


#: What a source says about its pages.
SOURCE_COLUMNS = {
    "source_id": "string", "source_kind": "string", "fixed_municipality": "string", "municipality_hints": "array<string>", "content_selector": "string",
    "additional_content_selectors": "array<string>", "custom_selectors": "map<string,string>", "allowed_hosts": "array<string>",
}


def source_table(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Sources given as dicts as a table; what they leave out is empty."""
    return spark.createDataFrame([tuple(s.get(c) for c in SOURCE_COLUMNS) for s in sources], schemas.ddl(SOURCE_COLUMNS))


def extract_promotions(pages: DataFrame, sources: DataFrame | dict, municipalities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, failed pages) of the pages (source_id, url, html, fetched_at) of any number of sources in one plan.

    ``sources``: rows of ``SOURCE_COLUMNS``, whose selectors, fixed places and hosts are data like the pages; or one source as a
    dict, whose pages need no source_id. Structured data first, markup only on pages without any. A source whose selectors cannot be
    read fails its own pages only; pages of an unknown source have no listings.
    """
    if isinstance(sources, dict):
        pages = pages.withColumn("source_id", F.lit(sources["source_id"]))
        sources = source_table(pages.sparkSession, [sources])
    catalog = Catalog(municipalities)
    none = F.array().cast("array<string>")
    given = sources.select(*[F.col(c).cast(k).alias(f"_{c}") for c, k in SOURCE_COLUMNS.items()])
    roots = F.filter(F.concat(F.array("_content_selector"), F.coalesce("_additional_content_selectors", none)), lambda s: F.coalesce(s, F.lit("")) != "")
    given = given.withColumn("_root_selectors", roots).drop("_additional_content_selectors")
    joined = pages.join(broadcast_if_small(given), F.col("source_id") == F.col("_source_id")).drop("source_id")
    facts = html_facts(joined, nodes=True, selectors=("_root_selectors", "_custom_selectors")).withColumnRenamed("url", "_page")
    complete = F.forall("roots", lambda r: r.isNotNull()) & F.col("error").isNull()
    failed = facts.where(~complete).select(
        F.col("_source_id").alias("source_id"), F.col("_page").alias("page_url"),
        F.coalesce("error", F.lit("content selector not found")).alias("error"))
    found = F.array_join("roots", " ")
    text = F.when(F.coalesce("_content_selector", F.lit("")) != "", found).otherwise(F.concat_ws(" ", "text", found))
    url = canonical_url(F.col("_page"), F.col("canonical"), F.try_element_at("meta", F.lit("og:url")))
    stated = F.coalesce(F.try_element_at("meta", F.lit("og:title")), "h1", "title")
    carried = ["_source_id", "_source_kind", "_fixed_municipality", "_allowed_hosts"]
    facts = facts.where(complete).select(
        "_page", url.alias("page_url"), collapse_whitespace(text).alias("text"), "links", "overrides", "fetched_at", stated.alias("_stated"), "nodes", *carried,
        (F.coalesce(F.size("_custom_selectors"), F.lit(0)) > 0).alias("_custom"), F.try_element_at("_municipality_hints", F.lit(1)).alias("_hint"))
    fallback = F.coalesce("_fixed_municipality", "_hint")

    # one row per structured listing, or one for a page without any: no join, the page stays with its rows
    rows = facts.select("*", F.inline_outer("nodes")).drop("nodes")
    from_node = F.col("node_no").isNotNull()
    rows = match_catalog(rows, F.coalesce("locality", F.lit("")), catalog, "_by_locality")
    rows = match_catalog(rows, F.coalesce(node_address(rows), F.lit("")), catalog, "_by_address")
    rows = match_catalog(rows, F.when(from_node, "").otherwise(F.col("text")), catalog, "_by_text")
    price = offer_range(F.coalesce("offer_prices", F.array().cast("array<string>")))
    number = F.replace(F.col("latitude"), F.lit(","), F.lit(".")).try_cast("double")
    place = F.when(from_node, F.coalesce("_by_locality", "_by_address", fallback, F.lit(""))).otherwise(F.coalesce("_by_text", fallback))
    own_url = F.coalesce(F.nullif(U.resolve_url(F.col("page_url"), F.col("url")), F.lit("")), F.col("page_url"))
    relevant = F.col("_custom") | P.is_listing_text(F.col("text"))
    # a generator keeps the filter and the place on one evaluation of the text
    rows = rows.select("*", F.inline(F.filter(F.array(F.struct(place.alias("municipality"))), lambda r: from_node | (
        (F.trim(F.coalesce("_stated", F.lit(""))) != "") & (F.trim(F.coalesce(r["municipality"], F.lit(""))) != "") & relevant))))
    rows = rows.select(
        F.when(from_node, F.col("name")).otherwise(clean_evidence(F.col("_stated"), 160)).alias("name"),
        F.when(from_node, own_url).otherwise(F.col("page_url")).alias("canonical_url"), "page_url",
        F.coalesce("brand", "seller", "provider").alias("developer_name"),
        node_address(rows).alias("address"), "locality", "postal_code", number.alias("latitude"),
        F.replace(F.col("longitude"), F.lit(","), F.lit(".")).try_cast("double").alias("longitude"),
        F.when(number.isNotNull(), F.lit("exactCoordinates")).otherwise(F.lit("unknown")).alias("location_precision"),
        F.col("rooms").try_cast("int").alias("bedrooms_min"), price["price_from"].alias("price_from"),
        price["price_to"].alias("price_to"), "municipality",
        F.when(from_node, "JsonLdPromotionExtractor").otherwise("HtmlMetadataExtractor").alias("_extractor"),
        F.when(from_node, F.col("raw")).otherwise(F.col("_stated")).alias("_raw"),
        "text", "links", "overrides", "fetched_at", "_page", F.coalesce("script_no", F.lit(-1)).alias("_script"), F.coalesce("node_no", F.lit(-1)).alias("_node"), *carried)

    out = empty_facts(rows)
    out = out.withColumns({"source_kind": F.col("_source_kind"), "source_urls": F.array("page_url"),
                           "location_precision": F.coalesce("location_precision", F.lit("unknown"))})
    from_json = F.col("_extractor") == "JsonLdPromotionExtractor"
    url_at = (F.col("page_url"), F.col("fetched_at"))
    named = F.when(from_json, evidence_item("name", F.col("name"), *url_at, "JsonLdPromotionExtractor", "0.96", "explicit", F.col("_raw"))
                   ).otherwise(evidence_item("name", F.col("name"), *url_at, "HtmlMetadataExtractor", "0.82", "explicit", F.col("_raw")))
    priced = F.when(from_json & F.col("price_from").isNotNull(), evidence_item(
        "priceFrom", F.col("price_from").cast("string"), *url_at, "JsonLdPromotionExtractor", "0.94", "explicit", F.col("_raw")))
    out = add_text_facts(out.withColumn("evidence", F.array_compact(F.array(named, priced))))
    out = apply_overrides(out, catalog)
    out = apply_fixed_municipality(out, F.col("_fixed_municipality"))
    out = out.withColumn("brochure_urls", brochure_urls(F.col("page_url"), F.col("links"), F.col("_allowed_hosts")))
    out = out.withColumn("row_id", F.xxhash64("_page", "_script", "_node", "canonical_url", "name", F.col("price_from"), F.col("price_to")))
    out = out.withColumn("source_id", F.col("_source_id"))
    return dedupe.distinct_on_page(out.select(*schemas.PROMOTION_FIELDS, "row_id", "_page", "source_id")).drop("_page"), failed


def brochure_urls(base: Column, links: Column, allowed_hosts: Column) -> Column:
    """PDF links, absolute; of the allowed hosts only if there are any."""
    hosts = F.transform(F.coalesce(allowed_hosts, F.array().cast("array<string>")), F.lower)
    # a path can end in .pdf only if its link says so or leaves the page's own path
    likely = F.filter(links, lambda l: F.coalesce(F.lower(l["href"]).contains(".pdf") | F.trim(l["href"]).rlike("^([#?]|$)"), F.lit(True)))
    absolute = F.transform(likely, lambda l: U.resolve_url(base, l["href"]))

    def wanted(u: Column) -> Column:
        pdf = F.lower(U.path_of(u)).endswith(".pdf") & (u != "")
        return pdf & ((F.size(hosts) == 0) | F.array_contains(hosts, U.host_of(u)))

    return F.array_sort(F.array_distinct(F.filter(absolute, wanted)))


def apply_overrides(df: DataFrame, municipalities: DataFrame | Catalog) -> DataFrame:
    """Facts named by the source's own selectors replace what the patterns found."""
    def value(name: str) -> Column:
        keys = F.map_from_entries(F.transform(F.map_entries("overrides"), lambda e: F.struct(F.lower(e["key"]), e["value"])))
        return F.nullif(F.trim(F.try_element_at(keys, F.lit(name))), F.lit(""))

    def replaced(name: str, key: str, new: Column) -> Column:
        return F.when(value(key).isNotNull(), new).otherwise(F.col(name))

    out = df.withColumn("_place_text", value("municipality"))
    out = match_catalog(out, F.coalesce("_place_text", F.lit("")), municipalities, "_place")
    units = F.regexp_extract(value("totalunits"), r"\d+", 0).try_cast("int")
    proofs = F.transform(
        F.filter(F.map_entries("overrides"), lambda e: F.trim(e["value"]) != ""),
        lambda e: F.struct(
            e["key"].alias("field"), clean_evidence(e["value"], 160).alias("value_text"), F.col("page_url").alias("source_url"),
            F.col("fetched_at").alias("captured_at_utc"), F.lit("DomainSpecificSelectorExtractor").alias("extractor"),
            F.lit("0.92").cast("decimal(5,2)").alias("confidence"), F.lit("explicit").alias("quality"),
            clean_evidence(e["value"]).alias("text_fragment")))
    return out.withColumns(
        {
            "name": replaced("name", "name", clean_evidence(value("name"), 160)),
            "developer_name": replaced("developer_name", "developername", clean_evidence(value("developername"), 120)),
            "municipality": replaced("municipality", "municipality", F.coalesce("_place", clean_evidence(value("municipality"), 100))),
            "address": replaced("address", "address", clean_evidence(value("address"), 180)),
            "price_from": replaced("price_from", "pricefrom", P.parse_spanish_decimal(value("pricefrom"))),
            "total_units": F.coalesce(units, F.col("total_units")),
            "property_types": replaced("property_types", "propertytypes", P.property_types(value("propertytypes"))),
            "evidence": F.concat("evidence", F.coalesce(proofs, F.array().cast(_EVIDENCE_ARRAY))),
        }
    ).drop("_place", "_place_text")


def apply_fixed_municipality(df: DataFrame, place: Column) -> DataFrame:
    """The place that a source states for all its listings, with its proof; an empty one changes nothing."""
    proof = evidence_item("municipality", place, F.col("page_url"), F.col("fetched_at"), "ReviewedSourceConfiguration",
                          "0.98", "explicit", F.concat(F.lit("Municipio fijo revisado para la URL de inicio: "), place))
    stated = F.trim(F.coalesce(place, F.lit(""))) != ""
    return df.withColumns({"municipality": F.when(stated, place).otherwise(F.col("municipality")),
                           "evidence": F.when(stated, F.array_append("evidence", proof)).otherwise(F.col("evidence"))})


def normalize_promotions(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Clean names and URLs, take kind and confidence from the source, clamp evidence."""
    hosts = sources.select("source_id", F.transform("start_urls", U.host_of).alias("_hosts"))
    out = df.join(broadcast_if_small(hosts), "source_id", "left")
    canonical = U.normalize_url(F.col("canonical_url"))
    domain_match = F.array_contains(F.coalesce("_hosts", F.array().cast("array<string>")), F.nullif(U.host_of(canonical), F.lit("")))
    score = scores.source_confidence(F.col("source_kind"), F.size("brochure_urls"), F.col("developer_name"),
                                     F.size("evidence"), domain_match)
    evidence = F.transform("evidence", lambda e: F.struct(
        e["field"].alias("field"), clean_evidence(e["value_text"], 160).alias("value_text"),
        U.normalize_url(e["source_url"]).alias("source_url"), e["captured_at_utc"].alias("captured_at_utc"),
        e["extractor"].alias("extractor"),
        F.least(F.greatest(e["confidence"], F.lit(0)), F.lit(1)).cast("decimal(5,2)").alias("confidence"),
        e["quality"].alias("quality"), clean_evidence(e["text_fragment"]).alias("text_fragment")))
    return out.withColumns(
        {
            "name": F.trim("name"), "normalized_name": normalize_text(F.col("name")), "canonical_url": canonical,
            "source_urls": F.array_sort(F.array_distinct(F.transform(
                F.array_append("source_urls", F.col("canonical_url")), U.normalize_url))),
            "source_confidence_explanation": score, "source_confidence": score["final_score"], "evidence": evidence,
        }
    ).drop("_hosts")


@dataclass
class PromotionRun:
    """The snapshot, the change log, the checks and the report; the lists of merged listings also as
    whole row tables (survivor_id is the row_id of a listing that was kept)."""

    state: DataFrame
    changes: DataFrame
    validated: DataFrame
    report: DataFrame
    source_urls: DataFrame
    evidence: DataFrame


def promotion_run(extracted: DataFrame, source_runs: DataFrame, previous: DataFrame, sources: DataFrame,
                  municipalities: DataFrame, now: Column, run_ok: bool, accepted: DataFrame | None = None,
                  geocode_cache: DataFrame | None = None, municipality: str | None = None) -> PromotionRun:
    """Extracted listings to the next snapshot. ``previous`` has the listing columns; arrays that merging
    may grow without bound (source URLs, evidence) are available as rows from ``dedupe.merged_values``."""
    rows = extracted
    if municipality is not None:
        rows = rows.where(F.lower("municipality") == municipality.lower())
    rows = normalize_promotions(rows, sources)
    identity = ids.promotion_id(*[F.col(c) for c in ("canonical_url", "name", "municipality", "developer_name", "address", "locality")])
    rows = rows.withColumn("id", identity)
    if accepted is not None:
        rows = enrich.apply_accepted(rows, accepted)
    # read by every branch below: extracted and located once
    rows = cut_lineage(geo.geocode(rows, municipalities, now, geocode_cache))
    assigned = cut_lineage(dedupe.assign_survivors(rows))
    merged = dedupe.possible_duplicates(dedupe.merge_duplicates(assigned))
    current = with_merged_lists(merged, assigned).withColumn("id", identity)
    current = cut_lineage(current.dropDuplicates(["id"]).select(*previous.columns))
    old = geo.geocode(previous, municipalities, now, geocode_cache)
    diff = changes.state_diff(current, old, now, run_ok)
    validated = cut_lineage(quality.validate_promotions(diff, municipalities))
    log = changes.changes_of(diff, now)
    report = quality.run_report(source_runs, log, validated)
    return PromotionRun(validated.where("is_valid").select(*previous.columns), log, validated, report,
                        dedupe.merged_values(assigned, "source_urls"), dedupe.merged_evidence(assigned))


def with_merged_lists(merged: DataFrame, assigned: DataFrame) -> DataFrame:
    """Give survivors the merged source URLs, brochures, tags and evidence of all their members, by one rule for all sizes."""
    own = assigned.where("row_id = survivor_id").select(F.col("row_id").alias("_own"))
    out = merged.join(own, merged["row_id"] == own["_own"]).withColumnRenamed("_own", "survivor_id")
    warned = F.when(F.col("possible_duplicate"), F.array_union("warnings", F.array(F.lit(V.WARN_DUPLICATE)))).otherwise(F.col("warnings"))
    return out.join(dedupe.merge_arrays(assigned), "survivor_id").withColumn("warnings", warned).drop("survivor_id")
