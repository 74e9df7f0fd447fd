"""Explicit schemas: nothing is inferred when reading."""

from __future__ import annotations

import re

from pyspark.sql import types as T

EVIDENCE = (
    "struct<field:string,value_text:string,source_url:string,captured_at_utc:timestamp,extractor:string,"
    "confidence:decimal(5,2),quality:string,text_fragment:string>"
)
CONFIDENCE = (
    "struct<base_score:decimal(5,2),final_score:decimal(5,2),summary:string,"
    "signals:array<struct<code:string,label:string,impact:decimal(5,2)>>>"
)
PROMOTION_FIELDS = {
    "id": "string", "name": "string", "normalized_name": "string", "municipality": "string", "locality": "string",
    "address": "string", "postal_code": "string", "latitude": "double", "longitude": "double",
    "location_precision": "string", "property_types": "array<string>", "commercial_status": "string",
    "construction_status": "string", "source_kind": "string", "source_confidence": "decimal(5,2)",
    "source_confidence_explanation": CONFIDENCE, "developer_name": "string", "marketer_name": "string",
    "cooperative_name": "string", "total_units": "int", "available_units": "int", "price_from": "decimal(14,2)",
    "price_to": "decimal(14,2)", "currency": "string", "bedrooms_min": "int", "bedrooms_max": "int",
    "bathrooms_min": "int", "bathrooms_max": "int", "usable_area_min_sqm": "decimal(14,2)",
    "usable_area_max_sqm": "decimal(14,2)", "built_area_min_sqm": "decimal(14,2)", "built_area_max_sqm": "decimal(14,2)",
    "plot_area_min_sqm": "decimal(14,2)", "plot_area_max_sqm": "decimal(14,2)", "garage_spaces_min": "int",
    "garage_spaces_max": "int", "has_private_pool": "boolean", "has_community_pool": "boolean",
    "delivery_date_text": "string", "estimated_delivery_date": "date", "building_licence_status": "string",
    "canonical_url": "string", "source_urls": "array<string>", "brochure_urls": "array<string>",
    "first_seen_utc": "timestamp", "last_seen_utc": "timestamp", "last_changed_utc": "timestamp",
    "consecutive_misses": "int", "active": "boolean", "tags": "array<string>", "evidence": f"array<{EVIDENCE}>",
    "warnings": "array<string>",
}


def struct(text: str) -> T.StructType:
    """Parsed form of a schema text; needs a running session."""
    return T.StructType.fromDDL(text)


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


PROMOTIONS = ddl(PROMOTION_FIELDS)
CHANGES = (
    "id string, promotion_id string, promotion_name string, kind string, detected_at_utc timestamp, "
    "fields array<struct<field:string,previous_value:string,current_value:string>>"
)
FEED_ITEMS = (
    "source_id string, external_id string, title string, summary string, official_url string, "
    "related_urls array<string>, municipality_hint string, published_at timestamp, seq bigint"
)
CANDIDATES = (
    "id string, source_id string, source_name string, source_kind string, external_id string, title string, "
    "summary string, official_url string, related_urls array<string>, published_at_utc timestamp, municipality string, "
    "kind string, confidence decimal(5,2), matched_terms array<string>, first_seen_utc timestamp, "
    "last_seen_utc timestamp, status string"
)
SOURCE_HEALTH = (
    "source_id string, source_name string, source_kind string, cadence string, fixed_municipality string, "
    "first_checked_utc timestamp, last_attempt_utc timestamp, last_success_utc timestamp, last_failure_utc timestamp, "
    "last_non_empty_utc timestamp, next_check_due_utc timestamp, consecutive_failures int, consecutive_empty_runs int, "
    "last_items_read int, last_candidates_matched int, status string, issues array<string>"
)
SOURCE_RUNS = (
    "source_id string, run_id bigint, checked_at timestamp, success boolean, items_read int, candidates_matched int, "
    "error string"
)
USAGE = (
    "input_tokens bigint, cached_input_tokens bigint, cache_write_tokens bigint, output_tokens bigint, reasoning_tokens bigint, "
    "total_tokens bigint, estimated_cost_usd decimal(12,6)"
)
ENRICHMENTS = (
    "proposal_id string, promotion_id string, promotion_name string, canonical_url string, content_hash string, provider string, "
    "model string, evidence_fetched_at timestamp, generated_at timestamp, reviewed_at timestamp, status string, "
    f"max_cost_usd decimal(12,6), {USAGE}, warnings array<string>, "
    "fields array<struct<field:string,value_text:string,source_url:string,evidence_text:string,confidence:decimal(5,2),"
    "status:string,reviewed_at:timestamp>>"
)
CENTROID_CSV = (
    "COD_GEO string, NOMBRE_ACTUAL string, LONGITUD_ETRS89 double, LATITUD_ETRS89 double, ORIGENCOOR string"
)

# named arrays of the catalog files
CATALOGS = {
    "municipalities": (
        "municipalities array<struct<officialName:string,aliases:array<string>,localities:array<string>,latitude:double,"
        "longitude:double,boundingBox:array<double>,enabled:boolean,searchTerms:array<string>>>"),
    "centroids": (
        "centroids array<struct<municipality:string,sourceRecordId:string,latitude:double,longitude:double,"
        "coordinateOrigin:string,sourceUrl:string,checkedAtUtc:timestamp>>"),
    "domains": ("domains array<string>"),
    "terms": ("terms array<struct<term:string,kind:string>>"),
    "contextTerms": ("contextTerms array<string>"),
    "exclusionTerms": ("exclusionTerms array<string>"),
    "sources": (
        "sources array<struct<id:string,name:string,baseUrl:string,enabled:boolean,sourceKind:string,format:string,"
        "cadence:string,urlTemplate:string,allowedHosts:array<string>,startUrls:array<string>,itemSelectors:array<string>,"
        "sitemapIncludes:array<string>,includePatterns:array<string>,excludePatterns:array<string>,"
        "detailUrlIncludes:array<string>,detailContentSelectors:array<string>,detailLinkSelectors:array<string>,"
        "contentSelector:string,additionalContentSelectors:array<string>,customSelectors:map<string,string>,"
        "municipalityHints:array<string>,ignoreExclusionTerms:boolean,reviewRules:array<struct<urlPattern:string,status:string>>,"
        "searchQueryTemplates:array<string>,resultExcludedHosts:array<string>,fixedMunicipality:string,maxItems:int,"
        "maxPages:int,maxDepth:int,maxDetailPages:int,maxResultsPerQuery:int>>"),
}
PLAIN_NAMES = {"domains": "domain", "contextTerms": "term", "exclusionTerms": "term"}
_RENAMED = {"id": "source_id", "name": "source_name"}


def snake(name: str) -> str:
    out = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    return _RENAMED.get(out, out)
