"""Stable identifiers: hashes of normalized content, so that reruns and retries give the same keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listing_radar.functions.text import normalize_company, normalize_text
from listing_radar.functions.urls import normalize_url


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def short_hash(value: Column, prefix: str, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, digits))


def fingerprint(name: Column, municipality: Column, developer: Column) -> Column:
    return F.concat_ws("|", normalize_text(name), normalize_text(municipality), normalize_company(developer))


def promotion_id(
    canonical_url: Column, name: Column, municipality: Column, developer: Column, address: Column, locality: Column
) -> Column:
    """From the URL; without one from name and place; without those from the address."""
    norm_name, norm_place = normalize_text(name), normalize_text(municipality)
    key = (
        F.when(~_blank(canonical_url), F.concat(F.lit("url|"), normalize_url(canonical_url)))
        .when(
            (norm_name != "") & (norm_place != ""),
            F.concat_ws("|", F.lit("name"), norm_name, norm_place, normalize_company(developer)),
        )
        .otherwise(
            F.concat_ws(
                "|", F.lit("place"), normalize_text(F.coalesce(address, locality)), norm_place,
                normalize_company(developer),
            )
        )
    )
    return short_hash(key, "sn-", 20)


def candidate_id(source_id: Column, external_id: Column, url: Column, municipality: Column) -> Column:
    reference = F.when(_blank(external_id), url).otherwise(external_id)
    return short_hash(F.concat_ws("|", source_id, reference, municipality), "lead-", 20)


def change_id(promotion: Column, kind: Column, detected_at: Column) -> Column:
    """``kind`` in camelCase; the hashed text spells it with a capital and the time with seven decimals."""
    label = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 40))
    instant = F.concat(F.date_format(detected_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))
    return short_hash(F.concat_ws("|", promotion, label, instant), "change-", 16)


def content_hash(pages: Column) -> Column:
    """Upper-case SHA-256 over ``url\\ntext`` of an ordered array<struct<url,text>>."""
    lines = F.transform(pages, lambda p: F.concat(p["url"], F.lit("\n"), p["text"]))
    return F.upper(F.sha2(F.array_join(lines, "\n"), 256))


def proposal_id(promotion: Column, hash_value: Column) -> Column:
    return F.concat(F.lit("enr-"), promotion, F.lit("-"), F.lower(F.substring(hash_value, 1, 12)))
