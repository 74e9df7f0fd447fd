"""Scoring expressions: decimals throughout, so that rounding is exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions.text import contains_any, contains_location, historical_year, let, normalize_title
from listing_radar.functions.urls import host_matches, host_of, public_admin_host


def _dec(text: str, precision: int = 5, scale: int = 2) -> Column:
    return F.lit(text).cast(f"decimal({precision},{scale})")


def ordinal(c: Column, names: list[str]) -> Column:
    """Position of an enum value, from 0; null if unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), c), F.lit(0)) - 1


def source_confidence(
    source_kind: Column, brochures: Column, developer: Column, evidence_count: Column, domain_match: Column
) -> Column:
    """struct(base_score, final_score, summary, signals) from the source kind and four signals."""
    base, label = _dec(V.SOURCE_KIND_OTHER[0]), F.lit(V.SOURCE_KIND_OTHER[1])
    for kind, (score, text) in V.SOURCE_KIND_BASE.items():
        base = F.when(source_kind == kind, _dec(score)).otherwise(base)
        label = F.when(source_kind == kind, F.lit(text)).otherwise(label)
    present = {
        "brochure": F.coalesce(brochures > 0, F.lit(False)),
        "developer-identified": F.trim(F.coalesce(developer, F.lit(""))) != "",
        "evidence-rich": F.coalesce(evidence_count >= 4, F.lit(False)),
        "configured-domain-match": F.coalesce(domain_match, F.lit(False)),
    }

    def signal(code: str, text: Column, impact: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), text.alias("label"), impact.alias("impact"))

    signals = F.array_compact(
        F.array(
            signal("source-kind", label, base),
            *[
                F.when(present[code], signal(code, F.lit(text), _dec(score)))
                for code, (score, text) in V.CONFIDENCE_SIGNALS.items()
            ],
        )
    )
    total = base
    for code, (score, _) in V.CONFIDENCE_SIGNALS.items():
        total = total + F.when(present[code], _dec(score)).otherwise(_dec("0"))
    final = F.greatest(F.least(F.bround(total, 2), _dec("1")), _dec("0")).cast("decimal(5,2)")
    return F.struct(
        base.alias("base_score"),
        final.alias("final_score"),
        F.array_join(F.transform(signals, lambda s: s["label"]), " ").alias("summary"),
        signals.alias("signals"),
    )


def candidate_confidence(source_kind: Column, matched_rules: Column) -> Column:
    web = source_kind == V.WEB_SEARCH_KIND
    base = F.when(web, _dec("0.45")).otherwise(_dec("0.65"))
    cap = F.when(web, _dec("0.70")).otherwise(_dec("0.90"))
    return F.least(cap, base + (matched_rules - 1) * _dec("0.05")).cast("decimal(5,2)")


def triage_score(
    title: Column, summary: Column, url: Column, municipality: Column, confidence: Column, matched_terms: Column,
    published_at: Column, now: Column, excluded_hosts: Column,
) -> Column:
    """struct(domain, score, reasons). The score is not clamped yet, because the priority is taken first."""
    terms = F.size(F.array_distinct(F.transform(matched_terms, F.lower)))
    recent = (published_at <= now) & (published_at >= now - F.expr("interval 60 days"))
    old = published_at.isNull() & historical_year(F.concat_ws(" ", title, url), F.year(now))
    texts = F.struct(
        normalize_title(F.concat_ws(" ", title, summary, url)).alias("corpus"),
        normalize_title(F.concat_ws(" ", title, url)).alias("title_url"),
        normalize_title(title).alias("title"), normalize_title(summary).alias("summary"),
        normalize_title(municipality).alias("place"), host_of(url).alias("domain"),
    )

    def with_places(t: Column) -> Column:
        in_title = contains_location(t["title_url"], t["place"])
        return F.struct(
            t.alias("t"), in_title.alias("in_title"), (~in_title & contains_location(t["summary"], t["place"])).alias("in_summary"))

    def hits(w: Column) -> Column:
        t, in_title, in_summary = w["t"], w["in_title"], w["in_summary"]
        parts = [
            ("directPromotionTerms", contains_any(t["corpus"], V.DIRECT_TERMS), 15),
            ("administrativeTerms", contains_any(t["corpus"], V.ADMINISTRATIVE_TERMS), 12),
            ("publicAdministrationHost", public_admin_host(t["domain"]), 12),
            ("multipleMatchedTerms", terms >= 2, 5),
            ("recentlyPublished", recent, 4),
            ("municipalityInTitleOrUrl", in_title, 10),
            ("municipalityOnlyInSummary", in_summary, -8),
            ("municipalityUnconfirmed", ~in_title & ~in_summary, -20),
            ("historicalReference", old, -12),
            ("genericAdministrativeReference", contains_any(t["title"], V.GENERIC_ADMINISTRATIVE_TERMS), -20),
            ("excludedListingHost", host_matches(t["domain"], excluded_hosts), -40),
        ]
        found = [F.when(flag, F.struct(F.lit(n).alias("reason"), F.lit(p).alias("points"))) for n, flag, p in parts]
        return F.struct(t["domain"].alias("domain"), F.array_compact(F.array(*found)).alias("hits"))

    base = F.round(confidence * 100, 0).cast("int")
    return let(
        let(let(texts, with_places), hits),
        lambda h: F.struct(
            h["domain"].alias("domain"),
            F.aggregate(h["hits"], base, lambda acc, hit: acc + hit["points"]).alias("score"),
            F.transform(h["hits"], lambda hit: hit["reason"]).alias("reasons"),
        ),
    )


def triage_band(reasons: Column) -> Column:
    return (
        F.when(F.array_contains(reasons, "directPromotionTerms"), F.lit("directPromotion"))
        .when(F.array_contains(reasons, "administrativeTerms"), F.lit("administrativeSignal"))
        .otherwise(F.lit("generalSignal"))
    )


def triage_priority(score: Column) -> Column:
    return F.when(score >= 75, F.lit("high")).when(score >= 60, F.lit("medium")).otherwise(F.lit("low"))


def completeness_pct(row: dict[str, Column]) -> Column:
    """Share of eleven main facts that are present, rounded half away from zero."""
    def text(name: str) -> Column:
        return F.trim(F.coalesce(row[name], F.lit(""))) != ""

    def either(low: str, high: str) -> Column:
        return row[low].isNotNull() | row[high].isNotNull()

    flags = [
        text("developer_name"), row["price_from"].isNotNull(), either("bedrooms_min", "bedrooms_max"),
        either("bathrooms_min", "bathrooms_max"), either("built_area_min_sqm", "built_area_max_sqm"),
        either("plot_area_min_sqm", "plot_area_max_sqm"), F.size(row["property_types"]) > 0,
        row["available_units"].isNotNull(), text("address"), text("delivery_date_text"),
        row["location_precision"] == "exactCoordinates",
    ]
    filled = F.lit(0)
    for flag in flags:
        filled = filled + F.coalesce(flag, F.lit(False)).cast("int")
    return F.round(filled.cast("decimal(5,2)") * 100 / 11, 0).cast("int")


def missing_fields(row: dict[str, Column]) -> Column:
    """Names of the fillable facts that are null, in their fixed order."""
    columns = {**V.TEXT_FIELDS, **V.INTEGER_FIELDS, **V.DECIMAL_FIELDS}
    return F.array_compact(
        F.array(*[F.when(row[columns[name]].isNull(), F.lit(name)) for name in V.FILLABLE_FIELDS])
    )


def evidence_keywords(name: Column, municipality: Column, missing: Column) -> Column:
    """Name, place and the words that go with the missing fields; first spelling wins whatever the case.

    The word lists are constants, so which of them share a word is known before any row is read: a row compares its words with its
    name and place only.
    """
    def wanted(known: Column, fields: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [F.array_contains(known, f) for f in fields])

    def listed(known: Column) -> Column:
        seen: dict[str, list[tuple[str, ...]]] = {}
        words = []
        for fields, keywords in V.EVIDENCE_KEYWORDS.items():
            for k in keywords:
                before = seen.setdefault(k.lower(), [])
                if fields not in before:
                    shown = reduce(lambda a, f: a & ~wanted(known, f), before, wanted(known, fields))
                    words.append(F.when(shown, F.lit(k)))
                    before.append(fields)
        return F.array(*words)

    def spelled(word: Column) -> Column:
        return F.when(F.trim(F.coalesce(word, F.lit(""))) != "", word)

    def distinct(own: Column) -> Column:
        place = F.when(~own["municipality"].eqNullSafe(own["name"]), own["place"])
        others = F.filter(let(missing, listed), lambda w: w.isNotNull() & ~F.lower(w).eqNullSafe(own["name"]) & ~F.lower(w).eqNullSafe(own["municipality"]))
        return F.concat(F.array_compact(F.array(own["title"], place)), others)

    title, place = spelled(name), spelled(municipality)
    own = F.struct(title.alias("title"), place.alias("place"), F.lower(title).alias("name"), F.lower(place).alias("municipality"))
    return let(own, distinct)


def _price(model: Column, position: int) -> Column:
    out = F.lit(None).cast("decimal(12,6)")
    for name, prices in V.MODEL_PRICES.items():
        out = F.when(model == name, _dec(prices[position], 12, 6)).otherwise(out)
    return out


def _usd(millionths: Column) -> Column:
    return F.round(millionths.cast("decimal(30,8)") / 1_000_000, 6).cast("decimal(12,6)")


def max_cost(model: Column, request: Column, max_output_tokens: Column) -> Column:
    """Upper bound of a call: every byte of the request counts as a token."""
    tokens = F.octet_length(request) + V.TOKEN_RESERVE
    return _usd(tokens * _price(model, 0) + max_output_tokens * _price(model, 2))


def usage_cost(model: Column, tokens: Column, cached: Column, cache_write: Column, output: Column) -> Column:
    plain = F.greatest(tokens - cached - cache_write, F.lit(0))
    factor = _dec(V.CACHE_WRITE_FACTOR)
    return _usd(
        plain * _price(model, 0) + cached * _price(model, 1) + cache_write * (_price(model, 0) * factor)
        + output * _price(model, 2)
    )
