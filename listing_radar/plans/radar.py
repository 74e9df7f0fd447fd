"""Radar run: feed items to candidate state, health, coverage, queue and audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar.operators import audit, candidates as C, health as H, triage
from listing_radar.operators.matching import match_items
from listing_radar.session import cut_to_table


@dataclass
class RadarCatalog:
    sources: DataFrame
    municipalities: DataFrame
    terms: DataFrame
    context_terms: DataFrame
    exclusion_terms: DataFrame
    known_urls: DataFrame | None = None


@dataclass
class RadarRun:
    candidates: DataFrame
    source_runs: DataFrame
    health: DataFrame
    coverage: DataFrame
    snapshot: DataFrame
    summary: DataFrame


#: What matching reads of a feed item.
ITEM = ["source_id", "external_id", "title", "summary", "search_text", "official_url", "related_urls", "municipality_hint", "published_at", "seq"]


def match(items: DataFrame, catalog: RadarCatalog, now: Column) -> DataFrame:
    enabled = catalog.sources.where("enabled")
    return match_items(C.valid_feed_items(items), enabled, catalog.municipalities, catalog.terms, catalog.context_terms,
                       catalog.exclusion_terms, catalog.known_urls, now)


def radar_run(items: DataFrame, failures: DataFrame, previous: DataFrame, previous_health: DataFrame,
              catalog: RadarCatalog, now: Column, max_items: int = 2**31 - 1) -> RadarRun:
    """``failures`` (source_id, error): documents that could not be read, one or more rows per source. Their sources keep their
    candidates, get one failed run and do not stop the others."""
    enabled = catalog.sources.where("enabled").select("source_id")
    failures = failures.join(enabled, "source_id", "left_semi").groupBy("source_id").agg(F.min("error").alias("error"))
    # the firsts are taken as structs, of which the optimizer leaves nothing out: columns that matching does not read stay behind
    wanted = items.select(*[c for c in items.columns if c in ITEM])
    readable = wanted.join(failures.select("source_id"), "source_id", "left_anti")
    # the first item per source and key, then the first ``max_items`` of every source
    matched = match(C.first_per_key_capped(C.valid_feed_items(readable), max_items), catalog, now)
    # read by every branch below: texts are matched once
    upserted = cut_to_table(C.upsert_candidates(previous, matched, [F.col("seq")]))
    state = C.apply_configured_reviews(upserted, catalog.sources)
    summary = H.radar_run_summary(readable, upserted)
    good = enabled.join(failures.select("source_id"), "source_id", "left_anti")
    runs = good.join(summary, "source_id", "left").select(
        "source_id", F.lit(True).alias("success"), F.coalesce("items_read", F.lit(0)).cast("int").alias("items_read"),
        F.coalesce("candidates_matched", F.lit(0)).cast("int").alias("candidates_matched"), F.lit(None).cast("string").alias("error"),
    ).unionByName(failures.select(
        "source_id", F.lit(False).alias("success"), F.lit(0).alias("items_read"), F.lit(0).alias("candidates_matched"), "error"))
    runs = runs.withColumns({"checked_at": now, "run_id": F.lit(0).cast("long")})
    health = cut_to_table(H.update_health(previous_health, runs, catalog.sources))
    coverage = H.municipality_coverage(catalog.municipalities, health, state)
    snapshot = H.coverage_snapshot(catalog.sources, health, state, coverage)
    return RadarRun(state, runs, health, coverage, snapshot, summary)


def triage_report(candidates: DataFrame, now: Column, excluded_hosts: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items in queue order, domains, totals)."""
    items = triage.triage_items(candidates, now, excluded_hosts)
    return items.orderBy(*triage.triage_order()), triage.triage_by_domain(items), triage.triage_summary(items)


def audit_report(candidates: DataFrame, municipalities: DataFrame, coverage: DataFrame, first: Column, last: Column,
                 size: int) -> tuple[DataFrame, DataFrame]:
    """(sample, totals)."""
    observed = C.observed_within(candidates, first, last)
    population = audit.audit_by_municipality(municipalities, coverage, observed)
    return audit.audit_sample(population, size), audit.audit_summary(population, observed, size)


def coverage_status(snapshot: DataFrame, health: DataFrame, coverage: DataFrame, now: Column):
    """(snapshot, overdue sources, troubled sources, uncovered places)."""
    return snapshot, H.overdue_sources(health, now), H.troubled_sources(health), H.uncovered_municipalities(coverage)


def excluded_listing_hosts(sources: DataFrame) -> DataFrame:
    """Hosts that no web-search source accepts."""
    hosts = sources.where("source_kind = 'webSearch'").select(F.explode("result_excluded_hosts").alias("h"))
    return hosts.select(F.lower(F.trim("h")).alias("host")).where("host != ''").distinct()
