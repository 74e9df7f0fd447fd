"""Enrichment run: listings with gaps to validated proposals, inside a budget."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V, schemas
from listing_radar.functions import ids, patterns as P, scores
from listing_radar.functions.text import clean_evidence, let
from listing_radar.operators import enrich
from listing_radar.operators.scale import one_row
from listing_radar.session import cut_to_table


def pattern_proposals(evidence: DataFrame) -> DataFrame:
    """Proposer that needs no service: facts the text patterns find, quoted from the page.

    Input and output follow the proposer contract: (promotion_id, pages) to (promotion_id, ord, field,
    value_text, source_url, evidence_text, confidence).
    """
    pages = evidence.select("promotion_id", F.posexplode("pages").alias("page_no", "p")).select(
        "promotion_id", "page_no", F.col("p.url").alias("source_url"), F.col("p.text").alias("text"))
    text = F.col("text")
    # every fact is read once and bound: written out, a text would be searched again for each use of a value
    facts = F.struct(
        P.price_range(text).alias("price"), P.built_area(text).alias("built"), P.plot_area(text).alias("plot"), P.bedrooms(text).alias("bedrooms"),
        P.bathrooms(text).alias("bathrooms"), P.garage_spaces(text).alias("garage"), P.total_units(text).alias("units"),
        P.delivery(text).alias("delivery"), P.developer_name(text).alias("developer"))

    def proposals(f: Column) -> Column:
        found = [
            ("priceFrom", f["price"]["price_from"], V.PAT_PRICE),
            ("priceTo", f["price"]["price_to"], V.PAT_PRICE),
            ("builtAreaMinSqm", f["built"]["min"], V.PAT_BUILT_AREA),
            ("builtAreaMaxSqm", f["built"]["max"], V.PAT_BUILT_AREA),
            ("plotAreaMinSqm", f["plot"]["min"], V.PAT_PLOT_AREA),
            ("plotAreaMaxSqm", f["plot"]["max"], V.PAT_PLOT_AREA),
            ("bedroomsMin", f["bedrooms"]["min"], V.PAT_BEDROOMS),
            ("bedroomsMax", f["bedrooms"]["max"], V.PAT_BEDROOMS),
            ("bathroomsMin", f["bathrooms"]["min"], V.PAT_BATHROOMS),
            ("bathroomsMax", f["bathrooms"]["max"], V.PAT_BATHROOMS),
            ("garageSpacesMin", f["garage"]["min"], V.PAT_GARAGE),
            ("garageSpacesMax", f["garage"]["max"], V.PAT_GARAGE),
            ("totalUnits", f["units"], V.PAT_UNITS),
            ("deliveryDateText", f["delivery"]["text"], V.PAT_DELIVERY),
            ("developerName", f["developer"], V.PAT_DEVELOPER),
        ]
        return F.array_compact(F.array(*[
            F.when(value.isNotNull(), F.struct(
                F.lit(name).alias("field"), value.cast("string").alias("value_text"),
                F.regexp_substr(text, F.lit(V.FLAGS + pattern)).alias("evidence_text")))
            for name, value, pattern in found]))

    # posexplode_outer: before a plain one the optimizer would compute the list twice more, to test that it is not empty
    rows = pages.select("promotion_id", "source_url", "page_no", F.posexplode_outer(let(facts, proposals)).alias("pos", "f"))
    return rows.where("f.evidence_text is not null").select(
        "promotion_id", (F.col("page_no") * 100 + F.col("pos")).cast("int").alias("ord"), F.col("f.field").alias("field"),
        F.col("f.value_text").alias("value_text"), "source_url", F.col("f.evidence_text").alias("evidence_text"),
        F.lit("0.90").cast("decimal(5,2)").alias("confidence"))


class EnrichmentRun(NamedTuple):
    """``queue``: every listing with gaps, its decision (admitted or planned, cached, failed, overBudget, notReached) and the error of a
    failed one. ``state``: the proposals after the run (``schemas.ENRICHMENTS``). ``fields``: proposed values with their reason to be
    refused. ``report``: one row."""

    queue: DataFrame
    state: DataFrame
    fields: DataFrame
    report: DataFrame


def with_evidence(queue: DataFrame, pages: DataFrame, sources: DataFrame, max_pages: int, max_characters: int) -> DataFrame:
    """Adds source_id, pages, content_hash, fetched_at, and ``error`` where a listing has no source or no text to quote."""
    known = enrich.find_source_by_host(queue, sources)
    keywords = known.where(~F.col("source_error")).select(
        F.col("id").alias("promotion_id"),
        scores.evidence_keywords(F.col("name"), F.col("municipality"), F.col("missing")).alias("keywords"))
    evidence = enrich.evidence_snippets(pages.join(keywords, "promotion_id"), max_pages, max_characters)
    evidence = evidence.where(F.size("pages") > 0).withColumn("content_hash", ids.content_hash(F.col("pages")))
    out = known.withColumn("promotion_id", F.col("id")).join(evidence, "promotion_id", "left")
    error = (
        F.when(F.col("source_error"), F.printf(F.lit(V.ENRICHMENT_NO_SOURCE), F.coalesce("canonical_url", F.lit(""))))
        .when(F.col("content_hash").isNull(), F.printf(F.lit(V.ENRICHMENT_NO_EVIDENCE), F.coalesce("name", F.lit(""))))
    )
    return out.withColumn("error", error).drop("source_error")


def enrichment_run(promotions: DataFrame, pages: DataFrame, sources: DataFrame, proposals: DataFrame, model: str, max_output_tokens: int,
                   max_cost: Decimal, max_calls: int, max_pages: int, max_characters: int, now: Column,
                   proposer=pattern_proposals, usage: DataFrame | None = None, provider: str = "patterns", dry_run: bool = False) -> EnrichmentRun:
    """One run: sources, evidence, cache, budget, proposals, their checks, the new state and the report.

    ``pages``: promotion_id, url, text, fetched_at. ``sources``: ord, source_id, base_url, allowed_hosts. ``proposals`` is the state
    before. ``proposer`` is any function that follows the contract of ``pattern_proposals``, for example a ``mapInPandas`` job that asks
    a service; its answers are written once, so nothing is asked twice. Calls of a run are made together, so their reserves stay spent;
    ``usage`` (promotion_id and the columns of ``schemas.USAGE``) is what they turned out to use, for state and report. A listing
    without source or evidence takes no call and leaves an error row in the state. A dry run plans calls and changes nothing.
    """
    queue = with_evidence(enrich.eligible(promotions), pages, sources, max_pages, max_characters)
    request = F.concat(F.array_join("missing", ","), F.array_join(F.transform("pages", lambda p: F.concat(p["url"], p["text"])), "\n"))
    priced = enrich.cache_skip(queue, proposals).withColumns(
        {
            "max_cost_usd": scores.max_cost(F.lit(model), request, F.lit(max_output_tokens)),
            "rank": -F.size("missing"),
        }
    ).select("promotion_id", "rank", "missing", "source_id", "pages", "content_hash", "fetched_at", "cached", "max_cost_usd", "error",
             "canonical_url", clean_evidence(F.col("name"), 160).alias("promotion_name"))
    # a failed listing has no cost, so it is never admitted, but it has its place: none fails after the last call
    decided = enrich.budget_admission(priced, ["rank", "promotion_id"], "max_cost_usd", max_cost, max_calls)
    failed = F.col("error").isNotNull() & (F.col("decision") == "overBudget")
    taken = F.lit("planned" if dry_run else "admitted")
    decided = decided.withColumn("decision", F.when(failed, F.lit("failed")).when(F.col("decision") == "admitted", taken).otherwise(F.col("decision")))
    admitted = decided.where("decision = 'admitted'")
    made = cut_to_table(proposer(admitted.select("promotion_id", "pages")))
    checked = enrich.validate_proposals(made, admitted.select("promotion_id", F.inline("pages")), admitted.select("promotion_id", "missing"))
    spent = usage if usage is not None else promotions.sparkSession.createDataFrame([], "promotion_id string, " + schemas.USAGE)
    answers = _answers(admitted, checked, spent, provider, model, now)
    state = proposals
    if not dry_run:
        errors = _errors(decided.where("decision = 'failed'"), provider, model, now)
        state = enrich.mark_stale_and_upsert(proposals, answers, now).unionByName(errors)
    return EnrichmentRun(decided, state, checked, _report(decided, checked, answers, now))


def _answers(admitted: DataFrame, checked: DataFrame, usage: DataFrame, provider: str, model: str, now: Column) -> DataFrame:
    """A pending proposal for each call; good values (one per fillable field at most) and the reasons of refused ones."""
    value = F.struct("ord", "field", "value_text", "source_url", "evidence_text", "confidence")
    gathered = checked.groupBy("promotion_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("reject_reason").isNull(), value))).alias("_fields"),
        F.array_sort(F.collect_set("reject_reason")).alias("_warnings"))
    rows = admitted.join(gathered, "promotion_id", "left").join(usage, "promotion_id", "left")
    fields = F.transform("_fields", lambda f: f.dropFields("ord").withField("status", F.lit("pending")).withField("reviewed_at", F.lit(None).cast("timestamp")))
    return _state_rows(rows.withColumns(
        {
            "proposal_id": ids.proposal_id(F.col("promotion_id"), F.col("content_hash")), "provider": F.lit(provider), "model": F.lit(model),
            "evidence_fetched_at": F.col("fetched_at"), "generated_at": now, "status": F.lit("pending"),
            "fields": F.coalesce(fields, F.array()), "warnings": F.coalesce("_warnings", F.array()),
        }))


def _errors(failed: DataFrame, provider: str, model: str, now: Column) -> DataFrame:
    stamp = F.date_format(now, "yyyyMMddHHmmss")
    return _state_rows(failed.withColumns(
        {
            "proposal_id": F.concat(F.lit("enr-error-"), "promotion_id", F.lit("-"), stamp), "content_hash": F.lit(""),
            "provider": F.lit(provider), "model": F.lit(model), "evidence_fetched_at": now, "generated_at": now, "status": F.lit("pending"),
            "fields": F.array(), "warnings": F.array("error"), "max_cost_usd": F.lit(0),
        }))


def _state_rows(rows: DataFrame) -> DataFrame:
    """The columns of the state; counts that are not known are zero."""
    counts = {f.name for f in schemas.struct(schemas.USAGE)}

    def value(name: str) -> Column:
        c = F.col(name) if name in rows.columns else F.lit(None)
        return F.coalesce(c, F.lit(0)) if name in counts else c

    return rows.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in schemas.struct(schemas.ENRICHMENTS)])


def _report(decided: DataFrame, checked: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    def times(decision: str) -> Column:
        return F.count_if(F.col("decision") == decision)

    called = F.col("decision").isin("admitted", "planned")
    counts = decided.agg(
        F.count(F.lit(1)).alias("eligible"), times("admitted").alias("processed"), times("cached").alias("cached"), times("planned").alias("planned"),
        times("overBudget").alias("budget_skipped"), times("failed").alias("failed"),
        F.coalesce(F.sum(F.when(called, F.col("max_cost_usd"))), F.lit(0)).alias("reserved_max_cost_usd"))
    proposed = checked.agg(F.count_if(F.col("reject_reason").isNull()).alias("proposed_fields"))
    return one_row(counts, proposed, enrich.usage_totals(answers)).withColumn("started_at", now)
