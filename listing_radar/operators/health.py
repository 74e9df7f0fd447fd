"""Source health over a log of runs, and coverage per place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions.urls import domain_of, strip_www
from listing_radar.operators.scale import (
    HEAVY_ROWS,
    attach_group_values,
    broadcast_if_small,
    one_row,
)

HEALTH = ["first_checked_utc", "last_attempt_utc", "last_success_utc", "last_failure_utc", "last_non_empty_utc",
          "next_check_due_utc", "consecutive_failures", "consecutive_empty_runs", "last_items_read",
          "last_candidates_matched", "status", "issues"]


def run_counters(runs: DataFrame, segment: Column) -> DataFrame:
    """Per run: failures in a row and empty runs in a row so far. A success ends the first series, a
    non-empty success the second; failures leave the second untouched.

    ``segment`` (say the day of the run) must not decrease in time; it slices the history of a busy source. Inside a slice, totals
    run from its start, with the total at the last success (the last non-empty one) beside them. A slice is told by its ends of
    these four; ends of the slices before are composed in order and come back to the rows in one join.
    """
    order = [F.col("checked_at"), F.col("run_id")]
    inside = Window.partitionBy("source_id", "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source_id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("_segment", segment)
    total = lambda c: F.sum(c.cast("long")).over(inside)
    rows = rows.withColumns({"_f": total(~F.col("success")), "_e": total(F.col("success") & (F.col("items_read") == 0))})
    # totals never fall, so the latest of them is the greatest
    rows = rows.withColumns({"_fs": F.max(F.when(F.col("success"), F.col("_f"))).over(inside),
                             "_es": F.max(F.when(F.col("success") & (F.col("items_read") > 0), F.col("_e"))).over(inside)})
    ends = rows.groupBy("source_id", "_segment").agg(*[F.max(c).alias(f"{c}_end") for c in ("_f", "_e", "_fs", "_es")])
    ends = ends.withColumns({f"{c}_0": F.coalesce(F.sum(f"{c}_end").over(before), F.lit(0)) for c in ("_f", "_e")})
    ends = ends.withColumns({f"{c}s_0": F.max(F.col(f"{c}_0") + F.col(f"{c}s_end")).over(before) for c in ("_f", "_e")})
    out = rows.join(ends.select("source_id", "_segment", "_f_0", "_e_0", "_fs_0", "_es_0"), ["source_id", "_segment"], "left")

    def since(c: str) -> Column:
        """The running total less that at the last mark, in this slice or before it."""
        return F.col(f"{c}_0") + F.col(c) - F.coalesce(F.col(f"{c}_0") + F.col(f"{c}s"), F.col(f"{c}s_0"), F.lit(0))

    seen = F.coalesce("_es", "_es_0").isNotNull()
    out = out.withColumns({"consecutive_failures": since("_f"), "consecutive_empty_runs": since("_e")})
    status = health_status(F.col("success"), F.col("items_read"), F.col("consecutive_failures"),
                           F.col("consecutive_empty_runs"), seen)
    return out.withColumn("status", status).select(*runs.columns, "consecutive_failures", "consecutive_empty_runs", "status")


def health_status(success: Column, items: Column, failures: Column, empties: Column, had_data: Column) -> Column:
    return (
        F.when(~success, F.when(failures >= 2, F.lit("failing")).otherwise(F.lit("degraded")))
        .when((items == 0) & (empties >= 2) & had_data, F.lit("degraded"))
        .otherwise(F.lit("healthy"))
    )


def update_health(previous: DataFrame, runs: DataFrame, sources: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Health of every enabled source after any number of runs; sources that are gone drop out.

    Two aggregates: the last success and the last non-empty success, then the runs after them.
    """
    order = F.struct("checked_at", "run_id")
    good, full = F.col("success"), F.col("success") & (F.col("items_read") > 0)
    marks = runs.groupBy("source_id").agg(
        F.max(F.when(good, order)).alias("_ok"), F.max(F.when(full, order)).alias("_full"), F.count(F.lit(1)).alias("_n"))
    marked = attach_group_values(runs, marks, ["source_id"], "_n", F.col("run_id"), heavy_rows)
    after_ok = ~good & (F.col("_ok").isNull() | (order > F.col("_ok")))
    after_full = good & (F.col("items_read") == 0) & (F.col("_full").isNull() | (order > F.col("_full")))
    latest = marked.groupBy("source_id").agg(
        F.min("checked_at").alias("_first"),
        F.max("checked_at").alias("_attempt"),
        F.max(F.when(good, F.col("checked_at"))).alias("_success"),
        F.max(F.when(~good, F.col("checked_at"))).alias("_failure"),
        F.max(F.when(full, F.col("checked_at"))).alias("_data"),
        F.count_if(after_ok).alias("_failures"),
        F.count_if(after_full).alias("_empties"),
        F.bool_or(good).alias("_any_ok"),
        F.bool_or(full).alias("_any_full"),
        F.max_by(F.struct("success", "items_read", "candidates_matched", "error"), order).alias("_last"),
        F.max_by(F.struct("items_read", "candidates_matched"), F.when(good, order)).alias("_read"),
    )
    config = sources.where("enabled").select("source_id", "source_name", "source_kind", "cadence", "fixed_municipality")
    prev = previous.select("source_id", *[F.col(c).alias(f"p_{c}") for c in HEALTH])
    out = config.join(prev, "source_id", "left").join(latest, "source_id", "left")
    ran = F.col("_attempt").isNotNull()
    failures = F.col("_failures") + F.when(F.col("_any_ok"), F.lit(0)).otherwise(F.coalesce("p_consecutive_failures", F.lit(0)))
    empties = F.col("_empties") + F.when(F.col("_any_full"), F.lit(0)).otherwise(F.coalesce("p_consecutive_empty_runs", F.lit(0)))
    had_data = F.coalesce("_data", "p_last_non_empty_utc").isNotNull()
    status = health_status(F.col("_last.success"), F.col("_last.items_read"), failures, empties, had_data)
    issues = (
        F.when(~F.col("_last.success"), F.array(F.coalesce("_last.error", F.lit(""))))
        .when(status == "degraded", F.array(F.lit(V.ISSUE_EMPTY)))
        .otherwise(F.array().cast("array<string>"))
    )
    due = F.col("_attempt") + F.expr(f"interval {V.CHECK_DUE_HOURS} hours")
    return out.select(
        "source_id", "source_name", "source_kind", "cadence", "fixed_municipality",
        F.coalesce("p_first_checked_utc", "_first").alias("first_checked_utc"),
        F.coalesce("_attempt", "p_last_attempt_utc").alias("last_attempt_utc"),
        F.coalesce("_success", "p_last_success_utc").alias("last_success_utc"),
        F.coalesce("_failure", "p_last_failure_utc").alias("last_failure_utc"),
        F.coalesce("_data", "p_last_non_empty_utc").alias("last_non_empty_utc"),
        F.when(ran, due).otherwise(F.col("p_next_check_due_utc")).alias("next_check_due_utc"),
        F.when(ran, failures).otherwise(F.coalesce("p_consecutive_failures", F.lit(0))).cast("int").alias("consecutive_failures"),
        F.when(ran, empties).otherwise(F.coalesce("p_consecutive_empty_runs", F.lit(0))).cast("int").alias("consecutive_empty_runs"),
        F.coalesce("_read.items_read", "p_last_items_read", F.lit(0)).cast("int").alias("last_items_read"),
        F.coalesce("_read.candidates_matched", "p_last_candidates_matched", F.lit(0)).cast("int").alias("last_candidates_matched"),
        F.when(ran, status).otherwise(F.coalesce("p_status", F.lit("notChecked"))).alias("status"),
        F.when(ran, issues).otherwise(F.coalesce("p_issues", F.array().cast("array<string>"))).alias("issues"),
    )


def drop_removed_sources(health: DataFrame, sources: DataFrame) -> DataFrame:
    return health.join(sources.where("enabled").select("source_id"), "source_id", "left_semi")


def overdue_sources(health: DataFrame, now: Column) -> DataFrame:
    return health.where(F.col("next_check_due_utc") < now).orderBy("source_id")


def troubled_sources(health: DataFrame) -> DataFrame:
    return health.where(F.col("status").isin("degraded", "failing"))


def uncovered_municipalities(coverage: DataFrame) -> DataFrame:
    return coverage.where(F.col("status").isin("centralOnly", "degraded", "notChecked"))


def municipality_coverage(municipalities: DataFrame, health: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per enabled place: its direct sources (equi-join) and all central ones (a scalar)."""
    healthy = F.col("status") == "healthy"
    checked = F.col("last_attempt_utc").isNotNull()
    success = F.max(F.when(healthy, F.col("last_success_utc")))
    direct = health.where(F.col("source_kind") == V.DIRECT_SOURCE_KIND).groupBy(F.lower("fixed_municipality").alias("_k")).agg(
        F.count(F.lit(1)).alias("_direct"), F.count_if(healthy).alias("_direct_ok"),
        F.bool_or(checked).alias("_direct_checked"), success.alias("_direct_success"))
    central = health.where(F.col("source_kind").isin(V.CENTRAL_SOURCE_KINDS)).agg(
        F.struct(F.count_if(healthy).alias("ok"), F.bool_or(checked).alias("checked"), success.alias("success")).alias("c")
    ).scalar()
    counts = candidates.groupBy("municipality").agg(
        F.count_if(F.col("status") == "new").alias("_new"), F.count_if(F.col("status") == "monitoring").alias("_monitoring"))
    places = municipalities.where("enabled").select("official_name", F.lower("official_name").alias("_k"))
    out = places.join(direct, "_k", "left").withColumn("_central", central)
    out = out.join(counts, F.col("official_name") == F.col("municipality"), "left")
    n_direct, n_central = F.coalesce("_direct_ok", F.lit(0)), F.coalesce("_central.ok", F.lit(0))
    any_checked = F.coalesce("_direct_checked", F.lit(False)) | F.coalesce("_central.checked", F.lit(False))
    status = (
        F.when((n_direct > 0) & (n_central > 0), F.lit("directAndCentral"))
        .when(n_direct > 0, F.lit("directOnly"))
        .when(n_central > 0, F.lit("centralOnly"))
        .when(any_checked, F.lit("degraded"))
        .otherwise(F.lit("notChecked"))
    )
    return out.select(
        F.col("official_name").alias("municipality"), status.alias("status"),
        F.coalesce("_direct", F.lit(0)).alias("configured_direct_sources"),
        n_direct.alias("healthy_direct_sources"), n_central.alias("healthy_central_sources"),
        F.greatest("_direct_success", "_central.success").alias("last_successful_check_utc"),
        F.coalesce("_new", F.lit(0)).alias("new_candidates"),
        F.coalesce("_monitoring", F.lit(0)).alias("monitoring_candidates"),
    )


def commercial_domains(sources: DataFrame) -> DataFrame:
    hosts = sources.where(F.col("source_kind") == V.COMMERCIAL_SOURCE_KIND).select("source_id", F.explode("allowed_hosts").alias("h"))
    return hosts.select("source_id", strip_www(F.col("h")).alias("domain"))


def referenced_domains(candidates: DataFrame) -> DataFrame:
    """Domains that open or verified candidates link to."""
    live = candidates.where(F.col("status").isin("new", "monitoring", "verifiedSource"))
    return (
        live.select(F.explode("related_urls").alias("u")).select(F.lower(domain_of(F.col("u"))).alias("domain"))
        .where("domain is not null").distinct()
    )


def unmonitored_domains(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    monitored = commercial_domains(sources).select("domain").distinct()
    return referenced_domains(candidates).join(monitored, "domain", "left_anti")


def coverage_snapshot(sources: DataFrame, health: DataFrame, candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row of totals over sources, domains, places and candidates."""
    def status_count(name: str, alias: str) -> Column:
        return F.count_if(F.col("status") == name).alias(alias)

    enabled = sources.where("enabled")
    commercial = F.col("source_kind") == V.COMMERCIAL_SOURCE_KIND
    a = health.agg(
        F.count(F.lit(1)).alias("enabled_sources"), status_count("healthy", "healthy_sources"),
        status_count("degraded", "degraded_sources"), status_count("failing", "failing_sources"),
        F.count_if(commercial).alias("commercial_sources"),
        F.count_if(commercial & (F.col("status") == "healthy")).alias("healthy_commercial_sources"))
    well = health.where(commercial & (F.col("status") == "healthy")).select("source_id", F.lit(True).alias("_ok"))
    b = commercial_domains(enabled).join(well, "source_id", "left").agg(
        F.count_distinct("domain").alias("commercial_domains_monitored"),
        F.count_distinct(F.when(F.col("_ok"), F.col("domain"))).alias("healthy_commercial_domains"))
    monitored = commercial_domains(enabled).select("domain").distinct().withColumn("_m", F.lit(True))
    c = referenced_domains(candidates).join(monitored, "domain", "left").agg(
        F.count(F.lit(1)).alias("referenced_domains_discovered"),
        F.count_if(F.col("_m").isNull()).alias("unmonitored_referenced_domains"))
    d = coverage.agg(
        F.count(F.lit(1)).alias("municipalities_total"),
        F.count_if(F.col("configured_direct_sources") > 0).alias("municipalities_with_direct_source"),
        F.count_if(F.col("healthy_direct_sources") > 0).alias("municipalities_with_healthy_direct_source"),
        F.count_if(F.col("status").isin("centralOnly", "directOnly", "directAndCentral"))
        .alias("municipalities_with_healthy_coverage"))
    e = candidates.agg(
        F.count_if(F.col("status").isin(V.PENDING_STATUSES)).alias("pending_candidates"),
        status_count("new", "new_candidates"), status_count("monitoring", "monitoring_candidates"),
        status_count("rejected", "rejected_candidates"), status_count("verifiedSource", "verified_source_candidates"),
        status_count("stale", "stale_candidates"),
        F.count_distinct(F.when(commercial, F.lower("municipality"))).alias("municipalities_with_commercial_signals"))
    return one_row(a, b, c, d, e)


def radar_run_summary(items: DataFrame, upserted: DataFrame) -> DataFrame:
    """Per source: items read, hits, new candidates and updates (every further hit is an update)."""
    read = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("items_read"))
    hits = upserted.where("hits > 0").groupBy("source_id").agg(
        F.sum("hits").alias("candidates_matched"), F.count_if("is_new").alias("new_candidates"),
        F.sum(F.col("hits") - F.col("is_new").cast("long")).alias("updated_candidates"))
    out = read.join(hits, "source_id", "left")
    return out.na.fill(0, ["candidates_matched", "new_candidates", "updated_candidates"])


def attach_sources(df: DataFrame, sources: DataFrame) -> DataFrame:
    return df.join(broadcast_if_small(sources), "source_id")
