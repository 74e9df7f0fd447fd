"""Validation of listings and the figures of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions.text import normalize_text
from listing_radar.functions.urls import is_http_url, is_https_url
from listing_radar.operators.scale import broadcast_if_small, one_row


def _range_error(low: str, high: str, field: str) -> Column:
    return F.when(F.col(high) < F.col(low), F.lit(f"{field}Max no puede ser menor que {field}Min."))


def validate_promotions(promotions: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Adds ``errors``, ``warnings_found`` and ``is_valid``."""
    known = municipalities.select(normalize_text(F.col("official_name")).alias("_place")).distinct()
    out = promotions.withColumn("_key", normalize_text(F.col("municipality")))
    out = out.join(broadcast_if_small(known, municipalities), F.col("_key") == F.col("_place"), "left")
    errors = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.lit(V.ERR_NAME)),
            F.when(~is_http_url(F.col("canonical_url")), F.lit(V.ERR_URL)),
            _range_error("price_from", "price_to", "price"),
            _range_error("built_area_min_sqm", "built_area_max_sqm", "builtArea"),
            _range_error("plot_area_min_sqm", "plot_area_max_sqm", "plotArea"),
            _range_error("bedrooms_min", "bedrooms_max", "bedrooms"),
            F.when((F.col("price_from") < 0) | (F.col("price_to") < 0), F.lit(V.ERR_PRICE)),
            F.when(
                ~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180), F.lit(V.ERR_COORDINATES)
            ),
            F.when(
                (F.col("location_precision") == "municipalityCentroid")
                & (F.col("latitude").isNull() | F.col("longitude").isNull()),
                F.lit(V.ERR_CENTROID),
            ),
        )
    )
    unknown = F.concat(F.lit("Municipio fuera de configuración: "), F.coalesce("municipality", F.lit("")), F.lit("."))
    warnings = F.array_compact(F.array(F.when(F.col("_place").isNull(), unknown)))
    return (
        out.withColumn("errors", errors).withColumn("warnings_found", warnings)
        .withColumn("is_valid", F.size("errors") == 0).drop("_key", "_place")
    )


def quality_issues(validated: DataFrame, limit: int = V.QUALITY_ISSUE_LIMIT) -> DataFrame:
    """First issues in id order, the errors of a listing before its warnings (size of the public report)."""
    issues = validated.select("id", F.posexplode(F.concat("errors", "warnings_found")).alias("pos", "issue"))
    return issues.orderBy("id", "pos").limit(limit)


def quality_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count_if("is_valid").alias("valid_promotions"),
        F.count_if(~F.col("is_valid")).alias("invalid_promotions"),
        F.coalesce(F.sum(F.size("warnings_found")), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"),
    )


def dataset_statistics(promotions: DataFrame) -> DataFrame:
    return promotions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("active").alias("active"),
        F.count("price_from").alias("with_price"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("with_coordinates"),
    )


def by_municipality(promotions: DataFrame) -> DataFrame:
    return promotions.groupBy("municipality").agg(F.count(F.lit(1)).alias("n")).orderBy("municipality")


def freshness(promotions: DataFrame, finished_at: Column, stale_after_hours: int = V.STALE_AFTER_HOURS) -> DataFrame:
    newest = F.max("last_seen_utc")
    limit = F.expr(f"interval {stale_after_hours} hours")
    return promotions.agg(
        F.min("last_seen_utc").alias("oldest_check_utc"),
        newest.alias("newest_check_utc"),
        F.coalesce(finished_at > newest + limit, F.lit(False)).alias("is_stale"),
    )


def run_report(source_runs: DataFrame, changes: DataFrame, validated: DataFrame) -> DataFrame:
    """One row: source counts, URL sums, additions and changes, duration, status and the publishing gate."""
    runs = source_runs.agg(
        F.count(F.lit(1)).alias("total_sources"),
        F.count_if(F.col("status") == "success").alias("successful_sources"),
        F.count_if(F.col("status") == "failed").alias("failed_sources"),
        F.count_if(F.col("status") == "skipped").alias("skipped_sources"),
        F.coalesce(F.sum("urls_discovered"), F.lit(0)).alias("discovered_urls"),
        F.coalesce(F.sum("urls_fetched"), F.lit(0)).alias("fetched_urls"),
        F.coalesce(F.sum("urls_skipped"), F.lit(0)).alias("skipped_urls"),
        F.coalesce(F.sum("promotions_extracted"), F.lit(0)).alias("extracted_promotions"),
        F.min("started_at_utc").alias("started_at_utc"),
        F.max("finished_at_utc").alias("finished_at_utc"),
    )
    counted = changes.agg(
        F.count_if(F.col("kind") == "added").alias("new_promotions"),
        F.count_if(F.col("kind") != "added").alias("changed_promotions"),
    )
    joined = one_row(runs, counted, quality_summary(validated))
    seconds = F.unix_micros("finished_at_utc") - F.unix_micros("started_at_utc")
    return (
        joined.withColumn("duration_seconds", F.round(seconds / 1_000_000, 3))
        .withColumn("status", run_status(F.col("successful_sources"), F.col("failed_sources"), F.col("errors")))
        .withColumn("publishable", publishable(F.col("valid_promotions"), F.col("successful_sources")))
    )


def run_status(successful: Column, failed: Column, errors: Column) -> Column:
    return (
        F.when(successful == 0, F.lit("failed"))
        .when((failed > 0) | (errors > 0), F.lit("partialSuccess"))
        .otherwise(F.lit("success"))
    )


def publishable(valid: Column, successful: Column) -> Column:
    return (valid > 0) & (successful > 0)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, whatever the case."""
    return df.groupBy(F.lower(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def provenance_check(municipalities: DataFrame, centroids: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """Rule violations (name, rule) of the centroid table against the catalog, first row per name."""
    ours = municipalities.groupBy(F.lower("official_name").alias("_k")).agg(
        F.min_by(F.struct("official_name", "latitude", "longitude"), "ord").alias("m"))
    theirs = centroids.groupBy(F.lower("municipality").alias("_k")).agg(
        F.min_by(F.struct("municipality", "latitude", "longitude", "source_url", "checked_at_utc", "source_record_id",
                          "coordinate_origin"), "ord").alias("s"))
    both = ours.join(theirs, "_k", "full_outer")
    has_m, has_s = F.col("m").isNotNull(), F.col("s").isNotNull()
    lat, lon = F.col("m.latitude"), F.col("m.longitude")
    half = has_m & (lat.isNull() != lon.isNull())
    full = has_m & lat.isNotNull() & lon.isNotNull()

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(name, F.lit(""))) == ""

    rules = {
        "half_coordinates": half,
        "out_of_range": full & (~lat.between(-90, 90) | ~lon.between(-180, 180)),
        "missing_provenance": full & ~has_s,
        "coordinates_differ": full & has_s & ((lat != F.col("s.latitude")) | (lon != F.col("s.longitude"))),
        "unknown_municipality": has_s & ~has_m,
        "unpublished_coordinates": has_s & has_m & (lat.isNull() | lon.isNull()),
        "not_https": has_s & has_m & ~F.coalesce(is_https_url(F.col("s.source_url")), F.lit(False)),
        "not_checked": has_s & has_m & F.col("s.checked_at_utc").isNull(),
    }
    if schema_version == "1.1":
        rules["missing_record"] = has_s & has_m & (blank("s.source_record_id") | blank("s.coordinate_origin"))
    found = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in rules.items()]))
    name = F.coalesce("m.official_name", "s.municipality")
    return both.select(name.alias("municipality"), F.explode(found).alias("rule"))
