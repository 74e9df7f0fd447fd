"""Coverage audit: which places show signals, through how many channels, and which to look at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.operators.scale import one_row


def audit_by_municipality(municipalities: DataFrame, coverage: DataFrame, observed: DataFrame) -> DataFrame:
    """Places left join coverage left join candidate counts, with channel count and reason."""
    kind, status = F.col("source_kind"), F.col("status")
    counts = observed.groupBy(F.lower("municipality").alias("_k")).agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(kind.isin(V.CENTRAL_SOURCE_KINDS)).alias("_central"),
        F.count_if(kind == V.DIRECT_SOURCE_KIND).alias("_direct"),
        F.count_if(kind == V.COMMERCIAL_SOURCE_KIND).alias("_commercial"),
        F.count_if(status.isin(V.PENDING_STATUSES)).alias("_pending"),
    )
    cover = coverage.select(
        F.lower("municipality").alias("_k"), F.col("status").alias("_status"),
        F.col("healthy_central_sources").alias("_hc"), F.col("healthy_direct_sources").alias("_hd"))
    places = municipalities.where("enabled").select("official_name", F.lower("official_name").alias("_k"))
    out = places.join(cover, "_k", "left").join(counts, "_k", "left").na.fill(
        0, ["_all", "_central", "_direct", "_commercial", "_pending", "_hc", "_hd"])
    channels = sum(((F.col(c) > 0).cast("int") for c in ("_central", "_direct", "_commercial")), F.lit(0))
    reason = (
        F.when((channels == 1) & (F.col("_pending") > 0), F.lit("singleChannelSignal"))
        .when((F.col("_hc") == 0) | (F.col("_hd") == 0), F.lit("coverageGap"))
        .when(F.col("_all") == 0, F.lit("zeroSignalControl"))
        .when(channels <= 1, F.lit("singleChannelSignal"))
        .otherwise(F.lit("crossChannelControl"))
    )
    return out.select(
        F.col("official_name").alias("municipality"), reason.alias("reason"),
        F.coalesce("_status", F.lit("notChecked")).alias("coverage_status"),
        F.col("_hc").alias("healthy_central_sources"), F.col("_hd").alias("healthy_direct_sources"),
        F.col("_central").alias("central_candidates"), F.col("_direct").alias("direct_candidates"),
        F.col("_commercial").alias("commercial_candidates"), channels.alias("observed_channels"),
        F.col("_pending").alias("pending_candidates"),
    )


def audit_order() -> list[Column]:
    rank = F.lit(len(V.AUDIT_REASON_RANK))
    for name, position in V.AUDIT_REASON_RANK.items():
        rank = F.when(F.col("reason") == name, F.lit(position)).otherwise(rank)
    signals = F.col("central_candidates") + F.col("direct_candidates") + F.col("commercial_candidates")
    return [rank.asc(), F.col("pending_candidates").desc(), signals.desc(), F.col("municipality").asc()]


def audit_sample(population: DataFrame, size: int) -> DataFrame:
    if size < 1:
        raise ValueError("the sample holds at least one place")
    return population.orderBy(*audit_order()).limit(size)


def audit_summary(population: DataFrame, observed: DataFrame, size: int) -> DataFrame:
    channels = F.col("observed_channels")
    places = population.agg(
        F.count(F.lit(1)).alias("population"),
        F.least(F.count(F.lit(1)), F.lit(size)).alias("actual_sample_size"),
        F.count_if(channels == 1).alias("single_channel_municipalities"),
        F.count_if((F.col("healthy_central_sources") == 0) | (F.col("healthy_direct_sources") == 0))
        .alias("coverage_gap_municipalities"),
        F.count_if(channels == 0).alias("zero_signal_municipalities"),
        F.count_if(channels >= 2).alias("cross_channel_municipalities"),
    )
    seen = observed.agg(
        F.count(F.lit(1)).alias("observed_candidates"),
        F.count_if(F.col("status").isin(V.PENDING_STATUSES)).alias("pending_candidates"),
    )
    return one_row(places, seen)
