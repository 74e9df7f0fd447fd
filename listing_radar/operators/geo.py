"""Coordinates: cache look-up, place centroids, spreading of coincident points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions.text import normalize_text
from listing_radar.operators.scale import (
    attach_group_values,
    broadcast_if_small,
    number_in_segments,
)


def geocode_query() -> Column:
    return F.concat(F.col("address"), F.lit(", "), F.col("municipality"), F.lit(", Madrid, España"))


def _evidence(value: Column, url: Column, at: Column, extractor: str, confidence: str, quality: str, text: Column) -> Column:
    return F.struct(
        F.lit("location").alias("field"), value.alias("value_text"), url.alias("source_url"), at.alias("captured_at_utc"),
        F.lit(extractor).alias("extractor"), F.lit(confidence).cast("decimal(5,2)").alias("confidence"),
        F.lit(quality).alias("quality"), text.alias("text_fragment"),
    )


def geocode_from_cache(promotions: DataFrame, cache: DataFrame) -> DataFrame:
    """Street position of rows with an address and no latitude, from earlier answers."""
    answer = F.struct(F.col("resolved_at_utc").alias("_at"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    look_up = cache.where("query is not null").groupBy(F.col("query").alias("_query")).agg(F.max(answer).alias("_a")).select("_query", "_a.*")
    wanted = F.when(
        F.col("latitude").isNull() & (F.trim(F.coalesce("address", F.lit(""))) != ""), geocode_query()
    )
    # most rows want nothing; they get a key of their own each, so that they do not meet in one task
    spread = F.concat(F.lit("\0"), F.xxhash64("canonical_url", "name").cast("string"))
    out = promotions.withColumn("_wanted", F.coalesce(wanted, spread))
    out = out.join(broadcast_if_small(look_up), F.col("_wanted") == F.col("_query"), "left")
    hit = F.col("_query").isNotNull()
    proof = _evidence(F.concat_ws(", ", "_lat", "_lon"), F.col("canonical_url"), F.col("_at"), "NominatimGeocoder",
                      "0.75", "normalized", F.lit("Geocodificación persistida"))
    return out.withColumns(
        {
            "latitude": F.when(hit, F.col("_lat")).otherwise(F.col("latitude")),
            "longitude": F.when(hit, F.col("_lon")).otherwise(F.col("longitude")),
            "location_precision": F.when(hit, F.lit("street")).otherwise(F.col("location_precision")),
            "evidence": F.when(hit, F.array_append("evidence", proof)).otherwise(F.col("evidence")),
        }
    ).select(*promotions.columns)


def geocode_centroid(promotions: DataFrame, municipalities: DataFrame, now: Column) -> DataFrame:
    """Centroid of the place for rows without coordinates; located rows of unknown precision become exact."""
    centroids = municipalities.select(
        normalize_text(F.col("official_name")).alias("_place"), F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lon"), F.col("official_name").alias("_official"), "ord",
    ).groupBy("_place").agg(*[F.min_by(c, "ord").alias(c) for c in ("_lat", "_lon", "_official")])
    out = promotions.withColumn("_key", normalize_text(F.col("municipality")))
    out = out.join(broadcast_if_small(centroids, municipalities), F.col("_key") == F.col("_place"), "left")
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    placed = ~located & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    proof = _evidence(
        F.concat_ws(", ", "_lat", "_lon"), F.col("canonical_url"), now, "MunicipalityCentroidGeocoder", "0.55",
        "approximate", F.concat(F.lit("Centroide configurado de "), F.col("_official")),
    )
    precision = (
        F.when(placed, F.lit("municipalityCentroid"))
        .when(located & (F.col("location_precision") == "unknown"), F.lit("exactCoordinates"))
        .otherwise(F.col("location_precision"))
    )
    return out.withColumns(
        {
            "location_precision": precision,
            "warnings": F.when(placed, F.array_append("warnings", F.lit(V.WARN_CENTROID))).otherwise(F.col("warnings")),
            "evidence": F.when(placed, F.array_append("evidence", proof)).otherwise(F.col("evidence")),
            "latitude": F.when(placed, F.col("_lat")).otherwise(F.col("latitude")),
            "longitude": F.when(placed, F.col("_lon")).otherwise(F.col("longitude")),
        }
    ).select(*promotions.columns)


def geocode(promotions: DataFrame, municipalities: DataFrame, now: Column, cache: DataFrame | None = None) -> DataFrame:
    out = promotions if cache is None else geocode_from_cache(promotions, cache)
    return geocode_centroid(out, municipalities, now)


def spread_coincident_points(points: DataFrame, segment: Column) -> DataFrame:
    """Move points that share a position (5 decimals) onto a circle, in id order.

    A position may hold very many rows (every listing of a town on its centroid), so ranks are taken in
    ``segment`` slices that follow the id order, and the group size comes from an aggregate.
    """
    spots = points.where("latitude is not null and longitude is not null")
    spots = spots.withColumns({"_x": F.round("longitude", 5), "_y": F.round("latitude", 5)})
    sizes = spots.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    ranked = number_in_segments(spots, ["_x", "_y"], segment, [F.col("id")], "_i")
    ranked = attach_group_values(ranked, sizes, ["_x", "_y"], "_n", F.col("id"))
    together = F.col("_n") >= 2
    radius = F.least(F.lit(0.005), F.lit(0.0018) + F.col("_n") * F.lit(0.00025))
    angle = (F.lit(2 * math.pi) * (F.col("_i") - 1)) / F.col("_n") - F.lit(math.pi / 2)
    return ranked.withColumns(
        {
            "longitude": F.when(together, F.col("longitude") + F.cos(angle) * radius).otherwise(F.col("longitude")),
            "latitude": F.when(together, F.col("latitude") + F.sin(angle) * radius).otherwise(F.col("latitude")),
            "visually_spread": together,
        }
    ).drop("_x", "_y", "_n", "_i")
