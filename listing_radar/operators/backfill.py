"""Requests a source needs for a date range, and backfills in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar.functions.dates import batch_ranges, dated_url, expand_dates
from listing_radar.functions.urls import escape_data
from listing_radar.operators.candidates import upsert_candidates
from listing_radar.operators.scale import broadcast_if_small, first_per_key


#: Templates that one place meets at a time.
TEMPLATES = 1_000


def search_matrix(municipalities: DataFrame, sources: DataFrame) -> DataFrame:
    """Every enabled place with every query template of every search source. The templates are dealt into lists, of which each place
    meets one after the other; one list if they are few."""
    templates = sources.select(
        "source_id", "url_template", F.posexplode("search_query_templates").alias("template_no", "template"))
    lists = max(1, -(-templates.count() // TEMPLATES))
    dealt = templates.withColumn("_list", F.pmod(F.xxhash64("source_id", "template_no"), F.lit(lists)))
    places = municipalities.where("enabled").select("official_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))).alias("_list"))
    rows = places.join(broadcast_if_small(dealt), "_list")
    query = F.replace("template", F.lit("{municipality}"), F.col("official_name"))
    return rows.select(
        "source_id", "official_name", "template_no", query.alias("query"),
        F.replace("url_template", F.lit("{query}"), escape_data(query)).alias("url"),
    )


def dated_urls(sources: DataFrame, first: Column, last: Column) -> DataFrame:
    """One request URL per date of the cadence; a URL that does not change with the date is read once."""
    days = sources.select("source_id", "url_template", F.explode(expand_dates(first, last, F.col("cadence"))).alias("day"))
    rows = days.withColumn("url", dated_url(F.col("url_template"), F.col("day")))
    return first_per_key(rows.select("source_id", "url", "day"), ["source_id", "url"], [F.col("day")])


def plan_batches(ranges: DataFrame, days: int) -> DataFrame:
    """Contiguous batches of every (source_id, first_day, last_day)."""
    return ranges.select("source_id", F.inline(batch_ranges(F.col("first_day"), F.col("last_day"), days)))


def tag_batches(items: DataFrame, first_day: Column, days: int) -> DataFrame:
    """Batch number of every item from its date: arithmetic instead of a range join."""
    return items.withColumn("batch", F.floor(F.datediff(F.to_date("published_at_utc"), first_day) / days).cast("int") + 1)


def without_failed(matched: DataFrame, batches: DataFrame) -> DataFrame:
    """Hits (source_id, batch, ..) but for those of failed batches (source_id, batch, success)."""
    failed = batches.where(~F.coalesce("success", F.lit(False))).select("source_id", "batch").distinct()
    return matched.join(broadcast_if_small(failed, batches), ["source_id", "batch"], "left_anti")


def backfill(previous: DataFrame, matched: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """All batches over the same state in one pass; hits fold in (batch, seq) order. Hits of a batch that failed, as ``batches``
    (source_id, batch, success) says, leave no trace; later batches go on."""
    hits = matched if batches is None else without_failed(matched, batches)
    return upsert_candidates(previous, hits, [F.col("batch"), F.col("seq")])


def batch_results(previous: DataFrame, matched: DataFrame, batches: DataFrame) -> DataFrame:
    """Per batch (source_id, batch, success, items_read): what was matched, new (first met there) and updated (every other hit).
    A failed batch has read and matched nothing."""
    hits = without_failed(matched, batches)
    found = hits.groupBy("source_id", "batch").agg(F.count(F.lit(1)).alias("candidates_matched"))
    firsts = hits.groupBy("id").agg(F.min_by("source_id", F.struct("batch", "seq")).alias("source_id"), F.min("batch").alias("batch"))
    new = firsts.join(previous.select("id"), "id", "left_anti").groupBy("source_id", "batch").agg(F.count(F.lit(1)).alias("new_candidates"))
    out = batches.join(found, ["source_id", "batch"], "left").join(new, ["source_id", "batch"], "left").na.fill(0, ["candidates_matched", "new_candidates"])
    out = out.withColumn("items_read", F.when(F.col("success"), F.col("items_read")).otherwise(0))
    return out.withColumn("updated_candidates", F.col("candidates_matched") - F.col("new_candidates"))


def backfill_report(batches: DataFrame) -> DataFrame:
    return batches.groupBy("source_id").agg(
        F.bool_and("success").alias("complete"), F.sum("items_read").alias("items_read"),
        F.sum("candidates_matched").alias("candidates_matched"), F.sum("new_candidates").alias("new_candidates"),
        F.sum("updated_candidates").alias("updated_candidates"), F.count(F.lit(1)).alias("batches"),
    )
