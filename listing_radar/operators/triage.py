"""Review queue: duplicate masters, priority scores, per-domain totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions.scores import triage_band, triage_priority, triage_score
from listing_radar.functions.text import normalize_title
from listing_radar.operators.candidates import pending_only
from listing_radar.operators.scale import HEAVY_ROWS, attach_group_values


def duplicate_master(candidates: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Adds ``duplicate_of``: the best candidate of the same place and title (8 characters or more), null
    for that one itself. Best: highest confidence, first seen, id."""
    title = normalize_title(F.col("title"))
    rows = candidates.withColumns(
        {"_place": normalize_title(F.col("municipality")),
         "_title": F.when(F.length(title) >= V.MIN_DUPLICATE_TITLE_LENGTH, title)}
    )
    groups = rows.where("_title is not null").groupBy("_place", "_title").agg(
        F.min_by("id", F.struct(-F.col("confidence"), F.col("first_seen_utc"), F.col("id"))).alias("_master"),
        F.count(F.lit(1)).alias("_n"),
    ).where("_n > 1")
    out = attach_group_values(rows, groups, ["_place", "_title"], "_n", F.col("id"), heavy_rows)
    duplicate = F.when(F.col("_master") != F.col("id"), F.col("_master"))
    return out.withColumn("duplicate_of", duplicate).drop("_place", "_title", "_master", "_n")


def score_items(candidates: DataFrame, now: Column, excluded_hosts: Column) -> DataFrame:
    """Adds domain, band, priority, priority_score (0..100) and reasons; expects ``duplicate_of``."""
    out = candidates.withColumn(
        "_t",
        triage_score(
            F.col("title"), F.col("summary"), F.col("official_url"), F.col("municipality"), F.col("confidence"),
            F.col("matched_terms"), F.col("published_at_utc"), now, excluded_hosts,
        ),
    )
    duplicate = F.col("duplicate_of").isNotNull()
    reasons = F.col("_t.reasons")
    return out.withColumns(
        {
            "domain": F.col("_t.domain"),
            "band": F.when(duplicate, F.lit("possibleDuplicate")).otherwise(triage_band(reasons)),
            "priority": F.when(duplicate, F.lit("duplicate")).otherwise(triage_priority(F.col("_t.score"))),
            "priority_score": F.greatest(F.least(F.col("_t.score"), F.lit(100)), F.lit(0)),
            "reasons": F.when(duplicate, F.array_append(reasons, F.lit("possibleDuplicate"))).otherwise(reasons),
        }
    ).drop("_t")


def triage_order() -> list[Column]:
    rank = F.lit(len(V.PRIORITY_RANK))
    for name, position in V.PRIORITY_RANK.items():
        rank = F.when(F.col("priority") == name, F.lit(position)).otherwise(rank)
    return [rank.asc(), F.col("priority_score").desc(), F.col("domain"), F.col("municipality"), F.col("title"), F.col("id")]


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("priority") == "high").alias("high_priority"),
        F.count_if(F.col("priority") == "medium").alias("medium_priority"),
        F.count_if(F.col("priority") == "low").alias("low_priority"),
        F.count_if(F.col("priority") == "duplicate").alias("possible_duplicates"),
    ]


def triage_by_domain(items: DataFrame) -> DataFrame:
    return items.groupBy("domain").agg(*_counts()).orderBy(
        F.col("high_priority").desc(), F.col("candidates").desc(), F.col("domain"))


def triage_summary(items: DataFrame) -> DataFrame:
    return items.agg(*_counts())


def triage_items(candidates: DataFrame, now: Column, excluded_hosts: Column, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    return score_items(duplicate_master(pending_only(candidates), heavy_rows), now, excluded_hosts)
