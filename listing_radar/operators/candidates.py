"""Candidate state: feed-item limits, upsert into the previous state, reviews, orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions.text import contains_any_ci
from listing_radar.functions.urls import host_matches, host_of, is_absolute_url, is_https_url, path_of
from listing_radar.operators.matching import review_rule_status
from listing_radar.operators.scale import broadcast_if_small, first_per_key, top_n_per_key

CONTENT = ["source_id", "source_name", "source_kind", "external_id", "title", "summary", "official_url", "related_urls",
           "published_at_utc", "municipality", "kind", "confidence", "matched_terms"]


def enabled_sources(sources: DataFrame, source_id: str | None = None) -> DataFrame:
    """Sources that are switched on, or the one of the given id whatever its case, in ordinal order of the id."""
    wanted = F.lit(True) if source_id is None else F.lower("source_id") == source_id.lower()
    return sources.where(F.coalesce("enabled", F.lit(False)) & wanted).orderBy("source_id")


def valid_feed_items(items: DataFrame) -> DataFrame:
    return items.where((F.trim(F.coalesce("title", F.lit(""))) != "") & is_absolute_url(F.col("official_url")))


def item_key() -> Column:
    """External id, else the URL, whatever the case."""
    external = F.trim(F.coalesce("external_id", F.lit("")))
    return F.lower(F.when(external == "", F.col("official_url")).otherwise(F.col("external_id")))


#: This many items of a source are all of them.
NO_LIMIT = 2**31 - 1


def first_per_key_capped(items: DataFrame, max_items: int) -> DataFrame:
    """First item per source and key, then the first ``max_items`` of every source in input order. Without a limit nothing is ranked,
    so the items of a source do not meet in one task."""
    firsts = first_per_key(items.withColumn("_key", item_key()), ["source_id", "_key"], [F.col("seq")])
    if max_items >= NO_LIMIT:
        return firsts.drop("_key")
    return top_n_per_key(firsts, ["source_id"], [F.col("seq")], max_items, F.col("_key")).drop("_key")


def distinct_by_url_capped(items: DataFrame, per_query: int, total: int) -> DataFrame:
    """Search results: first N per query, then the first per URL, then the first ``total`` per source."""
    order = [F.col("query_no"), F.col("seq")]
    out = top_n_per_key(items, ["source_id", "query_no"], [F.col("seq")], per_query, F.col("seq"))
    out = first_per_key(out.withColumn("_url", F.lower("official_url")), ["source_id", "_url"], order)
    return top_n_per_key(out, ["source_id"], order, total, F.col("_url")).drop("_url")


def commercial_filter(items: DataFrame, sources: DataFrame) -> DataFrame:
    """https items whose host is one of their source's allowed hosts."""
    allowed = sources.select("source_id", F.explode("allowed_hosts").alias("_host")).select(
        "source_id", F.lower("_host").alias("_host")).distinct()
    hosted = items.where(is_https_url(F.col("official_url"))).withColumn("_host", host_of(F.col("official_url")))
    return hosted.join(broadcast_if_small(allowed, sources), ["source_id", "_host"], "left_semi").drop("_host")


def search_filter(items: DataFrame, excluded: Column) -> DataFrame:
    """https results with a place hint that lie on none of the excluded hosts (array) or below them."""
    url = F.col("official_url")
    hint = F.trim(F.coalesce("municipality_hint", F.lit(""))) != ""
    return items.where(hint & is_https_url(url) & ~host_matches(host_of(url), excluded))


def detail_url_filter(items: DataFrame, includes: Column, max_pages: int) -> DataFrame:
    """Items whose path contains one of the patterns; first ``max_pages`` per source."""
    kept = items.where(contains_any_ci(path_of(F.col("official_url")), includes))
    return top_n_per_key(kept, ["source_id"], [F.col("seq")], max_pages, F.col("seq"))


def sitemap_children(children: DataFrame, allowed_hosts: Column, includes: Column) -> DataFrame:
    """Child sitemaps to read: https, allowed host, one of the patterns if there are any."""
    url = F.col("url")
    wanted = (F.size(includes) == 0) | contains_any_ci(url, includes)
    return children.where(is_https_url(url) & F.array_contains(F.transform(allowed_hosts, F.lower), host_of(url)) & wanted)


def _fold_hits(matched: DataFrame, order: list[Column]) -> DataFrame:
    """All hits of one id in a run as one row. The status rule is a fold over the hits in order; it only
    depends on four facts, which partial aggregation can collect without gathering the hits."""
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    closed = F.col("status").isin(V.CLOSED_STATUSES)
    return matched.groupBy("id").agg(
        F.max_by(F.struct(*CONTENT), place).alias("_content"),
        F.min_by("first_seen_utc", place).alias("_first"),
        F.max_by("last_seen_utc", place).alias("_last"),
        F.bool_or(F.col("status") == "verifiedSource").alias("_verified"),
        F.min_by(F.when(closed, F.col("status")), F.when(closed, place)).alias("_closed"),
        F.bool_or(F.col("status") == "monitoring").alias("_monitoring"),
        F.count(F.lit(1)).alias("_hits"),
    )


def upsert_candidates(previous: DataFrame, matched: DataFrame, order: list[Column]) -> DataFrame:
    """Full outer join of state and hits. New content replaces old, first_seen stays, a verified hit
    always wins, and a closed candidate is not reopened. ``is_new`` and ``hits`` feed the run summary."""
    hits = _fold_hits(matched, order)
    prev = previous.select(
        F.col("id"), F.struct(*CONTENT).alias("_old"), F.col("status").alias("_status"),
        F.col("first_seen_utc").alias("_seen"), F.col("last_seen_utc").alias("_seen_last"),
    )
    both = prev.join(hits, "id", "full_outer")
    start = F.coalesce("_status", F.lit("new"))
    status = (
        F.when(F.col("_hits").isNull(), F.col("_status"))
        .when(F.col("_verified"), F.lit("verifiedSource"))
        .when(~start.isin(V.PENDING_STATUSES), start)
        .when(F.col("_closed").isNotNull(), F.col("_closed"))
        .when(F.col("_monitoring"), F.lit("monitoring"))
        .otherwise(start)
    )
    content = F.coalesce("_content", "_old")
    return both.select(
        "id", *[content[c].alias(c) for c in CONTENT],
        F.coalesce("_seen", "_first").alias("first_seen_utc"),
        F.coalesce("_last", "_seen_last").alias("last_seen_utc"),
        status.alias("status"),
        F.col("_status").isNull().alias("is_new"),
        F.coalesce("_hits", F.lit(0)).alias("hits"),
    )


def apply_configured_reviews(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Pending candidates take the status of the first review rule of their enabled source; ``reviewed``
    marks the changed ones."""
    rules = sources.where("enabled").select("source_id", F.col("review_rules").alias("_rules"))
    out = candidates.join(broadcast_if_small(rules), "source_id", "left")
    ruled = review_rule_status(F.col("official_url"), F.col("_rules"))
    changed = F.coalesce(F.col("status").isin(V.PENDING_STATUSES) & (ruled != F.col("status")), F.lit(False))
    return (
        out.withColumn("reviewed", changed)
        .withColumn("status", F.when(F.col("reviewed"), ruled).otherwise(F.col("status")))
        .drop("_rules")
        .select(*candidates.columns[:], "reviewed")
    )


def review_candidates(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set statuses by id. Returns the new state and the decisions that name no candidate."""
    # the last decision on a candidate counts; of simultaneous ones, or without times, the greatest status
    at = F.col("decided_at_utc") if "decided_at_utc" in decisions.columns else F.lit(None).cast("timestamp")
    last = F.max(F.struct(at.alias("at"), "status"))
    wanted = decisions.groupBy(F.col("candidate_id").alias("_id")).agg(last.alias("_last")).select("_id", F.col("_last.status").alias("_decision"))
    out = candidates.join(wanted, candidates["id"] == wanted["_id"], "left")
    out = out.withColumn("status", F.coalesce("_decision", "status")).select(*candidates.columns)
    return out, decisions.join(candidates.select(F.col("id").alias("candidate_id")), "candidate_id", "left_anti")


def candidate_order() -> list[Column]:
    return [F.col("municipality").asc(), F.col("published_at_utc").desc_nulls_last(), F.col("id").asc()]


def pending_only(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("status").isin(V.PENDING_STATUSES))


def observed_within(candidates: DataFrame, first: Column, last: Column) -> DataFrame:
    """Open candidates published (else last seen) inside a closed date range."""
    day = F.to_date(F.coalesce("published_at_utc", "last_seen_utc"))
    return candidates.where(~F.col("status").isin(V.CLOSED_STATUSES) & day.between(first, last))


def union_items(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
