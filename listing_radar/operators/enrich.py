"""Filling gaps from quoted evidence: what is missing, what to quote, what to accept, what to pay."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions import scores
from listing_radar.functions.ids import proposal_id
from listing_radar.functions.text import collapse_whitespace
from listing_radar.functions.urls import host_of
from listing_radar.operators.scale import (
    broadcast_if_small,
    top_n_per_key,
)
from listing_radar.session import cut_to_table

_COLUMNS = {**V.TEXT_FIELDS, **V.INTEGER_FIELDS, **V.DECIMAL_FIELDS}


def with_missing_fields(promotions: DataFrame) -> DataFrame:
    return promotions.withColumn("missing", scores.missing_fields({c: F.col(c) for c in promotions.columns}))


def eligible(promotions: DataFrame, promotion_id: str | None = None) -> DataFrame:
    out = with_missing_fields(promotions.where("active"))
    if promotion_id is not None:
        out = out.where(F.lower("id") == promotion_id.lower())
    return out.where(F.size("missing") > 0)


def enrichment_priority() -> list[Column]:
    """Least complete first."""
    return [F.size("missing").desc(), F.col("id").asc()]


def find_source_by_host(promotions: DataFrame, sources: DataFrame) -> DataFrame:
    """First source (catalog order) with the listing's host among its allowed hosts or as its base host;
    ``source_error`` is set where there is none."""
    hosts = sources.select(
        "ord", "source_id",
        F.explode(F.concat(F.transform("allowed_hosts", F.lower), F.array(host_of(F.col("base_url"))))).alias("_host"),
    ).where("_host != ''").groupBy("_host").agg(F.min_by("source_id", "ord").alias("source_id"))
    out = promotions.withColumn("_host", host_of(F.col("canonical_url"))).join(broadcast_if_small(hosts, sources), "_host", "left")
    return out.withColumn("source_error", F.col("source_id").isNull()).drop("_host")


# --- evidence ------------------------------------------------------------------------------------------

def chunk_scores(text: Column, keywords: Column) -> Column:
    """array<struct<start,score,text>>: overlapping chunks with the number of keywords they contain."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(V.CHUNK_STEP))
    chunks = F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.trim(F.substring(text, s + 1, F.lit(V.CHUNK_LENGTH))).alias("text")),
    )

    def score(chunk: Column) -> Column:
        low = F.lower(chunk["text"])
        hits = F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
        return F.struct(chunk["start"].alias("start"), hits.alias("score"), chunk["text"].alias("text"))

    return F.transform(F.filter(chunks, lambda c: c["text"] != ""), score)


def _taken(chunks: Column, length: Column) -> Column:
    """The first chunks that fit into ``length`` with separators between them; the last one is cut."""
    separator = len(V.CHUNK_SEPARATOR)
    empty = F.struct(
        F.lit(0).alias("used"), F.array().cast("array<struct<start:int,text:string>>").alias("chosen"))

    def take(acc: Column, chunk: Column) -> Column:
        gap = F.when(F.size(acc["chosen"]) == 0, F.lit(0)).otherwise(F.lit(separator))
        room = length - acc["used"] - gap
        value = F.left(chunk["text"], room)
        taken = F.struct(
            (acc["used"] + gap + F.length(value)).alias("used"),
            F.concat(acc["chosen"], F.array(F.struct(chunk["start"].alias("start"), value.alias("text")))).alias("chosen"),
        )
        return F.when(room <= 0, acc).otherwise(taken)

    return F.aggregate(chunks, empty, take)["chosen"]


def best_chunks(text: Column, keywords: Column) -> Column:
    """array<struct<start,text>>: the chunks that a page can show at most, best first."""
    ranked = F.transform(
        F.array_sort(
            F.transform(
                chunk_scores(text, keywords),
                lambda c: F.struct((-c["score"]).alias("o"), c["start"].alias("start"), c["text"].alias("text")),
            )
        ),
        lambda c: F.struct(c["start"].alias("start"), c["text"].alias("text")),
    )
    return _taken(ranked, F.lit(V.PAGE_EVIDENCE_LENGTH))


def evidence_snippets(pages: DataFrame, max_pages: int, budget: int) -> DataFrame:
    """Evidence of every listing: (promotion_id, fetched_at, pages array<struct<url,text>>).

    ``pages``: promotion_id, url, text, fetched_at, keywords. Whole texts are read where they stand: a page leaves its task as its
    best chunks (and as itself, if short), which no budget exceeds, so full texts are not shuffled. At most ``max_pages`` pages per
    listing are used (the setting of a run); the character budget is spent page by page in URL order. A page that fits is shown
    whole, else its best chunks in reading order.
    """
    clean = pages.withColumn("text", collapse_whitespace(F.col("text")))
    short = F.when(F.length("text") <= V.PAGE_EVIDENCE_LENGTH, F.col("text"))
    shown = clean.select("promotion_id", "url", "fetched_at", (F.col("text") != "").alias("some"), short.alias("whole"),
                         best_chunks(F.col("text"), F.col("keywords")).alias("chunks"))
    few = top_n_per_key(shown, ["promotion_id"], [F.col("url")], max_pages, F.col("url"))
    grouped = few.groupBy("promotion_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("some"), F.struct("url", "whole", "chunks")))).alias("_pages"),
        F.max("fetched_at").alias("fetched_at"))
    start = F.struct(
        F.lit(budget).alias("left"), F.array().cast("array<struct<url:string,text:string>>").alias("kept"))

    def take(acc: Column, page: Column) -> Column:
        room = F.least(acc["left"], F.lit(V.PAGE_EVIDENCE_LENGTH))
        best = F.array_join(F.transform(F.array_sort(_taken(page["chunks"], room)), lambda c: c["text"]), V.CHUNK_SEPARATOR)
        text = F.when(F.length(page["whole"]) <= room, page["whole"]).otherwise(best)
        kept = F.concat(acc["kept"], F.array(F.struct(page["url"].alias("url"), text.alias("text"))))
        return F.when(acc["left"] <= 0, acc).otherwise(
            F.struct((acc["left"] - F.length(text)).alias("left"), kept.alias("kept")))

    return grouped.select("promotion_id", "fetched_at", F.aggregate("_pages", start, take)["kept"].alias("pages"))


# --- proposals -----------------------------------------------------------------------------------------

def _fillable_value(field: Column, value: Column) -> Column:
    number = F.trim(F.regexp_replace(value, ",", ""))
    whole = field.isin(list(V.INTEGER_FIELDS)) & ~F.coalesce(F.trim(value).try_cast("int") >= 0, F.lit(False))
    exact = field.isin(list(V.DECIMAL_FIELDS)) & ~F.coalesce(number.try_cast("decimal(28,6)") >= 0, F.lit(False))
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    return ~(blank | (F.length(value) > V.MAX_VALUE_LENGTH) | whole | exact)


def validate_proposals(proposals: DataFrame, evidence: DataFrame, missing: DataFrame,
                       minimum: str = V.MIN_PROPOSAL_CONFIDENCE) -> DataFrame:
    """Adds ``reject_reason`` (null = kept), the first of: notAllowed, lowConfidence, noQuote,
    invalidValue, duplicate. The first good proposal of a field wins, in ``ord`` order.

    ``evidence``: promotion_id, url, text. ``missing``: promotion_id, missing (array).
    """
    texts = evidence.select("promotion_id", F.col("url").alias("source_url"), F.lower(collapse_whitespace(F.col("text"))).alias("_page"))
    # plain joins on keys of a handful of rows each; a key of very many is split by the engine's own skew join
    out = proposals.join(missing.select("promotion_id", "missing"), "promotion_id", "left").join(texts, ["promotion_id", "source_url"], "left")
    quote = F.lower(collapse_whitespace(F.col("evidence_text")))
    field = F.col("field")
    reason = (
        F.when(~field.isin(V.FILLABLE_FIELDS) | ~F.coalesce(F.array_contains("missing", field), F.lit(False)), F.lit("notAllowed"))
        .when(F.col("confidence") < F.lit(minimum).cast("decimal(5,2)"), F.lit("lowConfidence"))
        .when(F.col("_page").isNull() | (quote == "") | ~F.col("_page").contains(quote), F.lit("noQuote"))
        .when(~_fillable_value(field, F.col("value_text")), F.lit("invalidValue"))
    )
    out = out.withColumn("_reason", reason).drop("_page", "missing")
    firsts = out.where("_reason is null").groupBy("promotion_id", "field").agg(F.min("ord").alias("_first"))
    duplicate = F.when(F.col("ord") > F.col("_first"), F.lit("duplicate"))
    out = out.join(firsts, ["promotion_id", "field"], "left")
    return out.select(*proposals.columns, F.coalesce("_reason", duplicate).alias("reject_reason"))


def latest_per_promotion(df: DataFrame, time: str, tie: str) -> DataFrame:
    """Newest row of every listing by a map-side combined maximum."""
    columns = [c for c in df.columns if c != "promotion_id"]
    best = F.max_by(F.struct(*columns), F.struct(time, tie))
    return df.groupBy("promotion_id").agg(best.alias("_row")).select("promotion_id", "_row.*").select(*df.columns)


def accepted_still_valid(proposals: DataFrame, now: Column) -> DataFrame:
    """Field rows of accepted, reviewed proposals with fresh evidence. A proposal without any field review
    counts as accepted as a whole (``legacy``). Input: one row per proposal with a ``fields`` array."""
    fresh = now <= F.col("evidence_fetched_at") + F.expr(f"interval {V.ACCEPTED_MAX_AGE_DAYS} days")
    valid = proposals.where((F.col("status") == "accepted") & F.col("reviewed_at").isNotNull() & fresh)
    legacy = F.forall("fields", lambda f: (f["status"] == "pending") & f["reviewed_at"].isNull())
    rows = valid.withColumn("legacy", legacy).select(
        "proposal_id", "promotion_id", "reviewed_at", "evidence_fetched_at", "legacy",
        F.posexplode("fields").alias("ord", "f"))
    return rows.where(F.col("legacy") | (F.col("f.status") == "accepted")).select(
        "proposal_id", "promotion_id", "reviewed_at", "evidence_fetched_at", "ord", F.col("f.field").alias("field"),
        F.col("f.value_text").alias("value_text"), F.col("f.source_url").alias("source_url"),
        F.col("f.evidence_text").alias("evidence_text"), F.col("f.confidence").alias("confidence"))


def apply_accepted(promotions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Fill null facts from accepted fields and append their evidence; a value that is there stays.

    ``accepted`` has the rows of one proposal per listing, at most one per field of the fixed list.
    """
    at = F.struct("field", "value_text", "source_url", "evidence_text", "confidence", "evidence_fetched_at")
    facts = accepted.groupBy("promotion_id").agg(
        *[F.min_by(F.when(F.col("field") == name, at), F.when(F.col("field") == name, F.col("ord"))).alias(f"_{name}")
          for name in V.FILLABLE_FIELDS])
    out = promotions.join(facts, promotions["id"] == facts["promotion_id"], "left")
    filled, proofs = {}, []
    for name in V.FILLABLE_FIELDS:
        column, fact = _COLUMNS[name], F.col(f"_{name}")
        kind = "int" if name in V.INTEGER_FIELDS else "decimal(14,2)" if name in V.DECIMAL_FIELDS else "string"
        text = F.regexp_replace(fact["value_text"], ",", "") if kind != "string" else fact["value_text"]
        value = text.try_cast(kind)
        use = F.col(column).isNull() & value.isNotNull()
        filled[column] = F.coalesce(F.col(column), value)
        proofs.append(F.when(use, F.struct(
            fact["field"].alias("field"), fact["value_text"].alias("value_text"), fact["source_url"].alias("source_url"),
            fact["evidence_fetched_at"].alias("captured_at_utc"), F.lit("reviewed-ai-enrichment").alias("extractor"),
            fact["confidence"].cast("decimal(5,2)").alias("confidence"), F.lit("explicit").alias("quality"),
            fact["evidence_text"].alias("text_fragment"))))
    evidence = F.concat("evidence", F.array_compact(F.array(*proofs)))
    return out.withColumns({**filled, "evidence": evidence}).select(*promotions.columns)


def cache_skip(queue: DataFrame, proposals: DataFrame) -> DataFrame:
    """Adds ``cached``: the newest proposal of the listing was made from the same content."""
    newest = latest_per_promotion(
        proposals.select("promotion_id", "generated_at", "proposal_id", "content_hash"), "generated_at", "proposal_id")
    newest = newest.select("promotion_id", F.col("content_hash").alias("_hash"))
    out = queue.join(newest, "promotion_id", "left")
    return out.withColumn("cached", F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))).drop("_hash")


#: Ranges into which a queue is cut for the search of the next item that fits, for each shuffle partition of the session.
RANGES_PER_PARTITION = 4


def budget_admission(queue: DataFrame, order: list[str], cost: str, max_cost: Decimal, max_calls: int, used: str | None = None) -> DataFrame:
    """Adds ``decision``: cached, admitted, overBudget, or notReached after the last allowed call.

    In queue order an item whose reserve (``cost``) would exceed the budget is passed over and smaller ones are still tried. Once a call has
    ended, its reserve is replaced by what it has ``used``; without that column the reserve stays spent.

    The queue is sorted once into ranges, of which the driver knows the least reserve. A range without an item that fits is skipped unread;
    only fitting rows, at most ``max_calls`` (a setting of the run), come to the driver. ``order`` must tell all rows apart.
    """
    types = {c: queue.schema[c].dataType for c in order}
    count = RANGES_PER_PARTITION * int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = queue.repartitionByRange(count, *order).sortWithinPartitions(*order)
    rows = cut_to_table(ranges.withColumn("_range", F.spark_partition_id()))
    open_rows = rows.where(~F.col("cached"))
    least = sorted((r["_range"], r.least) for r in open_rows.groupBy("_range").agg(F.min(cost).alias("least")).collect() if r.least is not None)
    place, wanted = F.struct(*order), list(dict.fromkeys([*order, cost, used or cost]))

    def position(row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in order])

    spent, chosen = Decimal(0), []
    for number, smallest in least:
        after = None
        while len(chosen) < max_calls and spent + smallest <= max_cost:
            fitting = open_rows.where((F.col("_range") == number) & (F.col(cost) <= F.lit(max_cost - spent)))
            if after is not None:
                fitting = fitting.where(place > position(after))
            batch = fitting.orderBy(*order).limit(max_calls - len(chosen)).select(*wanted).collect()
            for row in batch:
                if spent + row[cost] > max_cost:
                    break  # look again, from here on, for what still fits
                after = row
                spent += row[cost] if used is None or row[used] is None else row[used]
                chosen.append(row)
            else:
                break  # nothing else in this range fits
            after = row
    schema = rows.select(*order).schema
    winners = rows.sparkSession.createDataFrame([tuple(r[c] for c in order) for r in chosen], schema)
    out = rows.join(F.broadcast(winners.withColumn("_in", F.lit(True))), order, "left")
    ended = place > position(chosen[-1]) if len(chosen) == max_calls and chosen else F.lit(False)
    decision = (
        F.when(ended, F.lit("notReached"))
        .when(F.col("cached"), F.lit("cached"))
        .when(F.col("_in"), F.lit("admitted"))
        .otherwise(F.lit("overBudget"))
    )
    return out.withColumn("decision", decision).select(*queue.columns, "decision")


def usage_totals(proposals: DataFrame) -> DataFrame:
    measures = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens",
                "total_tokens", "estimated_cost_usd"]
    return proposals.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


# --- review --------------------------------------------------------------------------------------------

def proposal_status(pending: Column, accepted: Column) -> Column:
    return F.when(pending, F.lit("pending")).when(accepted, F.lit("accepted")).otherwise(F.lit("rejected"))


def statuses_from_fields(fields: DataFrame) -> DataFrame:
    """Status of each proposal from its field rows."""
    return fields.groupBy("proposal_id").agg(
        proposal_status(F.bool_or(F.col("field_status") == "pending"),
                        F.bool_or(F.col("field_status") == "accepted")).alias("status"))


def apply_field_review(fields: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply accepted/rejected decisions to field rows; returns (field rows, refused decisions).

    A decision without a field needs a proposal with exactly one pending field. Stale proposals, unknown
    proposals and unknown fields are refused with a reason.

    Field rows and decisions are stacked and meet in one shuffle and one sort; what is told of a field or proposal is a window over
    its few rows. The hash before the key spares the sort comparing ids that begin alike.
    """
    asks = decisions.select("proposal_id", "field", F.col("decision").alias("_decision"), F.col("seq").alias("_seq"), F.lit(True).alias("_asks"))
    rows = fields.where("proposal_id is not null").withColumn("_asks", F.lit(False)).unionByName(asks, allowMissingColumns=True)
    rows = rows.withColumn("_hash", F.xxhash64("proposal_id")).repartition("_hash", "proposal_id")  # serves the windows by field too
    proposal, named = Window.partitionBy("_hash", "proposal_id"), Window.partitionBy("_hash", "proposal_id", "field")
    is_field, pending = ~F.col("_asks"), F.col("field_status") == "pending"
    allowed = F.coalesce(F.col("_decision").isin("accepted", "rejected"), F.lit(False))
    decision = F.when(F.col("_asks") & allowed, F.struct("_seq", "_decision"))
    rows = rows.withColumns({"_known": F.bool_or(is_field).over(named), "_named": F.max(decision).over(named)})
    rows = rows.withColumns({
        "_pending": F.count_if(is_field & pending).over(proposal),
        "_single": F.count_if(is_field & pending & F.col("field").isNotNull()).over(proposal),
        "_stale": F.bool_or(F.when(is_field, F.col("proposal_status") == "stale")).over(proposal),
        "_unnamed": F.max(F.when(F.col("field").isNull(), decision)).over(proposal),
    })
    sole = (F.col("_pending") == 1) & (F.col("_single") == 1)
    reason = (
        F.when(~allowed, F.lit("decisionNotAllowed"))
        .when(F.col("_stale").isNull(), F.lit("unknownProposal"))
        .when(F.col("_stale"), F.lit("staleProposal"))
        .when(F.col("field").isNull(), F.when(F.col("_pending") == 0, F.lit("nothingPending")).when(~sole, F.lit("fieldNeeded")))
        .when(~F.col("_known"), F.lit("unknownField"))
    )
    refused = rows.where("_asks").withColumn("reason", reason).where("reason is not null")

    last = F.greatest(F.when(F.col("field").isNotNull(), F.col("_named")), F.when(pending & sole, F.col("_unnamed")))
    out = rows.withColumn("_last", F.when(is_field & ~F.col("_stale"), last))
    status = F.coalesce("_last._decision", "field_status")
    out = out.withColumns({
        "_touched": F.bool_or(F.col("_last").isNotNull()).over(proposal),
        "_status": proposal_status(F.bool_or(is_field & (status == "pending")).over(proposal),
                                   F.bool_or(is_field & (status == "accepted")).over(proposal)),
    }).where(is_field).withColumns({
        "field_status": status,
        "field_reviewed_at": F.when(F.col("_last").isNotNull(), now).otherwise(F.col("field_reviewed_at")),
        "proposal_status": F.when(F.col("_touched"), F.col("_status")).otherwise(F.col("proposal_status")),
        "proposal_reviewed_at": F.when(F.col("_touched"), now).otherwise(F.col("proposal_reviewed_at")),
    })
    return out.select(*fields.columns), refused.select("proposal_id", "field", F.col("_decision").alias("decision"), "reason")


def review_field_counts(fields: DataFrame) -> DataFrame:
    """Field rows by effective status: a reviewed proposal without any field review lends its own."""
    unreviewed = (F.col("field_status") == "pending") & F.col("field_reviewed_at").isNull()
    legacy = fields.groupBy("proposal_id").agg(
        (F.bool_and(unreviewed) & F.first(F.col("proposal_reviewed_at").isNotNull())).alias("_legacy"))
    rows = fields.join(legacy, "proposal_id")
    effective = F.when(F.col("_legacy"), F.col("proposal_status")).otherwise(F.col("field_status"))
    return rows.groupBy(effective.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def review_queue_order() -> list[Column]:
    return [F.when(F.col("status") == "pending", 0).otherwise(1).asc(), F.col("generated_at").desc(),
            F.upper("promotion_name").asc(), F.col("proposal_id").asc()]


def mark_stale_and_upsert(proposals: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The newest proposal of a listing, if accepted, goes stale when its content changed; a new
    proposal replaces one of the same id."""
    newest = latest_per_promotion(proposals.select("promotion_id", "generated_at", "proposal_id"), "generated_at", "proposal_id")
    fresh = new.groupBy("promotion_id").agg(F.max("content_hash").alias("_hash"))
    outdated = newest.join(fresh, "promotion_id").select("proposal_id", "_hash")
    out = proposals.join(outdated, "proposal_id", "left")
    stale = (F.col("status") == "accepted") & (F.col("_hash") != F.col("content_hash"))
    out = out.withColumns(
        {
            "reviewed_at": F.when(stale, now).otherwise(F.col("reviewed_at")),
            "status": F.when(stale, F.lit("stale")).otherwise(F.col("status")),
        }
    ).select(*proposals.columns)
    kept = out.join(new.select("proposal_id"), "proposal_id", "left_anti").select(*proposals.columns)
    return kept.unionByName(new.select(*proposals.columns))


def last_runs(runs: DataFrame, keep: int = 100) -> DataFrame:
    """Run history as long as the state keeps it."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(keep)


Proposer = Callable[[DataFrame], DataFrame]
