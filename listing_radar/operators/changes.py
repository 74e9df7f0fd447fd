"""Comparison of a run with the previous snapshot: additions, field changes, absences, reactivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions import ids
from listing_radar.operators.scale import first_per_key, top_n_per_key


def _shown(c: Column) -> Column:
    """Value as text; equal numbers read the same whatever their scale."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _text(side: str, column: str, schema: dict[str, str]) -> Column:
    value = F.col(f"{side}.{column}")
    if schema[column].startswith("decimal") or schema[column] in ("double", "float"):
        return _shown(value)
    return value.cast("string")


def field_changes(schema: dict[str, str]) -> Column:
    """array<struct<field,previous_value,current_value>> of the tracked fields that differ, null-safe."""
    every = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"), _text("p", column, schema).alias("previous_value"),
                _text("c", column, schema).alias("current_value"),
            )
            for name, column in V.TRACKED_FIELDS.items()
            if column in schema and column != "active"
        ]
    )
    return F.filter(every, lambda f: ~f["previous_value"].eqNullSafe(f["current_value"]))


def state_diff(current: DataFrame, previous: DataFrame, now: Column, run_ok: bool | Column,
               misses: int = V.DEACTIVATE_AFTER_MISSES) -> DataFrame:
    """One full outer join on the id; both sides are unique, so no key can grow.

    Result: the columns of the snapshot (state columns updated) plus ``change_kind`` (null if nothing
    changed) and ``fields``. Rows that were not seen age only if every source of the run succeeded.
    """
    run_ok = F.lit(run_ok) if isinstance(run_ok, bool) else run_ok
    state = ["first_seen_utc", "last_seen_utc", "last_changed_utc", "consecutive_misses", "active"]
    facts = [c for c in previous.columns if c != "id" and c not in state]
    schema = dict(previous.dtypes)
    both = current.alias("c").join(previous.alias("p"), F.col("c.id") == F.col("p.id"), "full_outer")
    seen, old = F.col("c.id").isNotNull(), F.col("p.id").isNotNull()
    missed = F.when(run_ok, F.col("p.consecutive_misses") + 1).otherwise(F.col("p.consecutive_misses"))
    kept_active = F.when(run_ok, missed < misses).otherwise(F.col("p.active"))
    active = F.when(seen, F.lit(True)).otherwise(kept_active)
    flip = F.struct(
        F.lit("active").alias("field"),
        F.initcap(F.col("p.active").cast("string")).alias("previous_value"),
        F.initcap(active.cast("string")).alias("current_value"),
    )
    no_fields = F.array().cast("array<struct<field:string,previous_value:string,current_value:string>>")
    differing = F.when(seen & old, field_changes(schema)).otherwise(no_fields)
    flipped = F.when(old & (F.col("p.active") != active) & (seen | F.col("p.active")), F.array(flip)).otherwise(no_fields)
    fields = F.concat(differing, flipped)
    kind = (
        F.when(~old, F.lit("added"))
        .when(F.size(fields) == 0, F.lit(None))
        .when(~F.col("p.active") & active, F.lit("reactivated"))
        .when(F.col("p.active") & ~active, F.lit("deactivated"))
        .otherwise(F.lit("updated"))
    )
    return both.select(
        F.coalesce("c.id", "p.id").alias("id"),
        *[F.when(seen, F.col(f"c.{f}")).otherwise(F.col(f"p.{f}")).alias(f) for f in facts],
        F.coalesce("p.first_seen_utc", now).alias("first_seen_utc"),
        F.when(seen, now).otherwise(F.col("p.last_seen_utc")).alias("last_seen_utc"),
        F.when(kind.isNotNull(), now).otherwise(F.col("p.last_changed_utc")).alias("last_changed_utc"),
        F.when(seen, F.lit(0)).otherwise(missed).alias("consecutive_misses"),
        active.alias("active"),
        kind.alias("change_kind"),
        fields.alias("fields"),
        seen.alias("seen"),
    )


def changes_of(diff: DataFrame, now: Column) -> DataFrame:
    """Change rows of a diff, with their stable ids."""
    return diff.where("change_kind is not null").select(
        ids.change_id(F.col("id"), F.col("change_kind"), now).alias("id"),
        F.col("id").alias("promotion_id"), F.col("name").alias("promotion_name"),
        F.col("change_kind").alias("kind"), now.alias("detected_at_utc"), "fields",
    )


def absent_ids(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.select("id").join(current.select("id"), "id", "left_anti")


def append_changes(previous: DataFrame, new: DataFrame, limit: int = V.PUBLIC_CHANGE_LIMIT) -> DataFrame:
    """New changes before old ones, first per id, newest first, at most ``limit`` (the public log's size)."""
    ranked = new.withColumn("_age", F.lit(0)).unionByName(previous.withColumn("_age", F.lit(1)))
    firsts = first_per_key(ranked, ["id"], [F.col("_age")])
    return firsts.orderBy(F.col("detected_at_utc").desc(), F.col("_age"), F.col("id")).limit(limit).drop("_age")


def latest_changes(changes: DataFrame, limit: int) -> DataFrame:
    return changes.orderBy(F.col("detected_at_utc").desc(), F.col("id")).limit(limit)


def new_ids(promotions: DataFrame, changes: DataFrame, since: Column) -> DataFrame:
    """Listings added by the run that started at ``since``."""
    hits = changes.where((F.col("detected_at_utc") >= since) & (F.col("kind") == "added"))
    return promotions.join(hits.select(F.col("promotion_id").alias("id")), "id", "left_semi")


def changed_ids(promotions: DataFrame, changes: DataFrame, since: Column) -> DataFrame:
    """Listings the run updated, deactivated or reactivated."""
    hits = changes.where(
        (F.col("detected_at_utc") >= since) & F.col("kind").isin("updated", "deactivated", "reactivated")
    )
    return promotions.join(hits.select(F.col("promotion_id").alias("id")), "id", "left_semi")


def history(changes: DataFrame, per_promotion: int = 8) -> DataFrame:
    """Latest changes of every listing, as many as its detail view shows."""
    order = [F.col("detected_at_utc").desc(), F.col("id").asc()]
    return top_n_per_key(changes, ["promotion_id"], order, per_promotion, F.col("id"))
