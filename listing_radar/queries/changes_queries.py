"""Comparison of snapshots, change logs."""

from pyspark.sql import functions as F

from listing_radar.operators import changes as K, quality as Q
from listing_radar.queries.logical import NOW
from listing_radar.queries.registry import duck_ts, query, shared, ts

_TRACKED = [("priceFrom", "price_from"), ("priceTo", "price_to"), ("commercialStatus", "commercial_status"), ("constructionStatus", "construction_status"),
            ("availableUnits", "available_units"), ("deliveryDateText", "delivery_date_text"), ("builtAreaMinSqm", "built_area_min_sqm"),
            ("builtAreaMaxSqm", "built_area_max_sqm"), ("plotAreaMinSqm", "plot_area_min_sqm"), ("plotAreaMaxSqm", "plot_area_max_sqm")]
_DIFF_FIELDS = " || ".join(f"case when c.id is not null and p.id is not null and c.{b} is distinct from p.{b} then '{a},' else '' end" for a, b in _TRACKED)


def _diff_sql(run_ok: bool) -> str:
    missed = "p.consecutive_misses + 1" if run_ok else "p.consecutive_misses"
    kept = f"{missed} < 3" if run_ok else "p.active"
    return f"""with j as (select coalesce(c.id, p.id) as id, coalesce(c.name, p.name) as name, c.id is not null as seen, p.id is not null as old, p.active as was, coalesce(c.municipality, p.municipality) as municipality,
      case when c.id is not null then true else {kept} end as active, case when c.id is not null then 0 else {missed} end as misses, {_DIFF_FIELDS} as f, p.first_seen_utc as fs, p.last_changed_utc as lc, p.last_seen_utc as ls
      from promotions c full join previous_promotions p on c.id = p.id),
     k as (select *, f || case when old and was <> active and (seen or was) then 'active,' else '' end as fields from j)
     select id, name, municipality, seen, active, misses, fields, case when not old then 'added' when fields = '' then null when not was and active then 'reactivated' when was and not active then 'deactivated' else 'updated' end as kind,
      coalesce(fs, timestamp '{NOW}') as first_seen, case when seen then timestamp '{NOW}' else ls end as last_seen, lc from k"""


shared(diff=_diff_sql(True), diff_partial=_diff_sql(False))


def now():
    return F.lit(NOW).cast("timestamp")


def snapshots(t):
    previous = t.previous_promotions
    return t.promotions.select(*previous.columns), previous


def diff(t, run_ok=True):
    return K.state_diff(*snapshots(t), now(), run_ok)


def _shown(rows):
    fields = F.concat(F.array_join(F.transform("fields", lambda f: f["field"]), ","), F.when(F.size("fields") > 0, F.lit(",")).otherwise(F.lit("")))
    return rows.select("id", "seen", "active", F.col("consecutive_misses").alias("misses"), fields.alias("fields"), F.col("change_kind").alias("kind"), ts("first_seen_utc", "first_seen"), ts("last_seen_utc", "last_seen"))


_SHOW = f"select id, seen, active, misses, fields, kind, {duck_ts('first_seen')} as first_seen, {duck_ts('last_seen')} as last_seen from "


@query("state_diff", _SHOW + "diff")
def _(t):
    return _shown(diff(t))


@query("state_diff_partial_run", _SHOW + "diff_partial")
def _(t):
    """A run with a failed source: absent listings do not age."""
    return _shown(diff(t, False))


@query("detect_changes", """select id as promotion_id, 'change-' || left(sha256(id || '|' || upper(left(kind, 1)) || substr(kind, 2) || '|2024-02-01T00:00:00.0000000+00:00'), 16) as id, kind,
  len(string_split(rtrim(fields, ','), ',')) * cast(fields <> '' as int) as n from diff where kind is not null""")
def _(t):
    rows = K.changes_of(diff(t), now())
    return rows.select("promotion_id", "id", "kind", F.size("fields").alias("n"))


@query("price_changes", """select c.id, cast(p.price_from as double) as before, cast(c.price_from as double) as after from promotions c join previous_promotions p on c.id = p.id where c.price_from is distinct from p.price_from""")
def _(t):
    rows = K.changes_of(diff(t), now()).select("promotion_id", F.inline("fields")).where("field = 'priceFrom'")
    return rows.select(F.col("promotion_id").alias("id"), F.col("previous_value").cast("double").alias("before"), F.col("current_value").cast("double").alias("after"))


@query("changed_by_municipality", "select municipality, count(*) as n from diff where kind is not null group by 1")
def changed_by_municipality(t):
    """What changed since the last run, per place: one diff join and one aggregate."""
    return Q.by_municipality(diff(t).where("change_kind is not null"))


@query("absent_ids", "select id from previous_promotions where id not in (select id from promotions)")
def _(t):
    current, previous = snapshots(t)
    return K.absent_ids(previous, current)


_LOG = "select 'c-' || cast(event_id as varchar) as id, 'p-' || cast(user_id as varchar) as promotion_id, case event_type when 'signup' then 'added' when 'error' then 'deactivated' when 'view' then 'reactivated' else 'updated' end as kind, ts as detected from events"
shared(change_log=_LOG)


def log(t):
    kind = F.expr("case event_type when 'signup' then 'added' when 'error' then 'deactivated' when 'view' then 'reactivated' else 'updated' end")
    no_fields = F.array().cast("array<struct<field:string,previous_value:string,current_value:string>>")
    return t.events.select(F.concat(F.lit("c-"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("p-"), F.col("user_id").cast("string")).alias("promotion_id"),
                           F.lit("x").alias("promotion_name"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("detected_at_utc"), no_fields.alias("fields"))


@query("append_changes", f"""with a as (select *, 0 as age from change_log where detected >= timestamp '2024-01-15' union all select *, 1 from change_log where detected < timestamp '2024-01-20'),
  r as (select *, row_number() over (partition by id order by age) as rn from a) select id, {duck_ts('detected')} as detected from r where rn = 1 order by r.detected desc, age, id limit 5000""")
def _(t):
    rows = log(t)
    out = K.append_changes(rows.where("detected_at_utc < timestamp'2024-01-20'"), rows.where("detected_at_utc >= timestamp'2024-01-15'"))
    return out.select("id", ts("detected_at_utc", "detected"))


@query("latest_changes", "select id from change_log order by detected desc, id limit 100")
def _(t):
    return K.latest_changes(log(t), 100).select("id")


_LISTED = "(select distinct 'p-' || cast(user_id as varchar) as id from events)"


@query("new_ids", f"select id from {_LISTED} where id in (select promotion_id from change_log where detected >= timestamp '2024-01-29 22:00:00' and kind = 'added')")
def _(t):
    rows = log(t)
    return K.new_ids(rows.select(F.col("promotion_id").alias("id")).distinct(), rows, F.lit("2024-01-29 22:00:00").cast("timestamp"))


@query("changed_ids", f"select id from {_LISTED} where id in (select promotion_id from change_log where detected >= timestamp '2024-01-29 22:00:00' and kind <> 'added')")
def _(t):
    rows = log(t)
    return K.changed_ids(rows.select(F.col("promotion_id").alias("id")).distinct(), rows, F.lit("2024-01-29 22:00:00").cast("timestamp"))


@query("promotion_history", "select id, promotion_id from (select *, row_number() over (partition by promotion_id order by detected desc, id) as rn from change_log) where rn <= 8")
def _(t):
    return K.history(log(t)).select("id", "promotion_id")
