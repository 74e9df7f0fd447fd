"""Listings: normalization, checks, figures, coordinates, explorer."""

import math

from pyspark.sql import functions as F

from listing_radar import fixed_values as V
from listing_radar.functions import ids, scores
from listing_radar.operators import explore as E, geo as G, quality as Q
from listing_radar.plans.promotions import empty_facts, normalize_promotions
from listing_radar.operators.scale import place_in_order
from listing_radar.queries.logical import NOW
from listing_radar.queries.registry import duck_norm, duck_ts, num, query, shared, ts
from listing_radar.sinks import tables as S


def now():
    return F.lit(NOW).cast("timestamp")


def full(t):
    """Listings with all columns of the published table."""
    return empty_facts(t.promotions)


@query("municipality_filter", "select id from promotions where lower(municipality) = 'nation_7'")
def _(t):
    return E.municipality_filter(t.promotions, "nation_7").select("id")


_BASES = "case source_kind when 'officialPromoter' then 0.82 when 'officialMicrosite' then 0.80 when 'publicAuthority' then 0.78 when 'cooperativeManager' then 0.72 when 'exclusiveMarketer' then 0.68 when 'builder' then 0.68 else 0.45 end"


@query("source_confidence", f"""with s as (select id, {_BASES} as base, {_BASES} + case when brochures > 0 then 0.05 else 0 end + case when developer_name is not null then 0.04 else 0 end + case when evidence_count >= 4 then 0.04 else 0 end
    + case when site % 3 = 0 then 0.05 else 0 end as total, 1 + cast(brochures > 0 as int) + cast(developer_name is not null as int) + cast(evidence_count >= 4 as int) + cast(site % 3 = 0 as int) as n from promotions)
  select id, cast(least(total, 1) as double) as score, n as signals from s""")
def _(t):
    s = scores.source_confidence(F.col("source_kind"), F.col("brochures"), F.col("developer_name"), F.col("evidence_count"), F.col("site") % 3 == 0)
    return t.promotions.withColumn("s", s).select("id", F.col("s.final_score").cast("double").alias("score"), F.size("s.signals").alias("signals"))


@query("normalize_promotions", f"""select id, trim(name) as name, {duck_norm('name')} as normalized_name, 'https://www.site' || cast(site as varchar) || '.example.org/p/' || cast(row_id as varchar) as url,
  cast(least({_BASES} + case when developer_name is not null then 0.04 else 0 end + case when site % 3 = 0 then 0.05 else 0 end, 1) as double) as score, 1 as urls from promotions""")
def _(t):
    sources = t.promotions.select("site").distinct().select(F.col("site").cast("string").alias("source_id"), F.array(
        F.when(F.col("site") % 3 == 0, F.concat(F.lit("https://www.site"), F.col("site").cast("string"), F.lit(".example.org/"))).otherwise("https://none.example.org/")).alias("start_urls"))
    rows = full(t).withColumn("source_id", F.col("site").cast("string"))
    messy = F.concat(F.replace("canonical_url", F.lit("https"), F.lit("http")), F.lit("/?utm_source=a&ref=b#c"))
    rows = rows.withColumns({"canonical_url": messy, "name": F.concat(F.lit(" "), F.col("name"))})
    out = normalize_promotions(rows, sources)
    return out.select("id", "name", "normalized_name", F.col("canonical_url").alias("url"), num("source_confidence", "score"), F.size("source_urls").alias("urls"))


@query("promotion_id", f"""with p as (select row_id, case when row_id % 3 = 0 then '' else canonical_url end as url, case when row_id % 6 = 0 then '' else name end as name, municipality, developer_name, address, locality from promotions),
  n as (select row_id, url, {duck_norm('name')} as n, {duck_norm('municipality')} as m, trim(regexp_replace({duck_norm('developer_name')}, ' s l$', '')) as d, {duck_norm('coalesce(address, locality)')} as a from p)
  select row_id, 'sn-' || left(sha256(case when url <> '' then 'url|' || url when n <> '' and m <> '' then 'name|' || n || '|' || m || '|' || d else 'place|' || a || '|' || m || '|' || d end), 20) as id, n || '|' || m || '|' || d as fingerprint from n""")
def _(t):
    rows = t.promotions.withColumns({"canonical_url": F.when(F.col("row_id") % 3 == 0, "").otherwise(F.col("canonical_url")), "name": F.when(F.col("row_id") % 6 == 0, "").otherwise(F.col("name"))})
    cols = [F.col(c) for c in ("canonical_url", "name", "municipality", "developer_name", "address", "locality")]
    return rows.select("row_id", ids.promotion_id(*cols).alias("id"), ids.fingerprint(*cols[1:4]).alias("fingerprint"))


shared(checked="""select p.*, (price_to < price_from) as e1, (built_area_max_sqm < built_area_min_sqm) as e2, (bedrooms_max < bedrooms_min) as e3, (location_precision = 'municipalityCentroid' and (p.latitude is null or p.longitude is null)) as e4,
   m.official_name is null as w from promotions p left join (select * from municipalities where ord % 5 <> 2) m on m.official_name = p.municipality""")


def validated(t):
    return Q.validate_promotions(t.promotions, t.municipalities.where("ord % 5 <> 2"))


@query("validate_promotions", "select id, coalesce(e1, false)::int + coalesce(e2, false)::int + coalesce(e3, false)::int + coalesce(e4, false)::int as errors, w::int as warnings from checked")
def _(t):
    return validated(t).select("id", F.size("errors").alias("errors"), F.size("warnings_found").alias("warnings"))


@query("quality_summary", "select count(*) filter (not (coalesce(e1, false) or coalesce(e2, false) or coalesce(e3, false) or coalesce(e4, false))) as valid_promotions, count(*) filter (coalesce(e1, false) or coalesce(e2, false) or coalesce(e3, false) or coalesce(e4, false)) as invalid_promotions, "
       "sum(w::int) as warnings, sum(coalesce(e1, false)::int + coalesce(e2, false)::int + coalesce(e3, false)::int + coalesce(e4, false)::int) as errors from checked")
def _(t):
    return Q.quality_summary(validated(t))


@query("quality_issues", """with i as (select id, 1 as pos, 'priceMax no puede ser menor que priceMin.' as issue from checked where e1 union all select id, 2, 'builtAreaMax no puede ser menor que builtAreaMin.' from checked where e2
   union all select id, 3, 'bedroomsMax no puede ser menor que bedroomsMin.' from checked where e3 union all select id, 4, 'Una ubicación por centroide debe incluir coordenadas.' from checked where e4
   union all select id, 5, 'Municipio fuera de configuración: ' || municipality || '.' from checked where w) select id, issue from i order by id, pos limit 100""")
def _(t):
    return Q.quality_issues(validated(t)).select("id", "issue")


@query("known_municipality", "select id from checked where w")
def _(t):
    return validated(t).where(F.size("warnings_found") > 0).select("id")


@query("dataset_statistics", "select count(*) as total, count(*) filter (active) as active, count(price_from) as with_price, count(*) filter (latitude is not null and longitude is not null) as with_coordinates from promotions")
def _(t):
    return Q.dataset_statistics(t.promotions)


@query("by_municipality", "select municipality, count(*) as n from promotions group by 1")
def _(t):
    return Q.by_municipality(t.promotions)


@query("freshness", f"select {duck_ts('min(last_seen_utc)')} as oldest_check_utc, {duck_ts('max(last_seen_utc)')} as newest_check_utc, timestamp '{NOW}' > max(last_seen_utc) + interval 96 hours as is_stale from promotions")
def _(t):
    rows = Q.freshness(t.promotions, now())
    return rows.select(ts("oldest_check_utc"), ts("newest_check_utc"), "is_stale")


_RUNS = """select source_id, case when count(*) filter (not success) * 5 > count(*) then 'failed' when source_id like '%9' then 'skipped' else 'success' end as status, count(*) as urls_discovered, count(*) filter (success) as urls_fetched,
   count(*) filter (not success) as urls_skipped, sum(candidates_matched) as promotions_extracted, min(checked_at) as started_at_utc, max(checked_at) as finished_at_utc from source_runs group by source_id"""
shared(crawl_runs=_RUNS)


@query("run_report", """with r as (select count(*) as total_sources, count(*) filter (status = 'success') as successful_sources, count(*) filter (status = 'failed') as failed_sources, count(*) filter (status = 'skipped') as skipped_sources,
   sum(urls_discovered) as discovered_urls, sum(urls_fetched) as fetched_urls, sum(urls_skipped) as skipped_urls, sum(promotions_extracted) as extracted_promotions, round(date_diff('microsecond', min(started_at_utc), max(finished_at_utc)) / 1000000.0, 3) as duration_seconds from crawl_runs)
  select r.*, (select count(*) from change_log where kind = 'added') as new_promotions, (select count(*) from change_log where kind <> 'added') as changed_promotions,
   case when successful_sources = 0 then 'failed' when failed_sources > 0 or (select count(*) from checked where e1 or e2 or e3 or e4) > 0 then 'partialSuccess' else 'success' end as status, successful_sources > 0 as publishable from r""")
def _(t):
    from listing_radar.queries.changes_queries import log

    runs = t.source_runs.groupBy("source_id").agg(
        F.count_if(~F.col("success")).alias("bad"), F.count(F.lit(1)).alias("urls_discovered"), F.count_if("success").alias("urls_fetched"),
        F.sum("candidates_matched").alias("promotions_extracted"), F.min("checked_at").alias("started_at_utc"), F.max("checked_at").alias("finished_at_utc"))
    runs = runs.withColumn("urls_skipped", F.col("bad")).withColumn("status", F.when(F.col("bad") * 5 > F.col("urls_discovered"), "failed").when(F.col("source_id").endswith("9"), "skipped").otherwise("success"))
    out = Q.run_report(runs, log(t), validated(t))
    return out.drop("started_at_utc", "finished_at_utc", "valid_promotions", "invalid_promotions", "warnings", "errors")


@query("duplicate_keys", "select lower(o_orderpriority || o_orderdate::date) as key, count(*) as n from orders group by 1 having count(*) > 1")
def _(t):
    return Q.duplicate_keys(t.orders.select(F.concat("o_orderpriority", F.col("o_orderdate").cast("date").cast("string")).alias("name")), "name")


_CENTROIDS = """select ord, case when ord % 6 = 5 then 'Unknown_' || cast(ord as string) else lower(official_name) end as municipality, case when ord % 8 = 1 then latitude + 1 else latitude end as latitude, longitude,
  case when ord % 7 = 2 then 'http://x.example.org' else 'https://x.example.org' end as source_url, case when ord % 9 = 1 then null else timestamp '2024-01-01 00:00:00' end as checked_at_utc from municipalities where ord % 10 <> 4"""
shared(centroids=_CENTROIDS.replace("string", "varchar"))


@query("provenance_check", """with b as (select m.official_name, m.latitude as la, m.longitude as lo, c.*, m.official_name is not null as hm, c.municipality is not null as hs from municipalities m full join centroids c on lower(m.official_name) = lower(c.municipality)),
  r as (select coalesce(official_name, municipality) as municipality, unnest([case when hm and (la is null) <> (lo is null) then 'half_coordinates' end, case when hm and la is not null and lo is not null and not hs then 'missing_provenance' end,
    case when hm and hs and la is not null and lo is not null and (la <> latitude or lo <> longitude) then 'coordinates_differ' end, case when hs and not hm then 'unknown_municipality' end,
    case when hs and hm and (la is null or lo is null) then 'unpublished_coordinates' end, case when hs and hm and source_url like 'http:%' then 'not_https' end, case when hs and hm and checked_at_utc is null then 'not_checked' end]) as rule from b)
  select municipality, rule from r where rule is not null""")
def _(t):
    rows = t.spark.sql(_CENTROIDS.replace("from municipalities", "from {m}"), m=t.municipalities)
    rows = rows.withColumns({"source_record_id": F.lit("r"), "coordinate_origin": F.lit("o")})
    return Q.provenance_check(t.municipalities, rows)


@query("geocode_centroid", """select id, case when p.latitude is not null and p.longitude is not null then p.latitude when m.latitude is not null and m.longitude is not null then m.latitude else p.latitude end as latitude,
  case when p.latitude is not null and p.longitude is not null then p.longitude when m.latitude is not null and m.longitude is not null then m.longitude else p.longitude end as longitude,
  case when p.latitude is not null and p.longitude is not null then case when location_precision = 'unknown' then 'exactCoordinates' else location_precision end when m.latitude is not null and m.longitude is not null then 'municipalityCentroid' else location_precision end as location_precision,
  case when not (p.latitude is not null and p.longitude is not null) and m.latitude is not null and m.longitude is not null then 1 else 0 end as warnings from promotions p left join municipalities m on m.official_name = p.municipality""")
def _(t):
    out = G.geocode_centroid(full(t), t.municipalities, now())
    return out.select("id", num("latitude"), num("longitude"), "location_precision", F.size("warnings").alias("warnings"))


@query("geocode_from_cache", """with c as (select distinct address || ', ' || municipality || ', Madrid, España' as q from promotions where address is not null and row_id % 4 <> 3)
  select id, case when p.latitude is null and c.q is not null then 41.5 else p.latitude end as latitude, case when p.latitude is null and c.q is not null then 'street' else location_precision end as location_precision
  from promotions p left join c on c.q = p.address || ', ' || p.municipality || ', Madrid, España'""")
def _(t):
    cache = t.promotions.where("address is not null and row_id % 4 <> 3").select(G.geocode_query().alias("query")).distinct().select(
        "query", F.lit(41.5).alias("latitude"), F.lit(-3.5).alias("longitude"), now().alias("resolved_at_utc"))
    return G.geocode_from_cache(full(t), cache).select("id", num("latitude"), "location_precision")


@query("spread_coincident_points", f"""with s as (select id, latitude, longitude, round(latitude, 5) as y, round(longitude, 5) as x from promotions where latitude is not null and longitude is not null),
  r as (select *, count(*) over (partition by x, y) as n, row_number() over (partition by x, y order by id) - 1 as i from s)
  select id, n >= 2 as visually_spread, round(case when n >= 2 then longitude + cos(2 * {math.pi} * i / n - {math.pi} / 2) * least(0.005, 0.0018 + n * 0.00025) else longitude end, 6) as longitude,
   round(case when n >= 2 then latitude + sin(2 * {math.pi} * i / n - {math.pi} / 2) * least(0.005, 0.0018 + n * 0.00025) else latitude end, 6) as latitude from r""")
def _(t):
    points = t.promotions.select("id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    out = G.spread_coincident_points(points, F.substring("id", 1, 12))
    return out.select("id", "visually_spread", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


_PRED = {
    "search": (E.FilterSpec(search="local 3", active_only=False), "contains(lower(name), 'local 3') or contains(lower(municipality), 'local 3') or contains(lower(coalesce(locality, '')), 'local 3') or contains(lower(coalesce(developer_name, '')), 'local 3')"),
    "places_and_type": (E.FilterSpec(municipalities=["nation_1", "NATION_7"], property_type="adosad"), "active and municipality in ('NATION_1', 'NATION_7') and row_id % 2 = 0"),
    "prices": (E.FilterSpec(price_min=150000, price_max=300000), "active and coalesce(price_to, price_from, 0) >= 150000 and price_from <= 300000"),
    "sizes": (E.FilterSpec(bedrooms_min=5, built_area_min=180, plot_area_min=500, locality="local 2"), "active and lower(locality) = 'local 2' and coalesce(bedrooms_max, bedrooms_min, 0) >= 5 and coalesce(built_area_max_sqm, built_area_min_sqm, 0) >= 180 and coalesce(plot_area_max_sqm, plot_area_min_sqm, 0) >= 500"),
    "statuses": (E.FilterSpec(commercial_status="onSale", construction_status="completed", source_kind="builder", confidence_min=0.6), "active and commercial_status = 'onSale' and construction_status = 'completed' and source_kind = 'builder' and source_confidence >= 0.6"),
    "flags": (E.FilterSpec(with_price_only=True, exact_location_only=True), "active and price_from is not null and location_precision = 'exactCoordinates'"),
}
for _name, (_spec, _where) in _PRED.items():
    query(f"explore_{_name}", f"select id from promotions where {_where}")(lambda t, spec=_spec: E.explore(t.promotions, spec).select("id"))

_SORTS = {
    "price-asc": "price_from asc nulls last", "price-desc": "price_from desc nulls last", "plot-desc": "coalesce(plot_area_max_sqm, plot_area_min_sqm) desc nulls last",
    "area-desc": "coalesce(built_area_max_sqm, built_area_min_sqm) desc nulls last", "confidence": "source_confidence desc", "municipality": "upper(municipality), upper(name)", "recent": "last_changed_utc desc, upper(name)",
}
for _mode, _order in _SORTS.items():
    query(f"explorer_sort_{_mode.replace('-', '_')}", f"select id, row_number() over (order by {_order}, id) as place from promotions")(
        lambda t, mode=_mode: place_in_order(t.promotions.select(*E_COLUMNS), E.explorer_sort(mode)).select("id", "place"))

E_COLUMNS = ["id", "price_from", "plot_area_max_sqm", "plot_area_min_sqm", "built_area_max_sqm", "built_area_min_sqm", "source_confidence", "municipality", "name", "last_changed_utc"]


@query("explore_new_only", "select id from promotions where active and id in (select id from diff where kind = 'added')")
def _(t):
    from listing_radar.queries.changes_queries import diff

    added = diff(t).where("change_kind = 'added'").select("id")
    return E.explore(t.promotions, E.FilterSpec(), added).select("id")


@query("dataset_order", "select id, row_number() over (order by upper(municipality), upper(name), id) as place from promotions")
def _(t):
    return place_in_order(t.promotions.select("id", "municipality", "name"), E.dataset_order()).select("id", "place")


@query("facet_values", "select arg_min(locality, id) as value, count(*) as n from promotions where coalesce(trim(locality), '') <> '' group by upper(locality)")
def _(t):
    return E.facet_values(t.promotions, "locality")


_FLAGS = "cast(developer_name is not null as int) + cast(price_from is not null as int) + cast(coalesce(bedrooms_min, bedrooms_max) is not null as int) + cast(bathrooms_min is not null as int) + cast(coalesce(built_area_min_sqm, built_area_max_sqm) is not null as int) + cast(plot_area_min_sqm is not null as int) + 1 + cast(available_units is not null as int) + cast(address is not null as int) + cast(delivery_date_text is not null as int) + cast(location_precision = 'exactCoordinates' as int)"


@query("completeness_pct", f"select id, cast(round(({_FLAGS}) * 100.0 / 11, 0) as int) as pct from promotions")
def _(t):
    rows = t.promotions
    return rows.select("id", scores.completeness_pct({c: F.col(c) for c in rows.columns}).alias("pct"))


def _exported(column: str) -> str:
    if column == "property_types":
        return "concat_ws(' | ', property_types[1], property_types[2])"
    if column == "last_seen_utc":
        return "strftime(last_seen_utc, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00'"
    if column in ("price_from", "price_to", "latitude", "longitude", "source_confidence") or column.endswith("_sqm"):
        return f"regexp_replace(regexp_replace(cast({column} as varchar), '([.][0-9]*?)0+$', '\\1'), '[.]$', '')"
    return f"cast({column} as varchar)"


_CSV = ", ".join(f"""coalesce({_exported(column)}, '') as "{name}\"""" for name, column in V.CSV_COLUMNS.items())


@query("csv_rows", f"select {_CSV} from (select * replace (cast(price_from + 1000 as decimal(14,2)) as price_to) from promotions)")
def _(t):
    """All columns; the upper price is set anew, since the engines round the halves of the table's doubles differently."""
    return S.csv_rows(full(t).withColumn("price_to", (F.col("price_from") + 1000).cast("decimal(14,2)")))


@query("geojson_features", """select id, 'Point' as kind, cast(longitude as double) as lon, cast(latitude as double) as lat, commercial_status as status from promotions where latitude is not null and longitude is not null""")
def _(t):
    rows = S.geojson_features(full(t))
    g = F.from_json("feature", "geometry struct<type:string,coordinates:array<double>>, properties struct<commercialStatus:string>")
    return rows.withColumn("g", g).select("id", F.col("g.geometry.type").alias("kind"), F.element_at("g.geometry.coordinates", 1).alias("lon"), F.element_at("g.geometry.coordinates", 2).alias("lat"),
                                          F.col("g.properties.commercialStatus").alias("status"))
