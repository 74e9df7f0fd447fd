"""Text expressions over documents."""

from pyspark.sql import functions as F

from listing_radar.functions import dates, patterns as P, scores, text as X
from listing_radar.queries.registry import duck_clean, duck_norm, duck_title, duck_ts, num, query, ts


def sha(c):
    return F.sha2(c, 256)


@query("normalize_text", f"select doc_id, sha256({duck_norm('text')}) as h, length({duck_norm('text')}) as n from documents")
def _(t):
    c = X.normalize_text(F.col("text"))
    return t.documents.select("doc_id", sha(c).alias("h"), F.length(c).alias("n"))


@query("clean_evidence", f"""select doc_id, {duck_clean('text', 280)} as short, sha256({duck_clean('text', 1000)}) as long
  from documents""")
def _(t):
    return t.documents.select("doc_id", X.clean_evidence(F.col("text")).alias("short"), sha(X.clean_evidence(F.col("text"), 1000)).alias("long"))


@query("normalize_title", f"select doc_id, sha256({duck_title('title')}) as h from items")
def _(t):
    return t.items.select("doc_id", sha(X.normalize_title(F.col("title"))).alias("h"))


_COMPANY = "('Ñandú ' || p_name || case p_partkey % 7 when 0 then ', S.L.' when 1 then ' SL' when 2 then ' S.A.' when 3 then ' Sociedad Limitada' when 4 then ' Sociedad Anónima S.L.' when 5 then ' S. A. S.L.' else '' end)"


@query("normalize_company", f"""with n as (select p_partkey, {duck_norm(_COMPANY)} as c from part),
  a as (select p_partkey, trim(regexp_replace(c, ' s l$', '')) as c from n), b as (select p_partkey, trim(regexp_replace(c, ' sl$', '')) as c from a),
  d as (select p_partkey, trim(regexp_replace(c, ' s a$', '')) as c from b), e as (select p_partkey, trim(regexp_replace(c, ' sa$', '')) as c from d),
  f as (select p_partkey, trim(regexp_replace(c, ' sociedad limitada$', '')) as c from e)
  select p_partkey, trim(regexp_replace(c, ' sociedad anonima$', '')) as company from f""")
def _(t):
    return t.part.select("p_partkey", X.normalize_company(F.expr(_COMPANY)).alias("company"))


@query("contains_location", f"""with c as (select i.doc_id, p.official_name, {duck_title('i.title')} as a, {duck_title('p.official_name')} as b from items i
    join places p on i.doc_id % 8 = p.ord)
  select doc_id, contains(a, b) or contains(regexp_replace(a, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'), regexp_replace(b, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')) as hit from c""")
def _(t):
    rows = t.items.withColumn("ord", (F.col("doc_id") % 8).cast("int")).join(F.broadcast(t.places), "ord")
    return rows.select("doc_id", X.contains_location(X.normalize_title(F.col("title")), X.normalize_title(F.col("official_name"))).alias("hit"))


@query("historical_year", """select o_orderkey, regexp_matches(cast(o_orderdate as varchar), '(2000|2001)') as old from orders""")
def _(t):
    return t.orders.select("o_orderkey", X.historical_year(F.col("o_orderdate").cast("string"), 2003).alias("old"))


_AMOUNT = """(case o_orderkey % 7 when 0 then regexp_replace(cast(cast(floor(o_totalprice) as bigint) as string), '(\\d)(\\d{3})$', '$1.$2') || ' €'
  when 1 then replace(cast(cast(o_totalprice as decimal(14,2)) as string), '.', ',') || ' euros' when 2 then cast(cast(o_totalprice as decimal(14,2)) as string) || 'EUR'
  when 3 then '1.234,' || cast(o_orderkey % 10 as string) when 4 then '12,345.' || cast(o_orderkey % 10 as string) when 5 then 'n/a ' || cast(o_orderkey as string)
  else cast(cast(floor(o_totalprice) as bigint) as string) end)"""


@query("parse_spanish_decimal", "with r as (select o_orderkey, " + _AMOUNT.replace("'$1.$2'", "'\\1.\\2'").replace("'(\\\\d)(\\\\d{3})$'", "'(\\d)(\\d{3})$'") + """ as raw from orders),
  n as (select o_orderkey, trim(regexp_replace(raw, '€|euros?|eur| ', '', 'gi')) as s from r),
  p as (select o_orderkey, case when contains(s, ',') and (not contains(s, '.') or length(split_part(s, ',', -1)) < length(split_part(s, '.', -1))) then replace(replace(s, '.', ''), ',', '.')
    when contains(s, '.') and length(split_part(s, '.', -1)) = 3 then replace(replace(s, '.', ''), ',', '') else replace(s, ',', '') end as s from n)
  select o_orderkey, cast(try_cast(s as decimal(14,2)) as double) as amount from p""")
def _(t):
    raw = F.expr(_AMOUNT.replace("\\", "\\\\"))
    return t.orders.select("o_orderkey", P.parse_spanish_decimal(raw).cast("double").alias("amount"))


_FACTS = """(text || ' Obra nueva: desde ' || cast(100 + doc_id % 400 as string) || '.000 € hasta ' || cast(600 + doc_id % 9 as string) || '.500 euros. '
  || cast(2 + doc_id % 3 as string) || ' a ' || cast(5 + doc_id % 2 as string) || ' dormitorios, ' || cast(1 + doc_id % 3 as string) || ' baños, '
  || case doc_id % 4 when 0 then 'chalets adosados' when 1 then 'viviendas pareadas, no adosadas' when 2 then 'chalet independiente' else 'pisos' end
  || case doc_id % 5 when 0 then ' con piscina privada' when 1 then ' y piscina comunitaria' else '' end
  || case doc_id % 7 when 0 then '. Agotada' when 1 then '. ÚLTIMAS VIVIENDAS' when 2 then '. Próximamente' when 3 then '. En venta' when 4 then '. Precomercialización' else '' end
  || case doc_id % 6 when 0 then '. Llave en mano' when 1 then '. En construcción' when 2 then '. Licencia concedida' when 3 then '. Licencia de obra solicitada' else '' end
  || '. Entrega prevista ' || case doc_id % 3 when 0 then cast(1 + doc_id % 4 as string) || ' trimestre ' else '' end || cast(2025 + doc_id % 4 as string) || '. Fin')"""


def facts(t):
    return t.documents.select("doc_id", X.collapse_whitespace(F.expr(_FACTS)).alias("x"))


_CLEAN = f"facts_text as (select doc_id, {duck_clean(_FACTS, 100000000)} as x from documents)"


@query("price_range", f"""with {_CLEAN}, m as (select doc_id, unnest(regexp_extract_all(x, '(?:desde|hasta|precio)?\\s*(\\d{{1,3}}(?:\\.\\d{{3}})+)\\s*(?:€|euros?|EUR)', 1)) as v from facts_text),
  n as (select doc_id, cast(replace(v, '.', '') as bigint) as v from m)
  select doc_id, cast(min(v) as double) as price_from, cast(case when count(distinct v) > 1 then max(v) end as double) as price_to from n
  where v between 50000 and 10000000 group by doc_id""")
def _(t):
    rows = facts(t).withColumn("p", P.price_range(F.col("x")))
    return rows.select("doc_id", F.col("p.price_from").cast("double").alias("price_from"), F.col("p.price_to").cast("double").alias("price_to"))


@query("rooms", f"""with {_CLEAN}, m as (select doc_id, regexp_extract(x, '(?i)(\\d{{1,2}})(?:\\s*(?:a|o|y|-)\\s*(\\d{{1,2}}))?\\s+(?:dormitorios?|habitaciones?)', ['a', 'b']) as r,
    regexp_extract(x, '(?i)(\\d{{1,2}})(?:\\s*(?:a|-)\\s*(\\d{{1,2}}))?\\s+ba[nñ]os?', ['a', 'b']) as b from facts_text)
  select doc_id, cast(r.a as int) as bedrooms_min, cast(r.b as int) as bedrooms_max, cast(b.a as int) as bathrooms_min from m""")
def _(t):
    rows = facts(t).withColumns({"r": P.bedrooms(F.col("x")), "b": P.bathrooms(F.col("x"))})
    return rows.select("doc_id", F.col("r.min").alias("bedrooms_min"), F.col("r.max").alias("bedrooms_max"), F.col("b.min").alias("bathrooms_min"))


@query("property_types", f"""with {_CLEAN} select doc_id, concat_ws('|', case when regexp_matches(x, '(?i)\\badosad[oa]s?\\b') and not regexp_matches(x, '(?i)\\bno\\s+(?:son\\s+)?adosad[oa]s?\\b') then 'Adosado' end,
  case when regexp_matches(x, '(?i)\\b(?:chalet|vivienda)s?\\s+independientes?\\b') then 'Independiente' end,
  case when regexp_matches(x, '(?i)\\bparead[oa]s?\\b') then 'Pareado' end) as types from facts_text""")
def _(t):
    return facts(t).select("doc_id", F.array_join(P.property_types(F.col("x")), "|").alias("types"))


@query("pools", f"""with {_CLEAN} select doc_id, case when regexp_matches(x, '(?i)\\bpiscina\\s+privada\\b') then 1 else 0 end as private_pool,
  case when regexp_matches(x, '(?i)\\bpiscina\\s+comunitaria\\b') then 1 else 0 end as community_pool from facts_text""")
def _(t):
    x = F.col("x")
    return facts(t).select("doc_id", F.coalesce(P.private_pool(x), F.lit(False)).cast("int").alias("private_pool"),
                           F.coalesce(P.community_pool(x), F.lit(False)).cast("int").alias("community_pool"))


@query("commercial_status", f"""with {_CLEAN} select doc_id, case when regexp_matches(x, '(?i)\\bagotad[oa]\\b') then 'soldOut'
  when regexp_matches(x, '(?i)[uú]ltimas?\\s+(viviendas?|unidades?)\\b') then 'lastUnits' when regexp_matches(x, '(?i)\\bpr[oó]ximamente\\b') then 'upcoming'
  when regexp_matches(x, '(?i)precomercializaci[oó]n') then 'preSales' when regexp_matches(x, '(?i)\\ben\\s+venta\\b') then 'onSale' else 'unknown' end as status from facts_text""")
def _(t):
    return facts(t).select("doc_id", P.commercial_status(F.col("x")).alias("status"))


@query("construction_status", f"""with {_CLEAN} select doc_id, case when regexp_matches(x, '(?i)\\bllave\\s+en\\s+mano\\b') then 'completed'
  when regexp_matches(x, '(?i)\\ben\\s+construcci[oó]n') then 'underConstruction' when regexp_matches(x, '(?i)\\blicencia\\s+concedida\\b') then 'licensed'
  when regexp_matches(x, '(?i)\\blicencia\\s+de\\s+obra\\s+solicitada\\b') then 'planned' else 'unknown' end as status,
  case when regexp_matches(x, '(?i)\\blicencia\\s+concedida\\b') then 'Concedida' when regexp_matches(x, '(?i)\\blicencia\\s+de\\s+obra\\s+solicitada\\b') then 'Solicitada' end as licence
  from facts_text""")
def _(t):
    return facts(t).select("doc_id", P.construction_status(F.col("x")).alias("status"), P.licence_status(F.col("x")).alias("licence"))


@query("delivery", f"""with {_CLEAN}, m as (select doc_id, regexp_extract(x, '(?i)((?:entrega|finalizaci[oó]n)(?:\\s+prevista)?\\D{{0,20}}(?:([1-4])(?:er|º|o)?\\s*(?:trimestre|T)|Q[1-4])?\\s*(20\\d\\d))', ['t', 'q', 'y']) as m from facts_text)
  select doc_id, m.t as delivery_text, strftime(last_day(make_date(cast(m.y as int), cast(coalesce(nullif(m.q, ''), '4') as int) * 3, 1)), '%Y-%m-%d') as delivery_date from m""")
def _(t):
    rows = facts(t).withColumn("d", P.delivery(F.col("x")))
    return rows.select("doc_id", F.col("d.text").alias("delivery_text"), F.date_format("d.date", "yyyy-MM-dd").alias("delivery_date"))


_AREA = """(text || '. ' || cast(80 + doc_id % 90 as string) || ' m2 construidos y parcelas de ' || cast(200 + doc_id % 300 as string) || ' a '
  || cast(600 + doc_id % 200 as string) || ' m². Promueve: Casa ' || cast(doc_id % 9 as string) || ' Norte SL obras iniciadas. ' || cast(10 + doc_id % 30 as string) || ' viviendas, '
  || case when doc_id % 3 = 0 then 'última vivienda disponible' else cast(1 + doc_id % 5 as string) || ' unidades disponibles' end || '. 2 plazas de garaje')"""


@query("areas_and_units")
def _(t):
    """Patterns that need look-ahead: no equivalent in the reference engine."""
    x, low = F.col("x"), F.col("low")
    rows = t.documents.select("doc_id", X.collapse_whitespace(F.expr(_AREA)).alias("x")).withColumn("low", P.folded(x))
    rows = rows.withColumn("plot", P.plot_area(x, low))
    return rows.select(
        "doc_id", P.built_area(x, low)["min"].cast("double").alias("built_min"), F.col("plot.min").cast("double").alias("plot_min"),
        F.col("plot.max").cast("double").alias("plot_max"), P.total_units(x, low).alias("total_units"),
        P.available_units(x, low).alias("available_units"), P.developer_name(x, low).alias("developer"), P.garage_spaces(x, low)["min"].alias("garage"),
        P.brochure_title(x, low).alias("brochure_title"))


@query("evidence_fragment", f"""with {_CLEAN}, m as (select doc_id, x, regexp_extract(x, '(?i)entrega\\s+prevista') as m from facts_text),
  p as (select doc_id, x, length(m) as n, instr(x, m) - 1 as a from m), w as (select doc_id, substr(x, greatest(a - 60, 0) + 1, n + 120) as f from p)
  select doc_id, {duck_clean('f', 280)} as fragment from w""")
def _(t):
    return facts(t).select("doc_id", P.evidence_fragment(F.col("x"), r"entrega\s+prevista").alias("fragment"))


_DATE = """(case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(ts, '%a, %d %b %Y %H:%M:%S GMT')
  when 2 then strftime(ts, '%a, %d %b %Y %H:%M:%S +0200') else 'yesterday' end)"""


@query("parse_feed_date", f"""select event_id, {duck_ts("case event_id % 4 when 2 then ts - interval 2 hours when 3 then null else ts end")} as published from events""")
def _(t):
    stamp = F.col("ts").cast("timestamp")
    text = (F.when(F.col("event_id") % 4 == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(F.col("event_id") % 4 == 1, F.date_format(stamp, "E, dd MMM yyyy HH:mm:ss 'GMT'"))
            .when(F.col("event_id") % 4 == 2, F.date_format(stamp, "E, dd MMM yyyy HH:mm:ss '+0200'")).otherwise("yesterday"))
    return t.events.select("event_id", ts(dates.parse_feed_date(text), "published"))


@query("estimate_delivery", """select o_orderkey, strftime(last_day(make_date(cast(year(o_orderdate) as int), cast(case when o_orderkey % 3 = 0 then 4 else quarter(o_orderdate) end * 3 as int), 1)), '%Y-%m-%d') as day from orders""")
def _(t):
    quarter = F.when(F.col("o_orderkey") % 3 != 0, F.quarter("o_orderdate"))
    return t.orders.select("o_orderkey", F.date_format(dates.estimate_delivery(F.year("o_orderdate"), quarter), "yyyy-MM-dd").alias("day"))


@query("evidence_keywords", """with m as (select id, name, municipality, price_from is null or price_to is null as p, bedrooms_min is null or bedrooms_max is null as b,
    bathrooms_min is null or bathrooms_max is null as w, plot_area_min_sqm is null or plot_area_max_sqm is null as g, built_area_min_sqm is null or built_area_max_sqm is null as a,
    available_units is null as u, delivery_date_text is null as d from promotions)
  select id, 2 + 5 + case when p then 5 else 0 end + case when b then 3 else 0 end + case when w then 3 else 0 end + 5 + case when a then 2 else 0 end
    + case when g then 3 else 0 end + 5 + 3 + 3 + case when d then 4 else 0 end + 4 as n from m""")
def _(t):
    from listing_radar import fixed_values as V

    rows = t.promotions
    known = {c: F.col(c) for c in rows.columns}
    columns = {**V.TEXT_FIELDS, **V.INTEGER_FIELDS, **V.DECIMAL_FIELDS}
    row = {c: known.get(c, F.lit(None)) for c in columns.values()}
    row["developer_name"], row["total_units"], row["garage_spaces_min"] = F.lit(None), F.lit(None), F.lit(None)
    row["address"], row["postal_code"] = F.lit(None), F.lit(None)
    words = scores.evidence_keywords(F.col("name"), F.col("municipality"), scores.missing_fields(row))
    return rows.select("id", F.size(words).alias("n"))
