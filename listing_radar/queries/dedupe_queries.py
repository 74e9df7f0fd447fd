"""Deduplication over listings that share pages or names."""

from pyspark.sql import functions as F

from listing_radar.functions.ids import fingerprint
from listing_radar.operators import dedupe as D
from listing_radar.plans.promotions import empty_facts
from listing_radar.queries.registry import duck_norm, num, query, shared
from listing_radar.session import cut_to_table
from listing_radar import fixed_values as V, schemas

shared(
    dup_rows=f"""select *, canonical_url as u, {duck_norm('name')} || '|' || {duck_norm('municipality')} || '|' || {duck_norm('developer_name')} as f from duplicates""",
    dup_order="select *, row_number() over (order by canonical_url, name, row_id) as k, dense_rank() over (order by u) as un, dense_rank() over (order by f) as fn from dup_rows",
)
# one row at a time, as the definition says: a row is kept if neither its page nor its print is taken
_GREEDY = """with recursive g as (select cast(0 as bigint) as k, cast([] as bigint[]) as tu, cast([] as bigint[]) as tf, false as kept
   union all select o.k, case when not list_contains(tu, un) and not list_contains(tf, fn) then list_append(tu, un) else tu end,
    case when not list_contains(tu, un) and not list_contains(tf, fn) then list_append(tf, fn) else tf end, not list_contains(tu, un) and not list_contains(tf, fn) from g join dup_order o on o.k = g.k + 1),
  s as (select o.k, o.un, o.fn, o.row_id from g join dup_order o using (k) where kept),
  a as (select o.*, least(su.k, sf.k) as sk from dup_order o left join s su on su.un = o.un left join s sf on sf.fn = o.fn),
  assigned as (select a.*, s.row_id as survivor_id from a join s on s.k = a.sk)
"""


def rows(t):
    out = t.duplicates.withColumns({
        "latitude": F.col("latitude").cast("double"), "longitude": F.col("longitude").cast("double"),
        "location_precision": F.element_at(F.array(*[F.lit(n) for n in V.LOCATION_PRECISION]), (F.col("precision_no") + 1).cast("int")),
        "source_urls": F.array(F.col("canonical_url"), F.concat(F.lit("https://m.example.org/"), (F.col("row_id") % 10).cast("string"))),
        "tags": F.array(F.when(F.col("row_id") % 2 == 0, "New").otherwise("new"), F.lit("x"))})
    return empty_facts(out)


@query("deduplicate_assign", _GREEDY + "select row_id, survivor_id from assigned")
def _(t):
    return D.assign_survivors(rows(t)).select("row_id", "survivor_id")


@query("deduplicate_merge", _GREEDY + """, p as (select name, municipality, survivor_id from assigned where row_id = survivor_id),
  w as (select survivor_id, row_number() over (partition by """ + duck_norm("name") + ", " + duck_norm("municipality") + """ order by (select k from dup_order d where d.row_id = p.survivor_id)) > 1 as possible_duplicate from p)
  select survivor_id as row_id, cast(arg_min(price_from, k) filter (price_from is not null) as double) as price_from, cast(arg_min(price_to, k) filter (price_to is not null) as double) as price_to,
   cast(arg_min(latitude, k) filter (latitude is not null) as double) as latitude, cast(max(source_confidence) as double) as confidence, max(precision_no) as precision_no, count(*) as members, any_value(w.possible_duplicate) as possible_duplicate
   from assigned join w using (survivor_id) group by survivor_id""")
def _(t):
    out = D.deduplicate(rows(t))
    place = F.array_position(F.array(*[F.lit(n) for n in V.LOCATION_PRECISION]), F.col("location_precision")) - 1
    return out.select("row_id", num("price_from"), num("price_to"), num("latitude"), num("source_confidence", "confidence"), place.alias("precision_no"), "members", "possible_duplicate")


@query("deduplicate_heavy_keys", _GREEDY + "select row_id, survivor_id from assigned")
def _(t):
    """Same result when every shared key takes the way of a heavy key."""
    return D.assign_survivors(rows(t), heavy_rows=2).select("row_id", "survivor_id")


@query("merge_arrays", _GREEDY + """, urls as (select distinct survivor_id, 'source_urls' as kind, unnest([canonical_url, 'https://m.example.org/' || cast(row_id % 10 as varchar)]) as value from assigned),
  files as (select distinct survivor_id, 'brochure_urls' as kind, unnest([canonical_url || '.pdf', 'https://m.example.org/' || cast(row_id % 4 as varchar) || '.pdf']) as value from assigned),
  x as (select survivor_id, k, unnest([case when row_id % 2 = 0 then 'New' else 'new' end, 'x']) as v, unnest([0, 1]) as p from assigned),
  spelled as (select survivor_id, arg_min(v, k * 10 + p) as value from x group by survivor_id, lower(v)),
  proofs as (select survivor_id, k, unnest([case when row_id % 2 = 0 then 'priceFrom' else 'name' end, 'name']) as field, unnest([canonical_url, 'https://m.example.org/' || cast(row_id % 4 as varchar)]) as url,
   unnest([cast(row_id as varchar), municipality]) as v, unnest([0, 1]) as p from assigned)
  select survivor_id, kind, row_number() over (partition by survivor_id, kind order by value) as place, value from (select * from urls union all select * from files)
  union all select survivor_id, 'tags', row_number() over (partition by survivor_id order by upper(value)), value from spelled
  union all select survivor_id, 'evidence', row_number() over (partition by survivor_id order by field, url, k, p), concat_ws(' ', field, url, v) from proofs""")
def _(t):
    """All four merged lists, each value with its place in its list."""
    def proof(field, url, value):
        known = {"field": field, "source_url": url, "value_text": value}
        return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.struct(f"e {schemas.EVIDENCE}")["e"].dataType])

    def other(n, end=""):
        return F.concat(F.lit("https://m.example.org/"), (F.col("row_id") % n).cast("string"), F.lit(end))

    listings = rows(t).withColumns({
        "brochure_urls": F.array(F.concat("canonical_url", F.lit(".pdf")), other(4, ".pdf")),
        "evidence": F.array(proof(F.when(F.col("row_id") % 2 == 0, "priceFrom").otherwise("name"), F.col("canonical_url"), F.col("row_id")),
                            proof(F.lit("name"), other(4), F.col("municipality")))})
    merged = D.merge_arrays(cut_to_table(D.assign_survivors(listings)))
    lists = {c: F.col(c) for c in ("source_urls", "brochure_urls", "tags")} | {
        "evidence": F.transform("evidence", lambda e: F.concat_ws(" ", e["field"], e["source_url"], e["value_text"]))}
    out = merged.select("survivor_id", F.explode(F.create_map(*[x for n, c in lists.items() for x in (F.lit(n), c)])).alias("kind", "_list"))
    return out.select("survivor_id", "kind", F.posexplode("_list").alias("_p", "value")).select("survivor_id", "kind", (F.col("_p") + 1).cast("long").alias("place"), "value")


@query("merge_tags", _GREEDY + """, x as (select survivor_id, k, unnest([case when row_id % 2 = 0 then 'New' else 'new' end, 'x']) as v, unnest([0, 1]) as p from assigned)
  select survivor_id, arg_min(v, k * 10 + p) as value from x group by survivor_id, lower(v)""")
def _(t):
    return D.first_spelling(D.assign_survivors(rows(t)), "tags")


@query("possible_duplicate_warning", f"""select row_id, row_number() over (partition by {duck_norm('name')}, {duck_norm('municipality')} order by canonical_url, name, row_id) > 1 as possible_duplicate from duplicates""")
def _(t):
    return D.possible_duplicates(t.duplicates).select("row_id", "possible_duplicate")


@query("distinct_promotions_on_page", """select min(row_id) as row_id from (select *, row_id as r, row_id // 20 as page from duplicates) group by lower(canonical_url), lower(name), price_from, price_to""")
def _(t):
    return D.distinct_on_page(t.duplicates).select("row_id")


@query("fingerprint", "select row_id, f as fingerprint from dup_rows")
def _(t):
    return t.duplicates.select("row_id", fingerprint(F.col("name"), F.col("municipality"), F.col("developer_name")).alias("fingerprint"))


@query("deduplicate_chain", "select p_partkey as row_id, p_partkey - (p_partkey - m) % 2 as survivor_id from part, (select min(p_partkey) as m from part)")
def _(t):
    """Listings that share the URL and the print in turn, in sort order: every second one survives."""
    first = t.part.agg(F.min("p_partkey")).first()[0]
    i = F.col("p_partkey") - first + 1
    pad = lambda c: F.lpad(F.floor(c).cast("string"), 12, "0")
    rows = t.part.select(F.col("p_partkey").cast("long").alias("row_id"), F.concat(F.lit("https://c.example.org/"), pad((i + 1) / 2)).alias("canonical_url"),
                         F.concat(F.lit("n"), pad(i / 2)).alias("name"), F.lit("m").alias("municipality"), F.lit(None).cast("string").alias("developer_name"))
    return D.assign_survivors(rows).select("row_id", "survivor_id")
