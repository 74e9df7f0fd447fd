"""Enrichment: gaps, evidence, proposals, reviews, cost."""

from decimal import Decimal

from pyspark.sql import functions as F

from listing_radar import fixed_values as V
from listing_radar.functions import ids, scores
from listing_radar.operators import enrich as N
from listing_radar.plans.promotions import empty_facts
from listing_radar.operators.scale import place_in_order
from listing_radar.queries.logical import NOW
from listing_radar.queries.registry import duck_clean, duck_ts, num, query, shared, ts

_NULLABLE = ["price_from", "price_to", "bedrooms_min", "bedrooms_max", "bathrooms_min", "bathrooms_max", "built_area_min_sqm", "built_area_max_sqm", "plot_area_min_sqm", "plot_area_max_sqm", "available_units",
             "delivery_date_text", "developer_name", "address"]
_MISSING = " + ".join(f"case when {c} is null then 1 else 0 end" for c in _NULLABLE) + " + 9"


def now():
    return F.lit(NOW).cast("timestamp")


def full(t):
    return empty_facts(t.promotions)


@query("missing_fields", f"select id, {_MISSING} as n, price_from is null as price from promotions")
def _(t):
    rows = N.with_missing_fields(full(t))
    return rows.select("id", F.size("missing").alias("n"), F.array_contains("missing", "priceFrom").alias("price"))


@query("eligible_for_enrichment", "select id from promotions where active")
def _(t):
    return N.eligible(full(t)).select("id")


@query("enrichment_priority", f"select id, row_number() over (order by {_MISSING} desc, id) as place from promotions where active")
def _(t):
    return place_in_order(N.eligible(full(t)), N.enrichment_priority()).select("id", "place")


@query("find_source_by_host", """with h as (select user_id, lower(unnest(allowed_hosts)) as h from user_sources union all select user_id, 'www.site' || cast(user_id % 80 as varchar) || '.example.org' from user_sources), f as (select h, arg_min('u' || cast(user_id as varchar), user_id) as source_id from h group by 1)
  select p.id, f.source_id, f.source_id is null as source_error from promotions p left join f on f.h = 'www.site' || cast(p.site as varchar) || '.example.org'""")
def _(t):
    sources = t.user_sources.withColumns({"ord": F.col("user_id"), "base_url": F.concat(F.lit("https://www.site"), (F.col("user_id") % 80).cast("string"), F.lit(".example.org/"))})
    return N.find_source_by_host(t.promotions, sources).select("id", "source_id", "source_error")


_TEXT = f"{duck_clean('text', 100000000)}"


@query("chunk_scores", f"""with d as (select doc_id, {_TEXT} as x from documents), c as (select doc_id, x, unnest(range(0, greatest(length(x), 1), 440)) as s from d), k as (select doc_id, s, trim(substr(x, s + 1, 520)) as c from c)
  select doc_id, s as start, contains(lower(c), 'the')::int + contains(lower(c), 'de')::int + contains(lower(c), 'él')::int + contains(lower(c), 'und')::int as score, length(c) as n from k where c <> ''""")
def _(t):
    from listing_radar.functions.text import collapse_whitespace

    words = F.array(*[F.lit(w) for w in ("The", "de", "ÉL", "und")])
    rows = t.documents.select("doc_id", F.inline(N.chunk_scores(collapse_whitespace(F.col("text")), words)))
    return rows.select("doc_id", "start", "score", F.length("text").alias("n"))


def _snippet_sql(pages: str, max_pages: int, budget: int) -> str:
    """Tables ending in ``evidence(promotion_id, h)``: the hash of each listing's evidence. ``pages`` (promotion_id, url, x, words) has texts
    with single spaces; a chunk is taken while the chunks before it leave room, and is cut to what is left."""
    out = f"""top as (select * from (select *, row_number() over (partition by promotion_id order by url) as page_no from ({pages})) where page_no <= {max_pages}),
  full_pages as (select *, row_number() over (partition by promotion_id order by url) as n from top where x <> ''),
  pieces as (select promotion_id, n, words, x, unnest(range(0, length(x), {V.CHUNK_STEP})) as s from full_pages),
  scored as (select promotion_id, n, s, trim(substr(x, s + 1, {V.CHUNK_LENGTH})) as c, words from pieces),
  ranked as (select promotion_id, n, s, c, row_number() over w as r, coalesce(sum(length(c) + 3) over (w rows between unbounded preceding and 1 preceding), 0) as before from (select *, len(list_filter(words, lambda k: contains(lower(c), k))) as score from scored where c <> '')
    window w as (partition by promotion_id, n order by score desc, s)),
  room0 as (select promotion_id, {budget} as room from full_pages group by 1)"""
    for n in range(1, max_pages + 1):
        out += f""",
  page{n} as (select f.promotion_id, f.url, least(room, {V.PAGE_EVIDENCE_LENGTH}) as room, f.x from full_pages f join room{n - 1} using (promotion_id) where f.n = {n} and room > 0),
  shown{n} as (select p.promotion_id, any_value(p.url) as url, case when any_value(length(p.x) <= p.room) then any_value(p.x) else string_agg(left(c, cast(room - before as bigint)), '{V.CHUNK_SEPARATOR}' order by s) end as t
    from page{n} p join ranked k on k.promotion_id = p.promotion_id and k.n = {n} and before < room group by 1),
  room{n} as (select promotion_id, r.room - coalesce(length(t), 0) as room from room{n - 1} r left join shown{n} using (promotion_id))"""
    every = " union all ".join(f"select *, {n} as n from shown{n}" for n in range(1, max_pages + 1))
    return out + f""",
  evidence as (select promotion_id, count(*) as pages, upper(sha256(string_agg(url || chr(10) || t, chr(10) order by n))) as content_hash, string_agg(url || t, chr(10) order by n) as request from ({every}) group by 1)"""


_DOC_PAGES = f"select doc_id % 97 as promotion_id, 'https://p/' || lpad(cast(doc_id as varchar), 9, '0') as url, {_TEXT} as x, ['the', 'que'] as words from documents"


@query("evidence_snippets", f"with {_snippet_sql(_DOC_PAGES, 5, 8000)} select * exclude (request) from evidence")
def _(t):
    """Pages of a listing: ten documents each at the smallest scale."""
    pages = t.documents.select((F.col("doc_id") % F.lit(97)).alias("promotion_id"), F.concat(F.lit("https://p/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("url"), "text",
                               F.lit(NOW).cast("timestamp").alias("fetched_at"), F.array(F.lit("the"), F.lit("que")).alias("keywords"))
    rows = N.evidence_snippets(pages, 5, 8000).where(F.size("pages") > 0)
    return rows.select("promotion_id", F.size("pages").alias("pages"), ids.content_hash(F.col("pages")).alias("content_hash"))


def _in_promotions(name: str) -> str | None:
    column = {**V.TEXT_FIELDS, **V.INTEGER_FIELDS, **V.DECIMAL_FIELDS}[name]
    return column if column in _NULLABLE else None


def _strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_GAPS = "list_filter([" + ", ".join(f"case when {_in_promotions(n)} is null then '{n}' end" if _in_promotions(n) else f"'{n}'" for n in V.FILLABLE_FIELDS) + "], lambda g: g is not null)"
_WORDS = " || ".join(["[name, municipality]"] + [f"case when list_has_any(missing, {_strings(f)}) then {_strings(k)} else [] end" for f, k in V.EVIDENCE_KEYWORDS.items()])
# listing k has the documents 2k and 2k + 1; what the last run knew of every fourth listing were the plain texts
_RUN = f"""with recursive gaps as (select *, {_GAPS} as missing, 'www.site' || cast(site as varchar) || '.example.org' as host from promotions where active),
  hosts as (select distinct 'www.site' || cast(user_id % 40 as varchar) || '.example.org' as host from user_sources),
  asked as (select *, host in (select host from hosts) as known, list_distinct(list_transform({_WORDS}, lambda w: lower(w))) as words from gaps),
  texts as (select doc_id // 2 as row_id, 'https://p/' || lpad(cast(doc_id as varchar), 9, '0') as url, {_TEXT} as x from documents),
  {_snippet_sql("select id as promotion_id, url, x, words from asked join texts using (row_id) where known", 2, 5000)},
  old as (select row_id, upper(sha256(string_agg(url || chr(10) || x, chr(10) order by url))) as h from texts where row_id % 4 = 0 group by 1),
  q as (select a.id, a.row_id, row_number() over (order by len(missing) desc, a.id) as ord, coalesce(h = content_hash, false) as cached, content_hash, h,
    case when not known then 'No hay una fuente configurada para ' || chr(39) || canonical_url || chr(39) || '.' when content_hash is null then 'No se obtuvo evidencia textual para ' || chr(39) || name || chr(39) || '.' end as error,
    octet_length(encode(array_to_string(missing, ',') || request)) + 256 + 4800 as cost from asked a left join evidence e on e.promotion_id = a.id left join old using (row_id)),
  g as (select cast(0 as bigint) as ord, cast(0 as bigint) as spent, 0 as calls union all
    select n.ord, n.spent, n.calls from (select (select min(q.ord) from q where q.ord > g.ord and not q.cached and g.spent + q.cost <= 200000) as ord, g.spent + (select q.cost from q where q.ord = (select min(q.ord) from q where q.ord > g.ord and not q.cached and g.spent + q.cost <= 200000)) as spent, g.calls + 1 as calls
     from g where g.calls < 25) n where n.ord is not null),
  d as (select *, case when (select count(*) from g where ord > 0) = 25 and ord > (select max(ord) from g) then 'notReached' when cached then 'cached' when ord in (select ord from g) then 'admitted' when error is not null then 'failed' else 'overBudget' end as decision from q)"""


def run_of(t):
    """A run over all listings with gaps."""
    from listing_radar import schemas
    from listing_radar.functions.text import collapse_whitespace
    from listing_radar.plans.enrichment import enrichment_run

    key = F.concat(F.lit("sn-"), F.lpad(F.floor(F.col("doc_id") / 2).cast("string"), 12, "0"))
    url = F.concat(F.lit("https://p/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    pages = t.documents.select(key.alias("promotion_id"), url.alias("url"), "text", now().alias("fetched_at"), F.floor(F.col("doc_id") / 2).alias("k"))
    plain = pages.where("k % 4 = 0").groupBy("promotion_id", "k").agg(F.array_sort(F.collect_list(F.struct("url", collapse_whitespace(F.col("text")).alias("text")))).alias("p"))
    known = {"proposal_id": F.concat(F.lit("old-"), "promotion_id"), "promotion_id": F.col("promotion_id"), "content_hash": ids.content_hash(F.col("p")),
             "generated_at": F.lit("2024-01-10").cast("timestamp"), "status": F.when(F.col("k") % 8 == 0, "accepted").otherwise("rejected")}
    state = plain.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.struct(schemas.ENRICHMENTS)])
    host = F.concat(F.lit("https://www.site"), (F.col("user_id") % 40).cast("string"), F.lit(".example.org/"))
    sources = t.user_sources.withColumns({"ord": F.col("user_id"), "base_url": host})
    return enrichment_run(full(t), pages, sources, state, "gpt-5.6-luna", 800, Decimal("0.2"), 25, 2, 5000, now())


@query("enrichment_run", _RUN + " select id, decision, error from d")
def _(t):
    return run_of(t).queue.select(F.col("promotion_id").alias("id"), "decision", "error")


@query("enrichment_state", _RUN + """ select 'enr-' || id || '-' || lower(left(content_hash, 12)) as proposal_id, 'pending' as status, 0 as warnings from d where decision = 'admitted'
  union all select 'enr-error-' || id || '-20240201000000', 'pending', 1 from d where decision = 'failed'
  union all select 'old-sn-' || lpad(cast(o.row_id as varchar), 12, '0'), case when o.row_id % 8 <> 0 then 'rejected' when decision = 'admitted' then 'stale' else 'accepted' end, 0 from old o left join d using (row_id)""")
def _(t):
    """Proposals after the run: new ones, error rows, stale ones."""
    rows = run_of(t).state
    return rows.select("proposal_id", "status", F.when(F.col("proposal_id").startswith("enr-error"), F.size("warnings")).otherwise(0).alias("warnings"))


@query("enrichment_report", _RUN + """ select count(*) as eligible, count(*) filter (decision = 'admitted') as processed, count(*) filter (decision = 'cached') as cached, count(*) filter (decision = 'overBudget') as budget_skipped,
  count(*) filter (decision = 'failed') as failed, cast(coalesce(sum(cost) filter (decision = 'admitted'), 0) as double) / 1000000 as reserved from d""")
def _(t):
    return run_of(t).report.select("eligible", "processed", "cached", "budget_skipped", "failed", F.col("reserved_max_cost_usd").cast("double").alias("reserved"))


@query("content_hash", """select doc_id % 97 as k, upper(sha256(string_agg('https://p/' || lpad(cast(doc_id as varchar), 9, '0') || chr(10) || text, chr(10) order by doc_id))) as h from documents group by 1""")
def _(t):
    page = F.struct(F.concat(F.lit("https://p/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("url"), "text")
    rows = t.documents.groupBy((F.col("doc_id") % 97).alias("k")).agg(F.array_sort(F.collect_list(page)).alias("p"))
    return rows.select("k", ids.content_hash(F.col("p")).alias("h"))


_REASON = """case when field not in ('priceFrom', 'bedroomsMin', 'address', 'developerName', 'totalUnits', 'builtAreaMinSqm') or (field = 'address' and promotion_id % 2 = 0) then 'notAllowed' when confidence < 0.95 then 'lowConfidence'
   when source_url like '%/x' or l_partkey % 5 = 4 then 'noQuote' when (l_linenumber in (2, 5) and l_partkey % 3 = 0) or trim(value_text) = '' then 'invalidValue' end"""
_VALID = f"""with r as (select *, {_REASON} as reason from proposals), f as (select *, row_number() over (partition by promotion_id, field order by case when reason is null then 0 else 1 end, ord) as rn from r)
  select ord, coalesce(reason, case when rn > 1 then 'duplicate' end) as reject_reason from f"""


@query("validate_proposals", _VALID)
def _(t):
    rows = t.proposals
    allowed = ["priceFrom", "bedroomsMin", "developerName", "totalUnits", "builtAreaMinSqm"]
    keys = rows.select("promotion_id").distinct()
    missing = keys.withColumn("missing", F.concat(F.array(*[F.lit(a) for a in allowed]), F.when(F.col("promotion_id") % 2 == 1, F.array(F.lit("address"))).otherwise(F.array().cast("array<string>"))))
    evidence = keys.select("promotion_id", F.concat(F.lit("https://p.example.org/"), F.col("promotion_id").cast("string")).alias("url"), F.lit("a  QUOTE 0 end quote\n1  end quote 2 end Quote 3 end").alias("text"))
    return N.validate_proposals(rows, evidence, missing, "0.95").select("ord", "reject_reason")


@query("latest_per_promotion", "select promotion_id, arg_max(ord, (generated_at, ord)) as ord from proposals group by 1")
def _(t):
    return N.latest_per_promotion(t.proposals.select("promotion_id", "generated_at", "ord"), "generated_at", "ord").select("promotion_id", "ord")


# one proposal per order and line group, with its fields
_FIELDS = """select 'pr-' || cast(promotion_id as varchar) || '-' || cast(l_linenumber % 2 as varchar) as proposal_id, promotion_id, field, ord, value_text, case when l_returnflag = 'A' then 'accepted' when l_returnflag = 'R' then 'rejected' else 'pending' end as field_status,
   l_returnflag = 'A' or l_returnflag = 'R' as field_reviewed, case when promotion_id % 5 = 0 then 'stale' when promotion_id % 3 = 0 then 'accepted' else 'pending' end as proposal_status, promotion_id % 3 = 0 as proposal_reviewed from (select *, row_number() over (partition by promotion_id, field order by ord) as rn from proposals) where rn = 1"""
shared(field_rows=_FIELDS)


def field_rows(t, told=("ord", "value_text", "source_url", "evidence_text", "confidence")):
    """``told``: columns beside keys and statuses; the first rows are taken as structs, of which the optimizer leaves nothing out."""
    from listing_radar.operators.scale import first_per_key

    proposals = t.proposals.select("promotion_id", "field", "l_linenumber", "l_returnflag", *dict.fromkeys(["ord", *told]))
    rows = first_per_key(proposals, ["promotion_id", "field"], [F.col("ord")])
    flag = F.col("l_returnflag")
    stamp = F.lit("2024-01-20").cast("timestamp")
    key = F.col("promotion_id")
    return rows.select(
        F.concat(F.lit("pr-"), key.cast("string"), F.lit("-"), (F.col("l_linenumber") % 2).cast("string")).alias("proposal_id"), "promotion_id", "field", *told,
        F.when(flag == "A", "accepted").when(flag == "R", "rejected").otherwise("pending").alias("field_status"), F.when(flag.isin("A", "R"), stamp).alias("field_reviewed_at"),
        F.when(key % 5 == 0, "stale").when(key % 3 == 0, "accepted").otherwise("pending").alias("proposal_status"), F.when(key % 3 == 0, stamp).alias("proposal_reviewed_at"))


@query("proposal_status", "select proposal_id, case when bool_or(field_status = 'pending') then 'pending' when bool_or(field_status = 'accepted') then 'accepted' else 'rejected' end as status from field_rows group by 1")
def _(t):
    return N.statuses_from_fields(field_rows(t, ()))


@query("review_field_counts", """with l as (select proposal_id, bool_and(field_status = 'pending' and not field_reviewed) and bool_or(proposal_reviewed) as legacy from field_rows group by 1)
  select case when legacy then proposal_status else field_status end as status, count(*) as n from field_rows join l using (proposal_id) group by 1""")
def _(t):
    return N.review_field_counts(field_rows(t, ()))


_DECIDE = """with d as (select distinct proposal_id, case when promotion_id % 4 = 0 then null when promotion_id % 4 = 1 then 'priceFrom' else 'bedroomsMin' end as field, case when promotion_id % 7 = 0 then 'maybe' when promotion_id % 2 = 0 then 'accepted' else 'rejected' end as decision from field_rows),
  f as (select proposal_id, count(*) filter (field_status = 'pending') as np, max(field) filter (field_status = 'pending') as single, bool_or(proposal_status = 'stale') as stale, list(field) as names from field_rows group by 1),
  c as (select d.*, coalesce(d.field, case when np = 1 then single end) as target, case when decision = 'maybe' then 'decisionNotAllowed' when stale then 'staleProposal' when d.field is null and np <> 1 then case when np = 0 then 'nothingPending' else 'fieldNeeded' end
    when not list_contains(names, coalesce(d.field, single)) then 'unknownField' end as reason from d join f using (proposal_id))"""


def decisions(t):
    key = F.col("promotion_id")
    # a field fixes its line number, so the lines name the same proposals as their first rows per field
    rows = t.proposals.select("promotion_id", (F.col("l_linenumber") % 2).alias("half")).distinct()
    return rows.select(F.concat(F.lit("pr-"), key.cast("string"), F.lit("-"), F.col("half").cast("string")).alias("proposal_id"), F.when(key % 4 == 0, F.lit(None).cast("string")).when(key % 4 == 1, "priceFrom").otherwise("bedroomsMin").alias("field"),
                       F.when(key % 7 == 0, "maybe").when(key % 2 == 0, "accepted").otherwise("rejected").alias("decision"), key.alias("seq"))


@query("apply_field_review", _DECIDE + """, n as (select r.proposal_id, r.field, case when c.proposal_id is not null then c.decision else r.field_status end as field_status, r.proposal_status from field_rows r left join c on c.proposal_id = r.proposal_id and c.target = r.field and c.reason is null),
  s as (select proposal_id, case when bool_or(field_status = 'pending') then 'pending' when bool_or(field_status = 'accepted') then 'accepted' else 'rejected' end as s from n group by 1)
  select n.proposal_id, n.field, n.field_status, case when n.proposal_id in (select proposal_id from c where reason is null) then s.s else n.proposal_status end as proposal_status from n join s using (proposal_id)""")
def _(t):
    out, _ = N.apply_field_review(field_rows(t, ()), decisions(t), now())
    return out.select("proposal_id", "field", "field_status", "proposal_status")


@query("refused_reviews", _DECIDE + " select proposal_id, reason from c where reason is not null")
def _(t):
    _, refused = N.apply_field_review(field_rows(t, ()), decisions(t), now())
    return refused.select("proposal_id", "reason")


shared(proposal_rows="""select 'pr-' || cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as proposal_id, l_orderkey as promotion_id, arg_min(l_shipdate, l_partkey * 1000 + l_suppkey) as generated_at, min(l_partkey) % 10 as h,
   case min(l_partkey) % 3 when 0 then 'accepted' when 1 then 'pending' else 'rejected' end as status from lineitem group by l_orderkey, l_linenumber""")


def proposal_rows(t):
    low = F.min("l_partkey")
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_shipdate", F.col("l_partkey") * 1000 + F.col("l_suppkey")).cast("timestamp").alias("generated_at"), low.alias("low"))
    return rows.select(F.concat(F.lit("pr-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("proposal_id"), F.col("l_orderkey").alias("promotion_id"), "generated_at",
                       (F.col("low") % 10).cast("string").alias("content_hash"), F.when(F.col("low") % 3 == 0, "accepted").when(F.col("low") % 3 == 1, "pending").otherwise("rejected").alias("status"),
                       F.lit(None).cast("timestamp").alias("reviewed_at"))


@query("cache_skip", "with n as (select promotion_id, arg_max(h, (generated_at, proposal_id)) as h from proposal_rows group by 1) select o_orderkey, coalesce(n.h = o_orderkey % 10, false) as cached from orders left join n on n.promotion_id = o_orderkey")
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderkey").alias("promotion_id"), (F.col("o_orderkey") % 10).cast("string").alias("content_hash"))
    return N.cache_skip(rows, proposal_rows(t)).select("o_orderkey", "cached")


@query("mark_stale_and_upsert", """with n as (select promotion_id, arg_max(proposal_id, (generated_at, proposal_id)) as newest from proposal_rows group by 1), f as (select 'pr-' || cast(o_orderkey as varchar) || '-3' as proposal_id, o_orderkey as promotion_id, o_orderkey % 10 as h from orders where o_orderkey % 4 = 0)
  select p.proposal_id, case when f.promotion_id is not null and n.newest = p.proposal_id and p.status = 'accepted' and p.h <> f.h then 'stale' else p.status end as status from proposal_rows p join n using (promotion_id) left join f on f.promotion_id = p.promotion_id where p.proposal_id not in (select proposal_id from f)
  union all select proposal_id, 'pending' from f""")
def _(t):
    fresh = t.orders.where("o_orderkey % 4 = 0").select(F.concat(F.lit("pr-"), F.col("o_orderkey").cast("string"), F.lit("-3")).alias("proposal_id"), F.col("o_orderkey").alias("promotion_id"), now().alias("generated_at"),
                                                        (F.col("o_orderkey") % 10).cast("string").alias("content_hash"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("reviewed_at"))
    return N.mark_stale_and_upsert(proposal_rows(t), fresh, now()).select("proposal_id", "status")


@query("review_queue_order", "select proposal_id, row_number() over (order by case when status = 'pending' then 0 else 1 end, generated_at desc, upper(name), proposal_id) as place from proposal_rows join promotions on row_id = promotion_id")
def _(t):
    rows = proposal_rows(t).join(t.promotions.select(F.col("row_id").alias("promotion_id"), F.col("name").alias("promotion_name")), "promotion_id")
    return place_in_order(rows, N.review_queue_order()).select("proposal_id", "place")


_ACCEPT = """with p as (select proposal_id, promotion_id, bool_and(field_status = 'pending' and not field_reviewed) as legacy from field_rows group by 1, 2 having promotion_id % 4 <> 1 and promotion_id % 6 <> 2),
  a as (select f.*, row_number() over (partition by f.promotion_id, f.field order by f.ord) as rn from field_rows f join p using (proposal_id) where legacy or f.field_status = 'accepted')"""


def accepted(t):
    rows = field_rows(t)
    item = F.struct("ord", "field", "value_text", "source_url", "evidence_text", "confidence", F.col("field_status").alias("status"), F.col("field_reviewed_at").alias("reviewed_at"))
    key = F.col("promotion_id")
    # a proposal has at most one row per field, so its array is short
    proposals = rows.groupBy("proposal_id", "promotion_id").agg(F.array_sort(F.collect_list(item)).alias("fields"))
    return proposals.withColumns({
        "status": F.when(key % 4 == 1, "rejected").otherwise("accepted"), "reviewed_at": F.lit("2024-01-20").cast("timestamp"),
        "evidence_fetched_at": F.when(key % 6 == 2, F.lit("2023-12-01").cast("timestamp")).otherwise(F.lit("2024-01-10").cast("timestamp"))})


@query("accepted_still_valid", _ACCEPT + " select proposal_id, field from a")
def _(t):
    return N.accepted_still_valid(accepted(t), now()).select("proposal_id", "field")


@query("apply_accepted_enrichment", _ACCEPT + """, v as (select promotion_id, max(case when field = 'priceFrom' then try_cast(value_text as decimal(14,2)) end) as price, max(case when field = 'bedroomsMin' then try_cast(value_text as int) end) as beds,
    max(case when field = 'address' then value_text end) as addr from a group by 1)
  select p.id, cast(coalesce(p.price_from, v.price) as double) as price_from, cast(coalesce(p.bedrooms_min, v.beds) as double) as bedrooms_min, coalesce(p.address, v.addr) as address,
   (p.price_from is null and v.price is not null)::int + (p.bedrooms_min is null and v.beds is not null)::int + (p.address is null and v.addr is not null)::int as proofs from promotions p left join v on v.promotion_id = p.row_id""")
def _(t):
    rows = N.accepted_still_valid(accepted(t), now()).withColumn("promotion_id", F.concat(F.lit("sn-"), F.lpad(F.col("promotion_id").cast("string"), 12, "0")))
    out = N.apply_accepted(full(t), rows.where("field in ('priceFrom', 'bedroomsMin', 'address')"))
    return out.select("id", num("price_from"), num("bedrooms_min"), "address", F.size("evidence").alias("proofs"))


_BUDGET = """with recursive q as (select o_orderkey as k, row_number() over (order by o_custkey, o_orderkey) as ord, cast(o_totalprice as decimal(14,2)) as cost, o_orderkey % 6 = 0 as cached from orders),
  g as (select cast(0 as bigint) as ord, cast(0 as decimal(18,2)) as spent, 0 as calls union all
    select n.ord, n.spent, n.calls from (select (select min(q.ord) from q where q.ord > g.ord and not q.cached and g.spent + q.cost <= 2000000.00) as ord, g.spent + (select q.cost from q where q.ord = (select min(q.ord) from q where q.ord > g.ord and not q.cached and g.spent + q.cost <= 2000000.00)) as spent, g.calls + 1 as calls
     from g where g.calls < 25) n where n.ord is not null)
  select q.k, case when (select count(*) from g where ord > 0) = 25 and q.ord > (select max(ord) from g) then 'notReached' when cached then 'cached' when q.ord in (select ord from g) then 'admitted' else 'overBudget' end as decision from q"""


@query("budget_admission", _BUDGET)
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_totalprice").cast("decimal(14,2)").alias("cost"), (F.col("o_orderkey") % 6 == 0).alias("cached"))
    return N.budget_admission(rows, ["o_custkey", "k"], "cost", Decimal("2000000.00"), 25).select("k", "decision")


# a call uses a quarter of its reserve, or all of it
_USED = "case when o_orderkey % 3 = 0 then cast(o_totalprice as decimal(14,2)) else cast(cast(o_totalprice as decimal(14,2)) / 4 as decimal(14,2)) end"


@query("budget_admission_used", _BUDGET.replace("o_orderkey % 6 = 0 as cached", f"{_USED} as used, o_orderkey % 6 = 0 as cached").replace("g.spent + (select q.cost from q", "g.spent + (select q.used from q").replace("2000000.00", "1500000.00"))
def _(t):
    """What a call has used replaces its reserve once it has ended."""
    rows = t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_totalprice").cast("decimal(14,2)").alias("cost"), (F.col("o_orderkey") % 6 == 0).alias("cached"), F.expr(_USED).alias("used"))
    return N.budget_admission(rows, ["o_custkey", "k"], "cost", Decimal("1500000.00"), 25, "used").select("k", "decision")


@query("max_cost", """select doc_id, cast(round((octet_length(encode(text)) + 256) * (case doc_id % 3 when 0 then 1.0 when 1 then 2.5 else 5.0 end) + 800 * (case doc_id % 3 when 0 then 6.0 when 1 then 15.0 else 30.0 end), 0) as double) / 1000000 as usd from documents""")
def _(t):
    model = F.element_at(F.array(F.lit("gpt-5.6-luna"), F.lit("gpt-5.6-terra"), F.lit("gpt-5.6-sol")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", scores.max_cost(model, F.col("text"), F.lit(800)).cast("double").alias("usd"))


_TOK = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) * 100 as i, cast(l_quantity as bigint) * 10 as c, l_linenumber as w, l_partkey % 50 as o from lineitem"


@query("usage_cost", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(greatest(i - c - w, 0) * 1.0 + c * 0.1 + w * 1.25 + o * 6.0, 0) as double) / 1000000 as usd from ({_TOK})")
def _(t):
    rows = t.lineitem.withColumns({"i": F.col("l_quantity").cast("long") * 100, "c": F.col("l_quantity").cast("long") * 10, "o": F.col("l_partkey") % 50})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scores.usage_cost(F.lit("gpt-5.6-luna"), F.col("i"), F.col("c"), F.col("l_linenumber"), F.col("o")).cast("double").alias("usd"))


@query("usage_totals", f"select sum(i) as input_tokens, sum(c) as cached_input_tokens, sum(w) as cache_write_tokens, sum(o) as output_tokens, 0 as reasoning_tokens, sum(i + o) as total_tokens, cast(sum(cast(o as decimal(12,6)) / 1000) as double) as estimated_cost_usd from ({_TOK})")
def _(t):
    rows = t.lineitem.select((F.col("l_quantity").cast("long") * 100).alias("input_tokens"), (F.col("l_quantity").cast("long") * 10).alias("cached_input_tokens"), F.col("l_linenumber").cast("long").alias("cache_write_tokens"),
                             (F.col("l_partkey") % 50).alias("output_tokens"), F.lit(0).alias("reasoning_tokens"))
    rows = rows.withColumns({"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "estimated_cost_usd": (F.col("output_tokens") / 1000).cast("decimal(12,6)")})
    return N.usage_totals(rows).withColumn("estimated_cost_usd", F.col("estimated_cost_usd").cast("double"))


@query("last_runs", "select event_id as run_id from events order by ts desc, event_id desc limit 100")
def _(t):
    return N.last_runs(t.events.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))).select("run_id")
