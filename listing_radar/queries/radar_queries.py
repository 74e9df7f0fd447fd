"""Matching of feed items, candidate state, runs over time."""

from pyspark.sql import functions as F

from listing_radar import schemas
from listing_radar.operators import backfill as B, candidates as C, health as H, matching as M
from listing_radar.operators.scale import place_in_order
from listing_radar.queries.logical import NOW
from listing_radar.queries.registry import duck_clean, duck_norm, duck_ts, num, query, shared, ts
from listing_radar.queries.urls_queries import duck_url
from listing_radar.plans.radar import RadarCatalog, match
from listing_radar.session import cut_to_table

_KINDS = "['landDisposal', 'surfaceRight', 'planning', 'urbanizationWorks', 'buildingPermit', 'residentialDevelopment', 'other']"

shared(
    norm_items=f"select *, {duck_norm('title || chr(32) || summary')} as s from items",
    gaz_words=f"""select ord, official_name, {duck_norm('term')} as term from (select ord, official_name, unnest(list_concat([official_name], localities)) as term, 0 as least from places where enabled
       union all select ord, official_name, unnest(aliases), 7 from places where enabled) where length({duck_norm('term')}) >= greatest(least, 1)""",
    word_hits="""select seq, official_name from (select seq, official_name, row_number() over (partition by seq order by length(term) desc, ord) as rn
       from norm_items join gaz_words on contains(' ' || s || ' ', ' ' || term || ' ')) where rn = 1""",
    gaz_raw=f"""select term, arg_max(official_name, k) as official, min(k) as place from (select {duck_norm('term')} as term, official_name, ord * 100 + pos as k from (
       select ord, official_name, unnest(list_concat([official_name], aliases, localities)) as term, unnest(range(len(list_concat([official_name], aliases, localities)))) as pos from places)) where term <> '' group by term""",
    term_hits=f"select seq, term, kind from norm_items join (select term, kind, {duck_norm('term')} as nt from rule_terms) r on contains(' ' || s || ' ', ' ' || nt || ' ')",
    kind_counts="select seq, kind, count(*) as n from term_hits group by 1, 2",
    top_kind=f"select seq, kind from (select seq, kind, row_number() over (partition by seq order by n desc, list_position({_KINDS}, kind)) as rn from kind_counts) where rn = 1",
    term_lists="select seq, count(*) as rules, string_agg(term, '|' order by upper(term)) as terms, list(term order by upper(term)) as term_list from term_hits group by 1",
    flags=f"""select seq, bool_or(contains(' ' || s || ' ', ' the ') or contains(' ' || s || ' ', ' de ') or contains(' ' || s || ' ', ' and the ') or contains(' ' || s || ' ', ' der ')) as ctx,
       bool_or(contains(' ' || s || ' ', ' thwh ') or contains(' ' || s || ' ', ' erwh ti ')) as excl from norm_items group by seq""",
    resolved="""select n.seq, case when coalesce(trim(n.municipality_hint), '') <> '' then h.official_name when coalesce(trim(d.fixed_municipality), '') <> '' then f.official_name else w.official_name end as municipality
       from norm_items n join doc_sources d using (source_id) left join (select * from places where enabled) h on lower(h.official_name) = lower(n.municipality_hint)
       left join (select * from places where enabled) f on lower(f.official_name) = lower(d.fixed_municipality) left join word_hits w on w.seq = n.seq""",
    known_norm="select lower(normalized) as normalized from " + duck_url("known_urls", "url", "url") + " x",
    item_norm="select seq, lower(normalized) as normalized from " + duck_url("items", "seq", "official_url") + " x",
    matched=f"""select 'lead-' || left(sha256(n.source_id || '|' || (case when trim(n.external_id) = '' then n.official_url else n.external_id end) || '|' || r.municipality), 20) as id,
       n.doc_id, n.seq, n.source_id, d.source_name, d.source_kind, n.external_id, {duck_clean('n.title', 240)} as title, {duck_clean('n.summary', 800)} as summary, n.official_url, n.related_urls, n.published_at, r.municipality, k.kind,
       least(case when d.source_kind = 'webSearch' then 0.70 else 0.90 end, case when d.source_kind = 'webSearch' then 0.45 else 0.65 end + (l.rules - 1) * 0.05) as confidence, l.terms, l.term_list,
       case when n.seq in (select seq from item_norm where normalized in (select normalized from known_norm)) then 'verifiedSource'
            else coalesce((list_filter(d.review_rules, lambda x: contains(lower(n.official_url), lower(x.url_pattern)))[1]).status, 'new') end as status
       from norm_items n join doc_sources d using (source_id) join resolved r on r.seq = n.seq join term_lists l on l.seq = n.seq join top_kind k on k.seq = n.seq join flags f on f.seq = n.seq
       where d.enabled and r.municipality is not null and f.ctx and (d.ignore_exclusion_terms or not f.excl) and trim(n.title) <> ''""",
    candidates="""select m.* exclude (status, rn), m.status as hit_status, case when l.toxic = 1 then 'rejected' when l.quality = 1 then 'verifiedSource' when l.doc_id is not null then 'monitoring' else 'new' end as status,
       timestamp '2024-01-01' + to_hours(cast(m.doc_id % 400 as int)) as first_seen from (select *, row_number() over (partition by id order by seq desc) as rn from matched) m left join labels l on l.doc_id = m.doc_id where m.rn = 1""",
)


def catalog(t, with_known=True):
    return RadarCatalog(t.doc_sources, t.places, t.rule_terms, t.context_words, t.exclusion_words, t.known_urls if with_known else None)


def now():
    return F.lit(NOW).cast("timestamp")


def matched(t):
    return match(t.items, catalog(t), now())


def candidates(t):
    """Latest hit per id with a status from the labels."""
    hits = matched(t)
    rows = hits.groupBy("id").agg(F.max_by(F.struct(*[c for c in hits.columns if c != "id"]), "seq").alias("r")).select("id", "r.*")
    labels = t.labels.select(F.col("doc_id").alias("seq"), "quality", "toxic")
    status = (F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "verifiedSource").when(F.col("toxic").isNotNull(), "monitoring").otherwise("new"))
    rows = rows.join(labels, "seq", "left").withColumn("status", status)
    first = F.expr("timestampadd(HOUR, cast(seq % 400 as int), timestamp'2024-01-01')")
    return rows.withColumn("first_seen_utc", first).drop("quality", "toxic")


def state(rows):
    return rows.select(*schemas.struct(schemas.CANDIDATES).names)


@query("gazetteer_match_words", "select n.seq, official_name as municipality from norm_items n left join word_hits using (seq)")
def _(t):
    from listing_radar.functions.text import normalize_text

    return M.match_words(t.items, normalize_text(F.concat_ws(" ", "title", "summary")), t.places, "municipality").select("seq", "municipality")


@query("gazetteer_match_words_joined", "select n.seq, official_name as municipality from norm_items n left join word_hits using (seq)")
def _(t):
    """Same result through exploded word runs and a join, as for a catalog that is too large for literals."""
    from listing_radar.functions.text import normalize_text

    return M.match_words(t.items, normalize_text(F.concat_ws(" ", "title", "summary")), t.places, "municipality", literal_rows=0).select("seq", "municipality")


CATALOG_SQL = """select seq, official as municipality from (select n.seq, g.official, row_number() over (partition by n.seq order by length(g.term) desc, g.place) as rn from norm_items n
  left join gaz_raw g on contains(n.s, g.term)) where rn = 1"""


@query("gazetteer_match_catalog", CATALOG_SQL)
def _(t):
    return M.match_catalog(t.items, F.concat_ws(" ", "title", "summary"), t.places, "municipality").select("seq", "municipality")


@query("gazetteer_match_catalog_joined", CATALOG_SQL)
def _(t):
    """Same result through the anchor grams of the spellings, as for a catalog that is too large for literals."""
    return M.match_catalog(t.items, F.concat_ws(" ", "title", "summary"), t.places, "municipality", literal_rows=0).select("seq", "municipality")


@query("resolve_municipality", "select seq, municipality from resolved")
def _(t):
    from listing_radar.functions.text import normalize_text

    rows = t.items.join(t.doc_sources.select("source_id", "fixed_municipality"), "source_id")
    rows = M.match_words(rows, normalize_text(F.concat_ws(" ", "title", "summary")), t.places, "by_text")
    return M.resolve_municipality(rows, F.col("by_text"), t.places).select("seq", "municipality")


TERMS_SQL = "select n.seq, coalesce(l.terms, '') as terms, k.kind, f.ctx as has_context, f.excl as is_excluded from norm_items n left join term_lists l using (seq) left join top_kind k using (seq) join flags f using (seq)"


def matched_terms(t, **settings):
    from listing_radar.functions.text import normalize_text

    rows = M.match_terms(t.items, normalize_text(F.concat_ws(" ", "title", "summary")), t.rule_terms, t.context_words, t.exclusion_words, **settings)
    kind = F.when(F.size("matched_rules") > 0, M.dominant_kind(F.col("matched_rules")))
    return rows.select("seq", F.array_join(M.sorted_terms(F.col("matched_rules")), "|").alias("terms"), kind.alias("kind"), "has_context", "is_excluded")


@query("match_terms", TERMS_SQL)
def _(t):
    return matched_terms(t)


@query("match_terms_joined", TERMS_SQL)
def _(t):
    """Same result through exploded word runs and a join, as for word lists that are too large for literals."""
    return matched_terms(t, literal_rows=0)


ITEMS_SQL = f"""select id, seq, source_id, title, sha256(summary) as summary, array_to_string(list_slice(list_distinct_in_order, 1, 10), '|') as related, {duck_ts('published_at')} as published, municipality, kind,
  cast(confidence as double) as confidence, terms, status from (select *, list_filter(related_urls, lambda u: starts_with(u, 'https:')) as list_distinct_in_order from matched)"""


def told_items(rows):
    return rows.select("id", "seq", "source_id", "title", F.sha2("summary", 256).alias("summary"), F.array_join("related_urls", "|").alias("related"), ts("published_at_utc", "published"),
                       "municipality", "kind", num("confidence"), F.array_join("matched_terms", "|").alias("terms"), "status")


@query("match_items", ITEMS_SQL)
def _(t):
    return told_items(matched(t))


@query("match_items_joined", ITEMS_SQL)
def _(t):
    """Same result where neither the words nor the gazetteer fit into literals."""
    c = catalog(t)
    enabled = c.sources.where("enabled")
    return told_items(M.match_items(C.valid_feed_items(t.items), enabled, c.municipalities, c.terms, c.context_terms, c.exclusion_terms, c.known_urls, now(), literal_rows=0))


@query("known_url_status", "select seq, normalized in (select normalized from known_norm) as is_known from item_norm")
def _(t):
    return M.mark_known_urls(t.items, "official_url", t.known_urls, "seq").select("seq", "is_known")


@query("review_rule_status", "select i.seq, (list_filter(d.review_rules, lambda x: contains(lower(i.official_url), lower(x.url_pattern)))[1]).status as status from items i join doc_sources d using (source_id)")
def _(t):
    rows = t.items.join(t.doc_sources, "source_id")
    return rows.select("seq", M.review_rule_status(F.col("official_url"), F.col("review_rules")).alias("status"))


@query("first_per_key_capped", """with k as (select seq, source_id, lower(case when trim(external_id) = '' then official_url else external_id end) as k from items), f as (select source_id, k, min(seq) as seq from k group by 1, 2),
  r as (select *, row_number() over (partition by source_id order by seq) as rn from f) select source_id, seq from r where rn <= 30""")
def _(t):
    return C.first_per_key_capped(t.items, 30).select("source_id", "seq")


@query("distinct_by_url_capped", """with q as (select seq, source_id, doc_id % 9 as query_no, 'https://r' || cast(doc_id % 70 as varchar) || '.example.org' as url from items),
  a as (select *, row_number() over (partition by source_id, query_no order by seq) as rn from q), b as (select *, row_number() over (partition by source_id, url order by query_no, seq) as ru from a where rn <= 4),
  c as (select *, row_number() over (partition by source_id order by query_no, seq) as rt from b where ru = 1) select source_id, seq from c where rt <= 12""")
def _(t):
    rows = t.items.withColumns({"query_no": F.col("doc_id") % 9, "official_url": F.concat(F.lit("https://r"), (F.col("doc_id") % 70).cast("string"), F.lit(".example.org"))})
    return C.distinct_by_url_capped(rows, 4, 12).select("source_id", "seq")


_PREV = """select id, doc_id, case when doc_id % 4 = 0 then 'old title' else title end as title, case doc_id % 5 when 0 then 'rejected' when 1 then 'stale' when 2 then 'monitoring' when 3 then 'verifiedSource' else 'new' end as status,
  timestamp '2023-12-01' as first_seen, timestamp '2023-12-20' as last_seen from (select *, row_number() over (partition by id order by seq desc) as rn from matched) where rn = 1 and doc_id % 3 <> 0"""
_FOLD = """with prev as (select * from previous_candidates), h as (select id, bool_or(status = 'verifiedSource') as v, arg_min(status, seq) filter (status in ('rejected', 'stale')) as c, bool_or(status = 'monitoring') as m, count(*) as hits,
   arg_max(title, seq) as title from matched where doc_id % 7 <> 1 group by id)
  select coalesce(h.id, p.id) as id, coalesce(h.title, p.title) as title, case when h.id is null then p.status when v then 'verifiedSource' when coalesce(p.status, 'new') not in ('new', 'monitoring') then p.status
   when c is not null then c when m then 'monitoring' else coalesce(p.status, 'new') end as status, strftime(case when p.id is null then timestamp '2024-02-01' else p.first_seen end, '%Y-%m-%d') as first_seen,
   strftime(case when h.id is null then p.last_seen else timestamp '2024-02-01' end, '%Y-%m-%d') as last_seen, p.id is null as is_new, coalesce(h.hits, 0) as hits from prev p full join h on h.id = p.id"""
shared(previous_candidates=_PREV)


def previous(t, hits=None):
    hits = matched(t) if hits is None else hits
    rows = hits.groupBy("id").agg(F.max_by(F.struct(*[c for c in hits.columns if c != "id"]), "seq").alias("r")).select("id", "r.*").where("seq % 3 <> 0")
    old = F.expr("case seq % 5 when 0 then 'rejected' when 1 then 'stale' when 2 then 'monitoring' when 3 then 'verifiedSource' else 'new' end")
    rows = rows.withColumns({"title": F.when(F.col("seq") % 4 == 0, "old title").otherwise(F.col("title")), "status": old,
                             "first_seen_utc": F.lit("2023-12-01").cast("timestamp"), "last_seen_utc": F.lit("2023-12-20").cast("timestamp")})
    return state(rows)


@query("upsert_candidates", _FOLD)
def _(t):
    rows = C.upsert_candidates(previous(t), matched(t).where("seq % 7 <> 1"), [F.col("seq")])
    day = "yyyy-MM-dd"
    return rows.select("id", "title", "status", F.date_format("first_seen_utc", day).alias("first_seen"), F.date_format("last_seen_utc", day).alias("last_seen"), "is_new", "hits")


@query("backfill_upsert", _FOLD.replace("where doc_id % 7 <> 1", "where doc_id % 7 <> 1 and published_at is not null").replace("arg_max(title, seq)", "arg_max(title, date_part('day', published_at) * 1000000 // 5 * 0 + ((cast(published_at as date) - date '2024-01-01') // 5) * 1000000000 + seq)")
       .replace("arg_min(status, seq)", "arg_min(status, ((cast(published_at as date) - date '2024-01-01') // 5) * 1000000000 + seq)"))
def _(t):
    hits = matched(t).where("seq % 7 <> 1 and published_at_utc is not null")
    rows = B.backfill(previous(t), B.tag_batches(hits, F.lit("2024-01-01").cast("date"), 5))
    day = "yyyy-MM-dd"
    return rows.select("id", "title", "status", F.date_format("first_seen_utc", day).alias("first_seen"), F.date_format("last_seen_utc", day).alias("last_seen"), "is_new", "hits")


_BATCH = "((cast(published_at as date) - date '2024-01-01') // 5 + 1)"
_GOOD = f"doc_id % 7 <> 1 and published_at is not null and {_BATCH} % 3 <> 0"


def failing_batches(t, hits):
    """Dated hits in batches of five days, and the batches, of which every third failed."""
    hits = B.tag_batches(hits.where("seq % 7 <> 1 and published_at_utc is not null"), F.lit("2024-01-01").cast("date"), 5)
    days = F.floor(F.datediff(F.to_date("published_at"), F.lit("2024-01-01").cast("date")) / 5).cast("int") + 1
    read = t.items.where("published_at is not null").groupBy("source_id", days.alias("batch")).agg(F.count(F.lit(1)).alias("items_read"))
    return hits, read.withColumn("success", F.col("batch") % 3 != 0)


@query("backfill_failing", _FOLD.replace("doc_id % 7 <> 1", _GOOD).replace("arg_max(title, seq)", f"arg_max(title, {_BATCH} * 1000000000 + seq)").replace("arg_min(status, seq)", f"arg_min(status, {_BATCH} * 1000000000 + seq)"))
def _(t):
    """Every third batch failed: its hits leave no trace, later batches go on."""
    found = cut_to_table(matched(t))  # read by both: texts are matched once
    hits, batches = failing_batches(t, found)
    rows = B.backfill(previous(t, found), hits, batches)
    day = "yyyy-MM-dd"
    return rows.select("id", "title", "status", F.date_format("first_seen_utc", day).alias("first_seen"), F.date_format("last_seen_utc", day).alias("last_seen"), "is_new", "hits")


@query("backfill_report_failing", f"""with b as (select source_id, {_BATCH} as batch, count(*) as items from items where published_at is not null group by 1, 2),
  h as (select id, source_id, {_BATCH} as batch from matched where {_GOOD}), n as (select source_id, batch, count(*) as n from (select id, source_id, min(batch) as batch from h group by 1, 2) where id not in (select id from previous_candidates) group by 1, 2),
  m as (select source_id, batch, count(*) as m from h group by 1, 2)
  select b.source_id, bool_and(b.batch % 3 <> 0) as complete, sum(case when b.batch % 3 <> 0 then items else 0 end)::bigint as items_read, coalesce(sum(m), 0)::bigint as candidates_matched, coalesce(sum(n), 0)::bigint as new_candidates,
    (coalesce(sum(m), 0) - coalesce(sum(n), 0))::bigint as updated_candidates, count(*) as batches from b left join m using (source_id, batch) left join n using (source_id, batch) group by 1""")
def _(t):
    found = cut_to_table(matched(t))  # read three times: texts are matched once
    hits, batches = failing_batches(t, found)
    return B.backfill_report(B.batch_results(previous(t, found), hits, batches))


@query("apply_configured_reviews", """select c.id, case when r.status is not null and c.status in ('new', 'monitoring') and d.enabled then r.status else c.status end as status,
   coalesce(r.status <> c.status and c.status in ('new', 'monitoring') and d.enabled, false) as reviewed from (select *, doc_id as k from candidates) c join doc_sources d using (source_id)
   left join (select id, (list_filter(s.review_rules, lambda x: contains(lower(official_url), lower(x.url_pattern)))[1]).status as status from candidates join doc_sources s using (source_id)) r on r.id = c.id""")
def _(t):
    return C.apply_configured_reviews(state(candidates(t)), t.doc_sources).select("id", "status", "reviewed")


@query("review_candidates", "select id, case doc_id % 3 when 0 then 'rejected' when 1 then 'monitoring' else status end as status from candidates")
def _(t):
    rows = candidates(t)
    decided = rows.where("seq % 3 < 2").select(F.col("id").alias("candidate_id"), F.when(F.col("seq") % 3 == 0, "rejected").otherwise("monitoring").alias("status"))
    stray = t.labels.select(F.concat(F.lit("lead-none"), F.col("doc_id").cast("string")).alias("candidate_id"), F.lit("rejected").alias("status"))
    return C.review_candidates(state(rows), decided.unionByName(stray))[0].select("id", "status")


@query("candidate_order", "select id, row_number() over (order by municipality, published_at desc nulls last, id) as place from candidates")
def _(t):
    return place_in_order(candidates(t), C.candidate_order()).select("id", "place")


@query("observed_within", "select id from candidates where status not in ('rejected', 'stale') and cast(coalesce(published_at, timestamp '2024-02-01') as date) between date '2024-01-05' and date '2024-01-20'")
def _(t):
    return C.observed_within(candidates(t), F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")).select("id")


@query("pending_only", "select id from candidates where status in ('new', 'monitoring')")
def _(t):
    return C.pending_only(candidates(t)).select("id")


@query("valid_feed_items", "select seq from items where trim(title) <> ''")
def _(t):
    return C.valid_feed_items(t.items).select("seq")


@query("radar_run_summary", """with u as (""" + _FOLD.replace("with prev as", "with prev as").replace("where doc_id % 7 <> 1", "") + """), s as (select id, arg_max(source_id, seq) as source_id from matched group by id),
  r as (select source_id, count(*) as items_read from items where trim(title) <> '' group by 1)
  select r.source_id, r.items_read, coalesce(sum(u.hits), 0) as candidates_matched, count(*) filter (u.is_new) as new_candidates, coalesce(sum(u.hits - case when u.is_new then 1 else 0 end), 0) as updated_candidates
  from r left join (select u.*, s.source_id from u join s using (id) where hits > 0) u using (source_id) group by 1, 2""")
def _(t):
    rows = C.upsert_candidates(previous(t), matched(t), [F.col("seq")])
    return H.radar_run_summary(C.valid_feed_items(t.items), rows)


# a run in which source 3 failed: the first item of each key, the fold of its hits into the state before, then the sources' review rules
_AFTER_RUN = """with firsts as (select source_id, lower(case when trim(external_id) = '' then official_url else external_id end) as k, min(seq) as seq from items where trim(title) <> '' group by 1, 2),
  run_hits as (select * from matched where seq in (select seq from firsts) and source_id not in (select source_id from doc_sources where ord = 3)),
  h as (select id, bool_or(status = 'verifiedSource') as v, arg_min(status, seq) filter (status in ('rejected', 'stale')) as c, bool_or(status = 'monitoring') as m, max(seq) as seq from run_hits group by id),
  folded as (select coalesce(h.id, p.id) as id, coalesce(h.seq, p.doc_id) as seq, case when h.id is null then p.status when v then 'verifiedSource' when coalesce(p.status, 'new') not in ('new', 'monitoring') then p.status
    when c is not null then c when m then 'monitoring' else coalesce(p.status, 'new') end as status from previous_candidates p full join h on h.id = p.id),
  after_run as (select f.id, w.source_id, w.source_kind, w.municipality, w.related_urls, case when f.status in ('new', 'monitoring') and d.enabled then coalesce((list_filter(d.review_rules, lambda x: contains(lower(w.official_url), lower(x.url_pattern)))[1]).status, f.status) else f.status end as status
    from folded f join matched w on w.seq = f.seq join doc_sources d on d.source_id = w.source_id),
  checked as (select *, case when ord = 3 then 'degraded' else 'healthy' end as status from doc_sources where enabled),
  domains as (select distinct regexp_replace(lower(unnest(allowed_hosts)), '^www[.]', '') as domain, status from checked where source_kind = 'officialCommercialWebsite'),
  referenced as (select distinct regexp_replace(regexp_extract(u, '^https://([^/]+)', 1), '^www[.]', '') as domain from (select unnest(related_urls) as u from after_run where status in ('new', 'monitoring', 'verifiedSource')) where u like 'https:%'),
  direct as (select lower(fixed_municipality) as k, count(*) as n, count(*) filter (status = 'healthy') as ok from checked where source_kind = 'municipalNoticeBoard' group by 1),
  places_after as (select official_name, coalesce(n, 0) as n, coalesce(ok, 0) as ok from places left join direct on k = lower(official_name) where enabled),
  central as (select count(*) filter (status = 'healthy') as ok from checked where source_kind in ('regionalGazette', 'stateGazette', 'publicProcurement', 'publicLandPortal'))"""


def radar_run_of(t):
    """Whole radar run with a failed source."""
    from listing_radar.plans.radar import radar_run

    failures = t.doc_sources.where("ord = 3").select("source_id", F.lit("timeout").alias("error"))
    empty_health = t.spark.createDataFrame([], schemas.SOURCE_HEALTH)
    return radar_run(t.items, failures, previous(t), empty_health, catalog(t), now())


@query("radar_run_candidates", _AFTER_RUN + " select id, source_id, municipality, status from after_run")
def _(t):
    return radar_run_of(t).candidates.select("id", "source_id", "municipality", "status")


@query("candidate_run", _AFTER_RUN + """ select (select count(*) from checked) as enabled_sources, (select count(*) from checked where status = 'healthy') as healthy_sources, (select count(*) from checked where status = 'degraded') as degraded_sources, 0 as failing_sources,
  (select count(*) from checked where source_kind = 'officialCommercialWebsite') as commercial_sources, (select count(*) from checked where source_kind = 'officialCommercialWebsite' and status = 'healthy') as healthy_commercial_sources,
  (select count(distinct domain) from domains) as commercial_domains_monitored, (select count(distinct domain) from domains where status = 'healthy') as healthy_commercial_domains,
  (select count(*) from referenced) as referenced_domains_discovered, (select count(*) from referenced where domain not in (select domain from domains)) as unmonitored_referenced_domains,
  (select count(*) from places_after) as municipalities_total, (select count(*) from places_after where n > 0) as municipalities_with_direct_source, (select count(*) from places_after where ok > 0) as municipalities_with_healthy_direct_source,
  (select count(*) from places_after, central where places_after.ok > 0 or central.ok > 0) as municipalities_with_healthy_coverage, count(*) filter (status in ('new', 'monitoring')) as pending_candidates, count(*) filter (status = 'new') as new_candidates,
  count(*) filter (status = 'monitoring') as monitoring_candidates, count(*) filter (status = 'rejected') as rejected_candidates, count(*) filter (status = 'verifiedSource') as verified_source_candidates, count(*) filter (status = 'stale') as stale_candidates,
  count(distinct lower(municipality)) filter (source_kind = 'officialCommercialWebsite') as municipalities_with_commercial_signals from after_run""")
def _(t):
    """The coverage after the run."""
    return radar_run_of(t).snapshot


@query("enabled_sources", "select source_id, row_number() over (order by source_id) as place from (select 'S' || cast(s_suppkey as varchar) as source_id, s_suppkey from supplier) where s_suppkey % 3 <> 0")
def _(t):
    sources = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_id"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_suppkey") % 3 != 0).alias("enabled"))
    return place_in_order(C.enabled_sources(sources), [F.col("source_id")]).select("source_id", "place")


@query("enabled_source_by_id", "select 'S' || cast(s_suppkey as varchar) as source_id from supplier where s_suppkey = 7")
def _(t):
    sources = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_id"), (F.col("s_suppkey") % 3 != 0).alias("enabled"))
    return C.enabled_sources(sources, "s7").select("source_id")
