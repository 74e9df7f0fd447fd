"""URL expressions, policies and request planning."""

from pyspark.sql import functions as F

from listing_radar.functions import urls as U
from listing_radar.operators import backfill as B, candidates as C, links as L
from listing_radar.operators.scale import place_in_order
from listing_radar.queries.registry import query, shared

_Q = """list_sort(list_filter(list_transform(list_filter(string_split(ltrim(q, '?'), '&'), lambda s: s <> ''),
      lambda s: {'k': url_decode(split_part(s, '=', 1)), 'v': case when contains(s, '=') then url_decode(substr(s, instr(s, '=') + 1)) else '' end}),
      lambda p: not starts_with(lower(p.k), 'utm_') and not list_contains(['fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'source'], lower(p.k))))"""


def duck_url(source: str, key: str, column: str) -> str:
    """Reference SQL of URL normalization for URLs without dot segments: (key, normalized)."""
    return f"""(with p as (select {key}, trim({column}) as raw, regexp_extract(trim({column}), '^([hH][tT][tT][pP][sS]?)://([^/?#]+)([^?#]*)([?][^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) as m from {source}),
      b as (select {key}, raw, m.s as s, regexp_replace(lower(m.h), ':[0-9]*$', '') as h, rtrim(m.p, '/') as path, m.q as q from p),
      n as (select {key}, raw, s, h, path, array_to_string(list_transform({_Q}, lambda p: url_encode(p.k) || '=' || url_encode(p.v)), '&') as q from b)
      select {key}, case when s = '' then raw else 'https://' || h || case when path = '' then '/' else path end || case when coalesce(q, '') = '' then '' else '?' || q end end as normalized from n)"""


_MESSY = """(case page_id % 6 when 0 then url when 1 then replace(url, '://', '://') || '' when 2 then upper(substr(url, 1, 5)) || substr(url, 6)
  when 3 then url || case when url like '%?%' then '' else '?b=2&a=1%20x&GCLID=9' end when 4 then regexp_replace(url, '(example[.][a-z]+)', 'EXAMPLE.org:8080') else ' ' || url || ' ' end)"""


@query("normalize_url", "with m as (select page_id, " + _MESSY + " as u from pages) select page_id, normalized from " + duck_url("m", "page_id", "u") + " x")
def _(t):
    return t.pages.select("page_id", U.normalize_url(F.expr(_MESSY)).alias("normalized"))


@query("host_and_domain", """select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host,
  case when starts_with(url, 'https:') then regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www[.]', '') end as domain from pages""")
def _(t):
    return t.pages.select("page_id", U.host_of(F.col("url")).alias("host"), U.domain_of(F.col("url")).alias("domain"))


@query("host_suffix_match", """select page_id, len(list_filter(['example.org', 'ththhe.example.com', 'spam-farm.example.net'], lambda d:
    regexp_extract(url, '^https?://([^/?#]+)', 1) = d or ends_with(regexp_extract(url, '^https?://([^/?#]+)', 1), '.' || d))) > 0 as hit from pages""")
def _(t):
    domains = F.array(*[F.lit(d) for d in ["example.org", "ththhe.example.com", "spam-farm.example.net"]])
    return t.pages.select("page_id", U.host_matches(U.host_of(F.col("url")), domains).alias("hit"))


@query("path_words", """select page_id, translate(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/-_', '   ') as words from pages""")
def _(t):
    return t.pages.select("page_id", U.path_words(F.col("url")).alias("words"))


shared(
    raw_links="""select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) + 1)) as pos from pages""",
    page_links_abs="""select page_id, url, pos, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) || list_aggregate(list_transform(string_split(href, ''),
        lambda c: case when regexp_matches(c, '[A-Za-z0-9._~:/?#@!$&''()*+,;=%-]') then c else url_encode(c) end), 'string_agg', '') as target from raw_links""",
)


def page_links(t):
    """(page_id, url, pos, href, target) of every anchor."""
    from listing_radar.sources.html import html_facts

    rows = html_facts(t.pages).select("page_id", "url", F.posexplode("links").alias("i", "l"))
    return rows.select("page_id", "url", (F.col("i") + 1).alias("pos"), F.col("l.href").alias("href"),
                       U.resolve_url(F.col("url"), F.col("l.href")).alias("target"))


@query("resolve_url", "select page_id, pos, target from page_links_abs")
def _(t):
    return page_links(t).select("page_id", "pos", "target")


_BLOCK = "select unnest(['spam-farm.example.org', '.cheap-pills.example.com', 'ththhe.example.com']) as domain"
_SRC = "select n_nationkey as source_id, case n_nationkey % 3 when 0 then ['example.org'] when 1 then ['example.com', 'example.net'] else cast([] as varchar[]) end as allowed_hosts from nation"
_POLICY_URL = """(case page_id % 9 when 0 then 'ftp://x.example.org/a' when 1 then 'http://10.0.' || cast(page_id % 250 as string) || '.1/a' when 2 then 'http://172.' || cast(page_id % 40 as string) || '.0.1/'
  when 3 then 'https://db.internal/x' else url end)"""
_V4 = """(regexp_matches(h, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') and (split_part(h, '.', 1) = '10' or (split_part(h, '.', 1) = '172' and cast(split_part(h, '.', 2) as int) between 16 and 31)))"""

shared(policy_urls=f"select page_id, page_id % 25 as source_id, {_POLICY_URL} as url from pages",
       policy=f"""with b as ({_BLOCK}), s as ({_SRC}), u as (select p.*, regexp_extract(p.url, '^https?://([^/?#]+)', 1) as h, allowed_hosts from policy_urls p join s using (source_id))
  select page_id, source_id, url, case when not regexp_matches(url, '^https?://') then 'unsupportedScheme'
   when exists (select 1 from b where h = ltrim(domain, '.') or ends_with(h, '.' || ltrim(domain, '.'))) then 'blockedDomain'
   when ends_with(h, '.internal') or {_V4} then 'privateNetwork'
   when len(allowed_hosts) > 0 and len(list_filter(allowed_hosts, lambda a: h = a or ends_with(h, '.' || a))) = 0 then 'blockedDomain' else 'none' end as skip_reason from u""")


def policy(t):
    urls = t.pages.select("page_id", (F.col("page_id") % 25).cast("int").alias("source_id"), F.expr(_POLICY_URL).alias("url"))
    empty = F.array().cast("array<string>")
    sources = t.nation.select(F.col("n_nationkey").cast("int").alias("source_id"), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("example.org")))
                              .when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("example.com"), F.lit("example.net"))).otherwise(empty).alias("allowed_hosts"))
    blocked = t.spark.createDataFrame([("spam-farm.example.org",), (".cheap-pills.example.com",), ("ththhe.example.com",)], "domain string")
    return L.url_policy(urls, sources, blocked)


@query("url_policy", "select page_id, url, skip_reason from policy")
def _(t):
    return policy(t).select("page_id", "url", "skip_reason")


@query("crawl_report", """select source_id, count(*) as urls_discovered, count(*) filter (skip_reason = 'none') as urls_fetched, count(*) filter (skip_reason <> 'none') as urls_skipped,
  coalesce(string_agg(distinct skip_reason, ',' order by skip_reason) filter (skip_reason <> 'none'), '') as skip_reasons from policy group by source_id""")
def _(t):
    return L.crawl_report(policy(t))


@query("public_ip", """with a as (select event_id, cast(event_id % 256 as varchar) || '.' || cast((event_id // 7) % 256 as varchar) || '.' || cast((event_id // 3) % 256 as varchar) || '.1' as host,
    event_id % 256 as a, (event_id // 7) % 256 as b, (event_id // 3) % 256 as c from events)
  select event_id, a between 1 and 223 and a not in (10, 127) and not (a = 100 and b between 64 and 127) and not (a = 169 and b = 254) and not (a = 172 and b between 16 and 31)
   and not (a = 192 and b in (0, 168)) and not (a = 198 and b in (18, 19)) and not (a = 198 and b = 51 and c = 100) and not (a = 203 and b = 0 and c = 113) as public from a""")
def _(t):
    host = F.expr("concat_ws('.', cast(event_id % 256 as string), cast((event_id div 7) % 256 as string), cast((event_id div 3) % 256 as string), '1')")
    return t.events.select("event_id", U.is_public_ip(host).alias("public"))


# robots files: the events of a user, in order, as lines
_LINE = """(case event_type when 'signup' then case when event_id % 2 = 0 then 'User-agent: *' else 'user-agent: bot' end
  when 'view' then 'Disallow: /' || cast(cast(floor(value) as int) % 40 as string) || ' # old' when 'click' then 'Sitemap: https://h' || cast(user_id as string) || '.example.org/s' || cast(event_id % 9 as string) || '.xml'
  when 'purchase' then '# note: x' else 'Disallow:' end)"""
shared(robots=f"""with l as (select 'h' || cast(user_id as varchar) || '.example.org' as host, event_id as line_no, trim(split_part({_LINE}, '#', 1)) as line from events),
   k as (select host, line_no, lower(trim(split_part(line, ':', 1))) as k, trim(substr(line, instr(line, ':') + 1)) as value from l where contains(line, ':')),
   a as (select *, last_value(case when k = 'user-agent' then value end ignore nulls) over (partition by host order by line_no rows between unbounded preceding and current row) as agent from k)
  select host, case when k = 'sitemap' then 'sitemap' else 'disallow' end as kind, value, line_no from a where k = 'sitemap' or (k = 'disallow' and agent = '*' and value <> '')""")


def robots(t):
    lines = t.events.select(F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.org")).alias("host"),
                            F.col("event_id").alias("line_no"), F.expr(_LINE).alias("line"))
    return L.robots_rules(lines, F.floor(F.col("line_no") / 1000))


@query("robots_rules", "select host, kind, value, line_no from robots")
def _(t):
    return robots(t)


_RURL = "('https://h' || cast(o_custkey % 160 as string) || '.example.org/' || cast(o_orderkey % 60 as string) || '/p?x=' || cast(o_orderkey as string))"


@query("robots_filter", f"""with u as (select o_orderkey, {_RURL} as url from orders), h as (select *, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '^https?://[^/]+(.*)$', 1) as path from u)
  select o_orderkey from h where not exists (select 1 from robots r where r.kind = 'disallow' and r.host = h.host and starts_with(h.path, r.value))""")
def _(t):
    urls = t.orders.select("o_orderkey", F.expr(_RURL).alias("url"))
    return L.robots_filter(urls, robots(t)).select("o_orderkey")


_REL = ["promocion", "obra-nueva", "obra_nueva", "residencial", "viviendas", "chalets", "adosados", "pareados", "unifamiliares", "proyectos", "proximamente", "nueva-fase", "cooperativa"]
_LURL = """('https://' || case o_orderkey % 4 when 0 then 'a.example.org' when 1 then 'example.org' when 2 then 'other.net' else 'b.example.com' end || '/' ||
  case o_orderkey % 11 when 0 then 'promocion/viviendas' when 1 then 'login' when 2 then 'obra-nueva' when 3 then 'doc.PDF' when 4 then 'Residencial?cart=1' when 5 then 'wanted' when 6 then 'skip/chalets' else 'x' end || '/' || cast(o_orderkey as string))"""


@query("link_relevance", f"""with u as (select o_orderkey, {_LURL} as url from orders), h as (select *, regexp_extract(url, '^https?://([^/]+)', 1) as host, lower(regexp_extract(url, '^https?://[^/]+(.*)$', 1)) as p from u)
  select o_orderkey, len(list_filter({_REL}, lambda r: contains(p, r))) as relevant from h where (host = 'example.org' or ends_with(host, '.example.org') or host = 'b.example.com')
   and not regexp_matches(p, 'login|logout|carrito|cart|cookies|privacidad|privacy|legal|calendar|wp-admin')
   and (contains(p, 'wanted') or len(list_filter({_REL}, lambda r: contains(p, r))) > 0 or ends_with(regexp_extract(p, '^[^?]*'), '.pdf')) and not contains(p, 'skip')""")
def _(t):
    links = t.orders.select("o_orderkey", F.expr(_LURL).alias("url"))
    out = L.link_relevance(links, F.array(F.lit("example.org"), F.lit("b.example.com")), F.array(F.lit("Wanted")), F.array(F.lit("SKIP")))
    return out.select("o_orderkey", L.relevant_terms(F.col("url")).alias("relevant"))


@query("link_priority", f"""with u as (select o_orderkey, {_LURL} as url from orders), h as (select *, lower(regexp_extract(url, '^https?://[^/]+(.*)$', 1)) as p from u)
  select o_orderkey, row_number() over (order by len(list_filter({_REL}, lambda r: contains(p, r))) desc, url, o_orderkey) as place from h""")
def _(t):
    links = t.orders.select("o_orderkey", F.expr(_LURL).alias("url"))
    return place_in_order(links, [*L.link_priority(F.col("url")), F.col("o_orderkey").asc()]).select("o_orderkey", "place")


_SURL = """('https://s.example.org/' || case o_orderkey % 6 when 0 then 'sitemap-' when 1 then 'Promoci' || 'on/' when 2 then 'obra%2Dnueva/' when 3 then 'Ficha/' when 4 then 'chalets/old/' else 'x/' end
  || cast(o_orderkey as string) || case o_orderkey % 6 when 0 then '.xml' else '' end)"""


@query("sitemap_relevance", f"""with u as (select o_orderkey, lower(url_decode(regexp_extract({_SURL}, '^https?://[^/]+(.*)$', 1))) as p from orders)
  select o_orderkey, ends_with(p, '.xml') as is_child from u where ends_with(p, '.xml') or ((contains(p, 'ficha') or
   len(list_filter({[r for r in _REL if r not in ('proximamente', 'nueva-fase')]}, lambda r: contains(p, r))) > 0) and not contains(p, '/old/'))""")
def _(t):
    urls = t.orders.select("o_orderkey", F.expr(_SURL).alias("url"))
    return L.sitemap_relevance(urls, F.array(F.lit("ficha")), F.array(F.lit("/old/"))).select("o_orderkey", "is_child")


@query("thin_page", "select page_id, length(trim(regexp_replace(html, '<[^>]*>?|>', '', 'g'))) < 220 as thin from pages")
def _(t):
    return t.pages.select("page_id", L.thin_page(F.col("html")).alias("thin"))


@query("union_discovered", "with a as (select page_id % 20 as source_id, url, page_id as seq, 0 as list_no from pages union all select page_id % 20, replace(url, 'http:', 'https:') || '#again', page_id, 1 from pages where page_id % 3 = 0), "
       "k as (select row_number() over () as k, * from a), n as (select k, normalized from " + duck_url("k", "k", "url") + " x), "
       "r as (select k.*, n.normalized, row_number() over (partition by source_id, normalized order by list_no, seq) as rn from k join n using (k)) "
       "select source_id, count(*) filter (rn = 1) as kept, count(*) filter (rn > 1) as duplicates, min(url) filter (rn = 1) as first_url from r group by source_id")
def _(t):
    base = t.pages.select((F.col("page_id") % 20).alias("source_id"), "url", F.col("page_id").alias("seq"))
    again = base.where(F.col("seq") % 3 == 0).withColumn("url", F.concat(F.replace("url", F.lit("http:"), F.lit("https:")), F.lit("#again")))
    firsts, extra = L.union_discovered(base, again)
    return firsts.groupBy("source_id").agg(F.count(F.lit(1)).alias("kept"), F.min("url").alias("first_url")).join(extra, "source_id")


@query("search_matrix", """with t as (select source_id, ord as tn, template from (select 'u' || cast(s as varchar) as source_id, unnest(['obra nueva {municipality}', '{municipality} año']) as template, unnest([0, 1]) as ord from (select unnest([7, 15]) as s)))
  select source_id, official_name, tn as template_no, replace(template, '{municipality}', official_name) as query,
   'https://q.example.org/?q=' || url_encode(replace(template, '{municipality}', official_name)) || '&s=' || source_id as url from (select * from municipalities where enabled) m, t""")
def _(t):
    spark = t.spark
    sources = spark.createDataFrame([(f"u{s}", "https://q.example.org/?q={query}&s=u" + str(s), ["obra nueva {municipality}", "{municipality} año"]) for s in (7, 15)],
                                    "source_id string, url_template string, search_query_templates array<string>")
    return B.search_matrix(t.municipalities, sources)


@query("dated_urls", """with d as (select source_id, url_template, cadence, unnest(case cadence when 'daily' then range(timestamp '2024-01-25', timestamp '2024-03-03', interval 1 day)
     when 'monthly' then range(timestamp '2024-01-01', timestamp '2024-03-02', interval 1 month) else [timestamp '2024-03-02'] end) as day from user_sources)
  select source_id, replace(replace(replace(url_template, '{date:yyyyMMdd}', strftime(day, '%Y%m%d')), '{date:yyyyMM}', strftime(day, '%Y%m')), '{date:dd%2FMM%2Fyyyy}', strftime(day, '%d') || '%2F' || strftime(day, '%m') || '%2F' || strftime(day, '%Y')) as url,
   strftime(min(day), '%Y-%m-%d') as day from d group by 1, 2""")
def _(t):
    rows = B.dated_urls(t.user_sources, F.lit("2024-01-25").cast("date"), F.lit("2024-03-02").cast("date"))
    return rows.select("source_id", "url", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("backfill_batches", """with r as (select source_id, min(day) as a, max(day) as b from source_runs group by 1), s as (select *, unnest(range(0, cast(b - a as bigint) + 1, 7)) as o from r)
  select source_id, o // 7 + 1 as sequence, strftime(a + cast(o as int), '%Y-%m-%d') as first_day, strftime(least(b, a + cast(o as int) + 6), '%Y-%m-%d') as last_day from s""")
def _(t):
    ranges = t.source_runs.groupBy("source_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return B.plan_batches(ranges, 7).select("source_id", "sequence", F.date_format("from", "yyyy-MM-dd").alias("first_day"), F.date_format("to", "yyyy-MM-dd").alias("last_day"))


@query("commercial_filter", """select i.doc_id from items i join doc_sources s using (source_id) where list_contains(s.allowed_hosts, regexp_extract(i.official_url, '^https://([^/]+)', 1))""")
def _(t):
    return C.commercial_filter(t.items, t.doc_sources).select("doc_id")


@query("search_filter", """select doc_id from items where coalesce(municipality_hint, '') <> '' and not (regexp_extract(official_url, '^https://([^/]+)', 1) in ('boe.es', 'src3.example.org')
  or ends_with(regexp_extract(official_url, '^https://([^/]+)', 1), '.boe.es') or ends_with(regexp_extract(official_url, '^https://([^/]+)', 1), '.src3.example.org'))""")
def _(t):
    return C.search_filter(t.items, F.array(F.lit("boe.es"), F.lit("src3.example.org"))).select("doc_id")


@query("detail_url_filter", """with k as (select doc_id, source_id, seq from items where regexp_matches(regexp_extract(official_url, '^https://[^/]+(.*)$', 1), '(?i)/en/|attion')),
  r as (select *, row_number() over (partition by source_id order by seq) as rn from k) select doc_id from r where rn <= 9""")
def _(t):
    return C.detail_url_filter(t.items, F.array(F.lit("/EN/"), F.lit("attion")), 9).select("doc_id")
