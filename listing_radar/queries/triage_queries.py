"""Review queue and audit."""

from pyspark.sql import functions as F

from listing_radar.operators import audit as A, candidates as C, triage as T
from listing_radar.plans.radar import excluded_listing_hosts
from listing_radar.operators.scale import place_in_order
from listing_radar.queries.health_queries import candidates as user_candidates, coverage
from listing_radar.queries.logical import NOW
from listing_radar.queries.radar_queries import candidates, state
from listing_radar.queries.registry import duck_title, query, shared, ts

_DIRECT = ["obra nueva", "nueva promocion", "promocion", "residencial", "chalets", "viviendas unifamiliares", "cooperativa"]
_ADMIN = ["licencia de obra", "plan parcial", "estudio de detalle", "suelo residencial", "parcela", "derecho de superficie", "urbanizacion"]
_GENERIC = ["borme", "modelo de solicitud", "normas subsidiarias", "ordenanza fiscal", "publicaciones en el bocm", "solicitud de licencia", "texto refundido"]


def _any(text, terms):
    return f"len(list_filter({terms}, lambda t: contains({text}, t))) > 0"


def _loc(corpus):
    return f"(contains({corpus}, place) or contains(regexp_replace({corpus}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'), regexp_replace(place, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')))"


shared(
    pending=f"""select *, {duck_title("concat_ws(' ', title, summary, official_url)")} as corpus, {duck_title("concat_ws(' ', title, official_url)")} as tu, {duck_title('summary')} as su, {duck_title('title')} as ti, {duck_title('municipality')} as place,
      regexp_extract(official_url, '^https://([^/]+)', 1) as domain from candidates where status in ('new', 'monitoring')""",
    masters="""select id, case when length(ti) >= 8 and n > 1 and master <> id then master end as duplicate_of from (select id, ti, count(*) over (partition by place, ti) as n,
      first_value(id) over (partition by place, ti order by confidence desc, first_seen, id) as master from pending)""",
    points=f"""select p.id, p.domain, p.municipality, p.title, m.duplicate_of, {_any('corpus', _DIRECT)} as direct, {_any('corpus', _ADMIN)} as admin, cast(round(confidence * 100) as int)
      + case when {_any('corpus', _DIRECT)} then 15 else 0 end + case when {_any('corpus', _ADMIN)} then 12 else 0 end + case when domain = 'www.boe.es' or ends_with(domain, '.gob.es') then 12 else 0 end
      + case when len(term_list) >= 2 then 5 else 0 end + case when published_at <= timestamp '{NOW}' and published_at >= timestamp '{NOW}' - interval 60 days then 4 else 0 end
      + case when {_loc('tu')} then 10 when {_loc('su')} then -8 else -20 end
      + case when published_at is null and regexp_matches(concat_ws(' ', title, official_url), '20(0[0-9]|1[0-9]|2[0-2])') then -12 else 0 end
      + case when {_any('ti', _GENERIC)} then -20 else 0 end + case when domain in ('src3.example.org', 'boe.es') or ends_with(domain, '.boe.es') then -40 else 0 end as score from pending p join masters m using (id)""",
    queue="""select id, domain, municipality, title, duplicate_of, greatest(least(score, 100), 0) as priority_score, case when duplicate_of is not null then 'possibleDuplicate' when direct then 'directPromotion' when admin then 'administrativeSignal' else 'generalSignal' end as band,
      case when duplicate_of is not null then 'duplicate' when score >= 75 then 'high' when score >= 60 then 'medium' else 'low' end as priority from points""",
)


def now():
    return F.lit(NOW).cast("timestamp")


def hosts():
    return F.array(F.lit("src3.example.org"), F.lit("boe.es"))


def queue(t):
    return T.triage_items(state(candidates(t)), now(), hosts())


@query("duplicate_master", "select id, duplicate_of from masters")
def _(t):
    return T.duplicate_master(C.pending_only(state(candidates(t)))).select("id", "duplicate_of")


@query("triage_score", "select id, domain, band, priority, priority_score from queue")
def _(t):
    return queue(t).select("id", "domain", "band", "priority", "priority_score")


_RANK = "case priority when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end"


@query("triage_order", f"select id, row_number() over (order by {_RANK}, priority_score desc, domain, municipality, title, id) as place from queue")
def _(t):
    return place_in_order(queue(t), T.triage_order()).select("id", "place")


_COUNTS = "count(*) as candidates, count(*) filter (priority = 'high') as high_priority, count(*) filter (priority = 'medium') as medium_priority, count(*) filter (priority = 'low') as low_priority, count(*) filter (priority = 'duplicate') as possible_duplicates"


@query("triage_by_domain", f"select domain, {_COUNTS} from queue group by domain")
def _(t):
    return T.triage_by_domain(queue(t))


@query("triage_summary", f"select {_COUNTS} from queue")
def _(t):
    return T.triage_summary(queue(t))


@query("excluded_listing_hosts", "select distinct lower(unnest(allowed_hosts)) as host from user_sources where source_kind = 'webSearch'")
def _(t):
    return excluded_listing_hosts(t.user_sources.withColumnRenamed("allowed_hosts", "result_excluded_hosts"))


shared(
    observed="select * from user_candidates where status not in ('rejected', 'stale') and cast(published_at as date) between date '2024-01-10' and date '2024-01-12'",
    population="""select m.official_name as municipality, coalesce(c.status, 'notChecked') as coverage_status, coalesce(c.healthy_central_sources, 0) as hc, coalesce(c.healthy_direct_sources, 0) as hd, coalesce(o.n, 0) as n, coalesce(o.a, 0) as central_candidates,
      coalesce(o.b, 0) as direct_candidates, coalesce(o.c, 0) as commercial_candidates, (coalesce(o.a, 0) > 0)::int + (coalesce(o.b, 0) > 0)::int + (coalesce(o.c, 0) > 0)::int as observed_channels, coalesce(o.p, 0) as pending_candidates
      from (select * from municipalities where enabled) m left join (select * from coverage where municipality not like '%2') c on c.municipality = m.official_name left join (select municipality, count(*) as n,
       count(*) filter (source_kind in ('regionalGazette', 'stateGazette', 'publicProcurement', 'publicLandPortal')) as a, count(*) filter (source_kind = 'municipalNoticeBoard') as b, count(*) filter (source_kind = 'officialCommercialWebsite') as c,
       count(*) filter (status in ('new', 'monitoring')) as p from observed where not (municipality like '%5' and source_kind <> 'stateGazette') group by 1) o on o.municipality = m.official_name""",
    audited="""select *, case when observed_channels = 1 and pending_candidates > 0 then 'singleChannelSignal' when hc = 0 or hd = 0 then 'coverageGap' when n = 0 then 'zeroSignalControl' when observed_channels <= 1 then 'singleChannelSignal' else 'crossChannelControl' end as reason from population""",
)


def observed(t):
    rows = C.observed_within(user_candidates(t), F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return rows.where(~(F.col("municipality").like("%5") & (F.col("source_kind") != "stateGazette")))


def population(t):
    return A.audit_by_municipality(t.municipalities, coverage(t).where("municipality not like '%2'"), observed(t))


@query("audit_by_municipality", "select municipality, reason, coverage_status, central_candidates, direct_candidates, commercial_candidates, observed_channels, pending_candidates from audited")
def _(t):
    return population(t).drop("healthy_central_sources", "healthy_direct_sources")


@query("audit_sample", """select municipality, reason from audited order by case reason when 'singleChannelSignal' then 0 when 'coverageGap' then 1 when 'zeroSignalControl' then 2 else 3 end, pending_candidates desc,
  central_candidates + direct_candidates + commercial_candidates desc, municipality limit 7""")
def _(t):
    return A.audit_sample(population(t), 7).select("municipality", "reason")


@query("audit_summary", """select count(*) as population, least(count(*), 7) as actual_sample_size, count(*) filter (observed_channels = 1) as single_channel_municipalities, count(*) filter (hc = 0 or hd = 0) as coverage_gap_municipalities,
  count(*) filter (observed_channels = 0) as zero_signal_municipalities, count(*) filter (observed_channels >= 2) as cross_channel_municipalities,
  (select count(*) from observed where not (municipality like '%5' and source_kind <> 'stateGazette')) as observed_candidates, (select count(*) from observed where status in ('new', 'monitoring') and not (municipality like '%5' and source_kind <> 'stateGazette')) as pending_candidates from audited""")
def _(t):
    return A.audit_summary(population(t), observed(t), 7)
