"""Source health and coverage over runs derived from events."""

import io
import itertools
import uuid
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from listing_radar import schemas
from listing_radar.operators import backfill as B, health as H
from listing_radar.queries.logical import NOW
from listing_radar.queries.registry import duck_ts, query, shared, ts

_W = "partition by source_id order by checked_at, run_id rows between unbounded preceding and current row"
shared(
    run_marks=f"""select *, max(case when success then checked_at end) over ({_W}) as last_ok, sum(case when success then 1 else 0 end) over ({_W}) as g1,
      sum(case when success and items_read > 0 then 1 else 0 end) over ({_W}) as g2 from source_runs""",
    run_states="""select *, case when not success then case when failures >= 2 then 'failing' else 'degraded' end when items_read = 0 and empties >= 2 and g2 > 0 then 'degraded' else 'healthy' end as status from (
      select *, sum(case when success then 0 else 1 end) over (partition by source_id, g1 order by checked_at, run_id rows between unbounded preceding and current row) as failures,
      sum(case when success and items_read = 0 then 1 else 0 end) over (partition by source_id, g2 order by checked_at, run_id rows between unbounded preceding and current row) as empties from run_marks)""",
    last_state="select * from (select *, row_number() over (partition by source_id order by checked_at desc, run_id desc) as rn from run_states) where rn = 1",
    health=f"""select s.source_id, s.source_kind, s.fixed_municipality, l.failures as consecutive_failures, l.empties as consecutive_empty_runs, coalesce(l.status, 'notChecked') as status, l.checked_at as last_attempt, a.ok as last_success,
      l.checked_at + interval 36 hours as due, s.enabled, s.allowed_hosts from user_sources s left join last_state l using (source_id) left join (select source_id, max(checked_at) filter (success) as ok from source_runs group by 1) a using (source_id) where s.enabled""",
    user_candidates="""select event_id as id, 'NATION_' || cast(event_id % 23 as varchar) as municipality, (['new', 'monitoring', 'rejected', 'verifiedSource', 'stale'])[event_id % 5 + 1] as status, s.source_kind, s.source_id,
      ['https://www.src' || cast(event_id % 90 as varchar) || '.example.org/x', 'http://plain.example.org/y', 'https://shop' || cast(event_id % 250 as varchar) || '.example.org/z'] as related_urls, ts as published_at, ts as last_seen
      from events e join user_sources s on s.source_id = 'u' || cast(e.user_id as varchar)""",
    coverage="""with d as (select lower(fixed_municipality) as k, count(*) as n, count(*) filter (status = 'healthy') as ok, bool_or(last_attempt is not null) as checked, max(last_success) filter (status = 'healthy') as s from health where source_kind = 'municipalNoticeBoard' group by 1),
      c as (select count(*) filter (status = 'healthy') as ok, bool_or(last_attempt is not null) as checked, max(last_success) filter (status = 'healthy') as s from health where source_kind in ('regionalGazette', 'stateGazette', 'publicProcurement', 'publicLandPortal')),
      x as (select municipality, count(*) filter (status = 'new') as a, count(*) filter (status = 'monitoring') as b from user_candidates group by 1)
      select m.official_name as municipality, case when coalesce(d.ok, 0) > 0 and c.ok > 0 then 'directAndCentral' when coalesce(d.ok, 0) > 0 then 'directOnly' when c.ok > 0 then 'centralOnly' when coalesce(d.checked, false) or coalesce(c.checked, false) then 'degraded' else 'notChecked' end as status,
       coalesce(d.n, 0) as configured_direct_sources, coalesce(d.ok, 0) as healthy_direct_sources, c.ok as healthy_central_sources, greatest(d.s, c.s) as last_success, coalesce(x.a, 0) as new_candidates, coalesce(x.b, 0) as monitoring_candidates
      from (select * from municipalities where enabled) m left join d on d.k = lower(m.official_name) cross join c left join x on x.municipality = m.official_name""",
)


def now():
    return F.lit(NOW).cast("timestamp")


def no_health(t):
    return t.spark.createDataFrame([], schemas.SOURCE_HEALTH)


def health(t):
    return H.update_health(no_health(t), t.source_runs, t.user_sources)


def candidates(t):
    rows = t.source_runs.join(t.user_sources, "source_id")
    e = F.col("run_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("new", "monitoring", "rejected", "verifiedSource", "stale")]), (e % 5 + 1).cast("int"))
    urls = F.array(F.concat(F.lit("https://www.src"), (e % 90).cast("string"), F.lit(".example.org/x")), F.lit("http://plain.example.org/y"),
                   F.concat(F.lit("https://shop"), (e % 250).cast("string"), F.lit(".example.org/z")))
    return rows.select(e.alias("id"), F.concat(F.lit("NATION_"), (e % 23).cast("string")).alias("municipality"), status.alias("status"), "source_kind", "source_id",
                       urls.alias("related_urls"), F.col("checked_at").alias("published_at_utc"), F.col("checked_at").alias("last_seen_utc"))


def coverage(t):
    return H.municipality_coverage(t.municipalities, health(t), candidates(t))


@query("run_counters", "select run_id, failures as consecutive_failures, empties as consecutive_empty_runs, status from run_states")
def _(t):
    return H.run_counters(t.source_runs, F.col("day")).select("run_id", "consecutive_failures", "consecutive_empty_runs", "status")


@query("source_health", f"select source_id, consecutive_failures, consecutive_empty_runs, status, {duck_ts('last_success')} as last_success, {duck_ts('due')} as due from health")
def _(t):
    return health(t).select("source_id", "consecutive_failures", "consecutive_empty_runs", "status", ts("last_success_utc", "last_success"), ts("next_check_due_utc", "due"))


@query("source_health_in_steps", "select source_id, consecutive_failures, consecutive_empty_runs, status from health")
def _(t):
    """Three updates in a row, each on the result of the one before."""
    state = no_health(t)
    for first, last in (("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-17"), ("2024-01-17", "2024-03-01")):
        part = t.source_runs.where((F.col("checked_at") >= first) & (F.col("checked_at") < last))
        state = H.update_health(state, part, t.user_sources)
    return state.select("source_id", "consecutive_failures", "consecutive_empty_runs", "status")


@query("drop_removed_sources", "select 'u' || cast(user_id as varchar) as source_id, count(*) as n from events where user_id % 29 <> 0 group by 1")
def _(t):
    rows = t.source_runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return H.drop_removed_sources(rows, t.user_sources)


@query("overdue_sources", "select source_id from health where due < timestamp '2024-01-31 10:00:00'")
def _(t):
    return H.overdue_sources(health(t), F.lit("2024-01-31 10:00:00").cast("timestamp")).select("source_id")


@query("troubled_sources", "select source_id, status from health where status in ('degraded', 'failing')")
def _(t):
    return H.troubled_sources(health(t)).select("source_id", "status")


@query("municipality_coverage", f"select municipality, status, configured_direct_sources, healthy_direct_sources, healthy_central_sources, {duck_ts('last_success')} as last_success, new_candidates, monitoring_candidates from coverage")
def _(t):
    return coverage(t).select("municipality", "status", "configured_direct_sources", "healthy_direct_sources", "healthy_central_sources", ts("last_successful_check_utc", "last_success"), "new_candidates", "monitoring_candidates")


@query("uncovered_municipalities", "select municipality from coverage where status in ('centralOnly', 'degraded', 'notChecked')")
def _(t):
    return H.uncovered_municipalities(coverage(t)).select("municipality")


_REF = "(select distinct regexp_replace(regexp_extract(u, '^https://([^/]+)', 1), '^www[.]', '') as domain from (select unnest(related_urls) as u from user_candidates where status in ('new', 'monitoring', 'verifiedSource')) where u like 'https:%')"
_MON = "(select source_id, regexp_replace(unnest(allowed_hosts), '^www[.]', '') as domain, status from health where source_kind = 'officialCommercialWebsite')"


@query("unmonitored_domains", f"select domain from {_REF} except select domain from {_MON}")
def _(t):
    return H.unmonitored_domains(candidates(t), t.user_sources.where("enabled"))


@query("coverage_snapshot", f"""select (select count(*) from health) as enabled_sources, (select count(*) from health where status = 'healthy') as healthy_sources, (select count(*) from health where status = 'degraded') as degraded_sources,
  (select count(*) from health where status = 'failing') as failing_sources, (select count(distinct domain) from {_MON}) as commercial_domains_monitored, (select count(distinct domain) from {_MON} where status = 'healthy') as healthy_commercial_domains,
  (select count(*) from {_REF}) as referenced_domains_discovered, (select count(*) from {_REF} where domain not in (select domain from {_MON})) as unmonitored_referenced_domains,
  (select count(*) from coverage) as municipalities_total, (select count(*) from coverage where healthy_direct_sources > 0) as municipalities_with_healthy_direct_source,
  (select count(*) from user_candidates where status in ('new', 'monitoring')) as pending_candidates, (select count(*) from user_candidates where status = 'stale') as stale_candidates,
  (select count(distinct municipality) from user_candidates where source_kind = 'officialCommercialWebsite') as municipalities_with_commercial_signals""")
def _(t):
    rows = candidates(t)
    out = H.coverage_snapshot(t.user_sources, health(t), rows, coverage(t))
    return out.select("enabled_sources", "healthy_sources", "degraded_sources", "failing_sources", "commercial_domains_monitored", "healthy_commercial_domains", "referenced_domains_discovered",
                      "unmonitored_referenced_domains", "municipalities_total", "municipalities_with_healthy_direct_source", "pending_candidates", "stale_candidates", "municipalities_with_commercial_signals")


@query("backfill_report", """with b as (select source_id, (day - (select min(day) from source_runs)) // 5 as batch, bool_and(success) as success, sum(items_read) as items_read, sum(candidates_matched) as m from source_runs group by 1, 2)
  select source_id, bool_and(success) as complete, sum(items_read) as items_read, sum(m) as candidates_matched, 0 as new_candidates, 0 as updated_candidates, count(*) as batches from b group by 1""")
def _(t):
    first = t.source_runs.agg(F.min("day").alias("d")).scalar()
    rows = t.source_runs.withColumn("batch", F.floor(F.datediff("day", first) / 5)).groupBy("source_id", "batch").agg(
        F.bool_and("success").alias("success"), F.sum("items_read").alias("items_read"), F.sum("candidates_matched").alias("candidates_matched"))
    return B.backfill_report(rows.withColumns({"new_candidates": F.lit(0), "updated_candidates": F.lit(0)}))


_FEEDS = """f as (select i.*, d.ord % 4 as kind, d.enabled from items i join doc_sources d using (source_id)), bad as (select distinct source_id from f where kind in (1, 3) and seq % 10 = 3),
  n as (select source_id, count(distinct lower(case when trim(external_id) = '' then official_url else external_id end)) as items_read from f where trim(title) <> '' and (kind < 2 or trim(external_id) <> '') group by 1)"""


def feed_documents(t):
    """A document per item, RSS or nested JSON by source; every other source has damaged documents among them."""
    plain = F.regexp_replace("title", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rss = F.concat(F.lit("<rss><channel><item><title>"), text(plain), F.lit("</title><link>"), text(F.col("official_url")), F.lit("</link><guid>"), text(F.col("external_id")), F.lit("</guid></item></channel></rss>"))
    notice = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("external_id").alias("identificador"), plain.alias("titulo"), F.col("official_url").alias("url_html"))).alias("item")).alias("data")))
    rows = t.items.join(t.doc_sources.select("source_id", (F.col("ord") % 4).alias("kind")), "source_id")
    whole = F.when(F.col("kind") < 2, rss).otherwise(notice)
    damaged = F.col("kind").isin(1, 3) & (F.col("seq") % 10 == 3)
    return rows.withColumn("_w", whole).select(
        "kind", "source_id", F.lit("https://feeds.example.org/").alias("source_url"), F.lit("2024-01-31").cast("date").alias("document_date"),
        F.col("seq").alias("seq_base"), F.when(damaged, F.expr("left(_w, length(_w) - 9)")).otherwise(F.col("_w")).alias("content"))


@query("isolate_failures", f"""with {_FEEDS}
  select d.source_id, bad.source_id is null as success, case when bad.source_id is null then coalesce(n.items_read, 0) else 0 end as items_read, case when bad.source_id is null then 0 else 1 end as consecutive_failures,
    case when bad.source_id is null then 'healthy' else 'degraded' end as status, bad.source_id is not null as has_error, coalesce(p.kept, 0) as failed_kept
  from doc_sources d left join bad using (source_id) left join n using (source_id) left join (select source_id, count(*) as kept from (select *, row_number() over (partition by id order by seq desc) as rn from matched) m
    where rn = 1 and doc_id % 3 <> 0 and source_id in (select source_id from bad) group by 1) p using (source_id) where d.enabled""")
def _(t):
    """A radar run over feeds of which some have several damaged documents: one failed run for each such source, whose candidates stay."""
    from listing_radar.plans.radar import radar_run
    from listing_radar.queries import radar_queries as R
    from listing_radar.session import cut_to_table
    from listing_radar.sources.feeds import read_feed

    documents = feed_documents(t)
    read = [read_feed(documents.where(which).drop("kind"), feed) for which, feed in (("kind < 2", "rss"), ("kind >= 2", "nestedJson"))]
    items, failures = (a.unionByName(b) for a, b in zip(*read, strict=True))
    run = radar_run(items, failures, cut_to_table(R.previous(t)), t.spark.createDataFrame([], schemas.SOURCE_HEALTH), R.catalog(t), R.now())
    kept = run.candidates.join(failures.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("failed_kept"))
    runs = run.source_runs.select("source_id", "success", "items_read", F.col("error").isNotNull().alias("has_error"))
    out = runs.join(run.health.select("source_id", "consecutive_failures", "status"), "source_id").join(kept, "source_id", "left")
    return out.select("source_id", "success", "items_read", "consecutive_failures", "status", "has_error", F.coalesce("failed_kept", F.lit(0)).alias("failed_kept"))


@query("archive_members", f"""with e as (select source_id, seq, external_id from items where trim(external_id) <> '' and trim(title) <> ''),
  bad as (select distinct source_id from items where seq % 97 = 5), o as (select source_id, ord from doc_sources)
  select source_id, count(distinct lower(external_id)) as items, false as failed from e join o using (source_id) where source_id not in (select source_id from bad) group by 1
  union all select source_id, 0, true from bad""")
def _(t):
    """Archives of every source, a member per item, some members damaged; each member is read on its own."""
    from listing_radar.session import cut_to_table, shared_folder
    from listing_radar.sources.archives import read_archive_files
    from listing_radar.sources.feeds import read_feed

    folder = f"{shared_folder(t.spark)}/archives-{uuid.uuid4().hex}"
    plain = F.regexp_replace("title", r"[\x00-\x08\x0b\x0c\x0e-\x1f&<>]", " ")
    entry = F.concat(F.lit("<feed><entry><id>"), F.col("external_id"), F.lit("</id><title>"), plain, F.lit("</title><link href='"), F.col("official_url"), F.lit("'/></entry></feed>"))
    rows = t.items.where("trim(external_id) <> '' or seq % 97 = 5").select(
        F.concat("source_id", F.lit("-"), F.expr("seq div 2000"), F.lit(".zip")).alias("file"), "source_id", "seq", entry.alias("content"), (F.col("seq") % 97 == 5).alias("damaged"))
    written = rows.repartition("file").sortWithinPartitions("file", "seq").mapInPandas(lambda batches: write_archives(batches, folder), "source_id string, file string")
    files = cut_to_table(written)
    sources = files.select("source_id", F.lit("https://feeds.example.org/").alias("source_url"), F.lit("2024-01-31").cast("date").alias("document_date"), "file")
    items, failures = read_feed(read_archive_files(t.spark, folder, sources, partition_bytes=1 << 14), "zipAtom")
    return items.groupBy("source_id").agg(F.count("*").alias("items")).withColumn("failed", F.lit(False)).unionByName(
        failures.select("source_id", F.lit(0).cast("long").alias("items"), F.lit(True).alias("failed")))


def write_archives(batches, folder: str):
    """Rows (file, source_id, seq, content, damaged), a file's rows together, to one archive each; damaged members fail their checksum."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    rows = itertools.chain.from_iterable(batch.itertuples(index=False) for batch in batches)
    for file, members in itertools.groupby(rows, key=lambda r: r.file):
        data, spoilt, source = io.BytesIO(), [], None
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as archive:
            for member in members:
                source = member.source_id
                archive.writestr(f"{member.seq:012d}.atom", member.content)
                if member.damaged:
                    spoilt.append(data.tell() - 1)  # the last of the member's stored bytes
        whole = bytearray(data.getvalue())
        for at in spoilt:
            whole[at] ^= 1
        with system.open_output_stream(f"{path}/{file}") as out:
            out.write(bytes(whole))
        yield pd.DataFrame([(source, file)], columns=["source_id", "file"])
