"""Logical tables over the driver tables, written once and rendered for both engines.

Each table is a function of a small dialect object, so the query and its reference SQL start from the
same rows. The operators themselves are written independently on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents labels pages".split()
NOW = "2024-02-01 00:00:00"


class Spark:
    name = "spark"

    @staticmethod
    def array(*values: str) -> str:
        return f"array({', '.join(values)})"

    @staticmethod
    def pick(values: list[str], index: str) -> str:
        return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} as int) + 1)"

    @staticmethod
    def days(start: str, n: str) -> str:
        return f"timestampadd(DAY, cast({n} as int), timestamp'{start}')"

    @staticmethod
    def hours(start: str, n: str) -> str:
        return f"timestampadd(HOUR, cast({n} as int), timestamp'{start}')"

    @staticmethod
    def rules(pairs: list[tuple[str, str]]) -> str:
        if not pairs:
            return "cast(array() as array<struct<url_pattern:string,status:string>>)"
        return "array(" + ", ".join(f"named_struct('url_pattern', '{p}', 'status', '{s}')" for p, s in pairs) + ")"

    @staticmethod
    def first_line(c: str) -> str:
        return f"split_part({c}, '\\n', 1)"

    no_strings = "cast(array() as array<string>)"


class Duck:
    name = "duck"

    @staticmethod
    def array(*values: str) -> str:
        return f"[{', '.join(values)}]"

    @staticmethod
    def pick(values: list[str], index: str) -> str:
        return f"([{', '.join(repr(v) for v in values)}])[cast({index} as int) + 1]"

    @staticmethod
    def days(start: str, n: str) -> str:
        return f"(timestamp '{start}' + to_days(cast({n} as int)))"

    @staticmethod
    def hours(start: str, n: str) -> str:
        return f"(timestamp '{start}' + to_hours(cast({n} as int)))"

    @staticmethod
    def rules(pairs: list[tuple[str, str]]) -> str:
        if not pairs:
            return "cast([] as struct(url_pattern varchar, status varchar)[])"
        return "[" + ", ".join(f"{{'url_pattern': '{p}', 'status': '{s}'}}" for p, s in pairs) + "]"

    @staticmethod
    def first_line(c: str) -> str:
        return f"split_part({c}, chr(10), 1)"

    no_strings = "cast([] as varchar[])"


TABLES: dict[str, Callable] = {}


def table(make: Callable) -> Callable:
    TABLES[make.__name__] = make
    return make


SOURCE_KINDS = ["regionalGazette", "stateGazette", "publicProcurement", "publicLandPortal", "municipalNoticeBoard",
                "officialCommercialWebsite", "industryDirectory", "webSearch"]
PROMOTION_KINDS = ["officialPromoter", "officialMicrosite", "cooperativeManager", "exclusiveMarketer", "builder"]


@table
def places(d) -> str:
    """Gazetteer: words and word pairs that are frequent in the texts."""
    rows = [
        ("Attion", ["The Anea", "ing"], ["Thanedble"], "true"),
        ("Eriner Thanea", ["Of"], [], "true"),
        ("Thtion", ["Thing"], ["Erble", "Thble Erst"], "true"),
        ("De la", ["Ément"], ["La de"], "true"),
        ("That", ["That the"], [], "false"),
        ("With", [], ["From"], "true"),
        ("Thnt-Onre", ["Onre"], ["Ertion"], "true"),
        ("Nicht", [], ["Und", "Dér"], "true"),
    ]

    def strings(values):
        return d.array(*[f"'{v}'" for v in values]) if values else d.no_strings

    return " union all ".join(
        f"select {i} as ord, '{n}' as official_name, {strings(a)} as aliases, {strings(l)} as localities, {e} as enabled"
        for i, (n, a, l, e) in enumerate(rows))


@table
def rule_terms(d) -> str:
    rows = [("tion", "planning"), ("thing", "landDisposal"), ("thble", "planning"), ("of the", "buildingPermit"),
            ("erst", "urbanizationWorks"), ("de de", "surfaceRight"), ("la de", "residentialDevelopment"),
            ("Érin", "other"), ("und", "surfaceRight"), ("que", "urbanizationWorks")]
    return " union all ".join(f"select '{t}' as term, '{k}' as kind" for t, k in rows)


@table
def context_words(d) -> str:
    return " union all ".join(f"select '{t}' as term" for t in ["the", "de", "and the", "der"])


@table
def exclusion_words(d) -> str:
    return " union all ".join(f"select '{t}' as term" for t in ["thwh", "erwh ti"])


@table
def items(d) -> str:
    """Feed items: the first line is the title, the whole text the summary."""
    host = "case doc_id % 5 when 0 then 'sede.gob.es' when 1 then 'www.boe.es' else source || '.example.org' end"
    path = "case when doc_id % 4 = 0 then '/attion-2019/' else '/n/' end"
    return f"""select doc_id, source as source_id,
      case when doc_id % 19 = 0 then '' else 'doc-' || cast(case when doc_id % 12 = 1 and doc_id >= 20 then doc_id - 20 else doc_id end as string) end as external_id,
      {d.first_line('text')} || case doc_id % 6 when 0 then ' Obra nueva' when 1 then ' Plan parcial' when 2 then ' Ordenanza fiscal' else '' end as title,
      text as summary, text,
      'https://' || {host} || {path} || lang || '/' || cast(doc_id as string) as official_url,
      {d.array("'https://www.ref' || cast(doc_id % 7 as string) || '.example.org/a'",
               "'http://plain' || cast(doc_id % 3 as string) || '.example.org/b'",
               "'https://src' || cast(doc_id % 40 as string) || '.example.org/c'")} as related_urls,
      case when doc_id % 13 = 0 then 'attion' when doc_id % 17 = 0 then 'nowhere' end as municipality_hint,
      case when doc_id % 11 = 0 then null else {d.days('2024-01-01', 'doc_id % 30')} end as published_at,
      doc_id as seq from documents"""


@table
def known_urls(d) -> str:
    return "select replace(official_url, 'https://', 'http://') || '/?utm_source=x#y' as url from items where doc_id % 23 = 0"


@table
def doc_sources(d) -> str:
    n = "cast(substr(source, 4) as int)"
    return f"""select source as source_id, 'Source ' || source as source_name, {d.pick(SOURCE_KINDS, n + ' % 8')} as source_kind,
      'daily' as cadence, case when {n} % 5 = 4 then 'with' end as fixed_municipality, {n} % 7 = 0 as ignore_exclusion_terms,
      {n} % 10 <> 9 as enabled,
      case when {n} % 3 = 0 then {d.rules([('/12', 'rejected'), ('/1', 'monitoring')])}
           when {n} % 3 = 1 then {d.rules([('/7', 'verifiedSource')])} else {d.rules([])} end as review_rules,
      {d.array("source || '.example.org'", "'www.boe.es'")} as allowed_hosts, {n} as ord
      from (select distinct source from documents) s"""


@table
def user_sources(d) -> str:
    """One source per user, with its kind, place and request template."""
    return f"""select 'u' || cast(user_id as string) as source_id, 'User ' || cast(user_id as string) as source_name,
      {d.pick(SOURCE_KINDS, 'user_id % 8')} as source_kind,
      {d.pick(['daily', 'monthly', 'once'], 'user_id % 3')} as cadence,
      case when user_id % 8 = 4 then 'NATION_' || cast(user_id % 25 as string) end as fixed_municipality,
      user_id % 29 <> 0 as enabled,
      case when user_id % 2 = 0 then 'https://f.example.org/u' || cast(user_id as string) || '/' || '{{date:yyyyMMdd}}.xml'
           else 'https://f.example.org/u' || cast(user_id as string) || '/' || '{{date:yyyyMM}}?d=' || '{{date:dd%2FMM%2Fyyyy}}' end as url_template,
      {d.array("'www.src' || cast(user_id % 60 as string) || '.example.org'", "'shop' || cast(user_id as string) || '.example.org'")} as allowed_hosts,
      user_id from (select distinct user_id from events) u"""


@table
def source_runs(d) -> str:
    """One run per event, in time order."""
    return """select 'u' || cast(user_id as string) as source_id, event_id as run_id, cast(ts as timestamp) as checked_at,
      event_type <> 'error' as success,
      case when event_type in ('error', 'view') then 0 else cast(ceil(value) as int) end as items_read,
      case when event_type in ('error', 'view') then 0 else cast(ceil(value) as int) % 7 end as candidates_matched,
      case when event_type = 'error' then 'failed ' || cast(event_id % 3 as string) end as error,
      cast(ts as date) as day from events"""


@table
def municipalities(d) -> str:
    return """select n_nationkey as ord, n_name as official_name, n_nationkey % 11 <> 3 as enabled,
      case when n_nationkey % 7 = 5 then null else 36 + n_nationkey * 0.25 end as latitude,
      case when n_nationkey % 9 = 4 then null else -4 + n_nationkey * 0.125 end as longitude from nation"""


@table
def promotions(d) -> str:
    """One listing per order."""
    k = "o_orderkey"
    return f"""select 'sn-' || lpad(cast({k} as string), 12, '0') as id, {k} as row_id, c_name as name, n_name as municipality,
      case when {k} % 4 = 0 then null else 'Local ' || cast({k} % 9 as string) end as locality,
      case when {k} % 5 = 0 then null else 'Calle ' || cast({k} % 50 as string) end as address,
      case when {k} % 3 = 0 then null else 40 + (n_nationkey % 10) * 0.5 + ({k} % 7) * 0.001 end as latitude,
      case when {k} % 3 = 0 then null else -3 - (n_nationkey % 4) * 0.25 end as longitude,
      case when {k} % 21 = 0 then 'municipalityCentroid' when {k} % 2 = 0 then 'exactCoordinates' else 'unknown' end as location_precision,
      {d.array(f"case when {k} % 2 = 0 then 'Adosado' else 'Pareado' end", "'Independiente'")} as property_types,
      case o_orderstatus when 'F' then 'soldOut' when 'O' then 'onSale' else 'preSales' end as commercial_status,
      {d.pick(['unknown', 'planned', 'licensed', 'underConstruction', 'completed'], f'{k} % 5')} as construction_status,
      {d.pick(PROMOTION_KINDS, "cast(substr(o_orderpriority, 1, 1) as int) - 1")} as source_kind,
      cast(0.45 + ({k} % 50) * 0.01 as decimal(5,2)) as source_confidence,
      case when {k} % 6 = 0 then null else 'Promotora ' || cast({k} % 20 as string) || ' S.L.' end as developer_name,
      case when {k} % 13 = 0 then null else cast(o_totalprice as decimal(14,2)) end as price_from,
      case when {k} % 2 = 0 then null when {k} % 17 = 0 then cast(o_totalprice * 0.5 as decimal(14,2))
           else cast(o_totalprice + 1000 as decimal(14,2)) end as price_to,
      case when {k} % 8 = 0 then null else cast(1 + {k} % 5 as int) end as bedrooms_min,
      case when {k} % 3 = 0 then null else cast(4 + {k} % 3 as int) end as bedrooms_max,
      case when {k} % 7 = 0 then null else cast(1 + {k} % 3 as int) end as bathrooms_min, cast(null as int) as bathrooms_max,
      case when {k} % 9 = 0 then null else cast(50 + {k} % 200 as decimal(14,2)) end as built_area_min_sqm,
      case when {k} % 4 = 0 then null else cast(100 + {k} % 250 as decimal(14,2)) end as built_area_max_sqm,
      case when {k} % 5 = 0 then null else cast(200 + {k} % 900 as decimal(14,2)) end as plot_area_min_sqm,
      cast(null as decimal(14,2)) as plot_area_max_sqm,
      case when {k} % 4 = 1 then null else cast({k} % 10 as int) end as available_units,
      case when {k} % 5 = 2 then null else 'entrega 20' || cast(25 + {k} % 5 as string) end as delivery_date_text,
      'https://www.site' || cast(o_custkey % 50 as string) || '.example.org/p/' || cast({k} as string) as canonical_url,
      {k} % 7 as brochures, {k} % 6 as evidence_count, o_custkey % 50 as site,
      {d.days('2023-12-01', f'{k} % 60')} as first_seen_utc, cast(o_orderdate as timestamp) as last_seen_utc,
      cast(o_orderdate as timestamp) as last_changed_utc, 0 as consecutive_misses, {k} % 9 <> 0 as active
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""


@table
def previous_promotions(d) -> str:
    """The snapshot before: some rows missing, some with other values, some that are gone now."""
    same = ("name, municipality, construction_status, price_to, available_units, delivery_date_text, built_area_min_sqm, "
            "built_area_max_sqm, plot_area_min_sqm, plot_area_max_sqm, first_seen_utc, last_seen_utc, last_changed_utc")
    return f"""select id, row_id, case when row_id % 7 = 0 then cast(price_from * 1.05 as decimal(14,2)) else price_from end as price_from,
      case when row_id % 11 = 0 then 'announced' else commercial_status end as commercial_status, {same},
      case when row_id % 9 = 0 then 3 else 0 end as consecutive_misses, active from promotions where row_id % 10 <> 0
      union all
      select 'sx-' || lpad(cast(row_id as string), 12, '0') as id, row_id, price_from, commercial_status, {same},
      cast(row_id % 4 as int) as consecutive_misses, row_id % 4 <> 3 as active from promotions where row_id % 150 = 7"""


@table
def duplicates(d) -> str:
    """Listings of which several share a page or name, place and developer."""
    return """select p_partkey as row_id, p_name as name, p_brand as municipality, p_type || '|' || cast(p_size as string) as developer_name,
      'https://dup.example.org/' || lpad(cast(p_partkey - p_partkey % 2 as string), 10, '0') as canonical_url,
      case when p_partkey % 3 = 0 then null else cast(p_retailprice as decimal(14,2)) end as price_from,
      case when p_partkey % 4 <> 0 then null else cast(p_retailprice + 1 as decimal(14,2)) end as price_to,
      case when p_partkey % 5 = 0 then 40 + p_partkey % 7 end as latitude, case when p_partkey % 5 = 0 then -3 - p_partkey % 3 end as longitude,
      cast(0.4 + (p_partkey % 6) * 0.1 as decimal(5,2)) as source_confidence, p_partkey % 6 as precision_no from part"""


@table
def proposals(d) -> str:
    """Proposed field values: the field comes from the line number, the confidence from the discount."""
    fields = ["priceFrom", "bedroomsMin", "address", "developerName", "totalUnits", "builtAreaMinSqm", "nickname"]
    return f"""select l_orderkey as promotion_id, l_linenumber, l_partkey, l_suppkey,
      {d.pick(fields, 'l_linenumber - 1')} as field,
      cast(1 - l_discount as decimal(5,2)) as confidence,
      case when l_linenumber in (2, 5) and l_partkey % 3 = 0 then 'many' when l_linenumber in (2, 5) then cast(l_partkey % 9 as string)
           when l_partkey % 17 = 0 then ' ' else cast(cast(l_extendedprice as decimal(14,2)) as string) end as value_text,
      'https://p.example.org/' || cast(l_orderkey as string) || case when l_partkey % 19 = 0 then '/x' else '' end as source_url,
      'Quote  ' || cast(l_partkey % 5 as string) || ' END' as evidence_text,
      cast(l_shipdate as timestamp) as generated_at, l_quantity as cost,
      l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 as ord,
      l_returnflag, l_linestatus from lineitem"""


def _spread(df: DataFrame, name: str) -> DataFrame:
    """Texts in fewer file splits than there are cores go to all of them; never so with large inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if name not in ("documents", "pages") or len(df.inputFiles()) >= cores or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Logical (or base) table as a DataFrame."""
    if name in BASE:
        return _spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)
    text = TABLES[name](Spark)
    used = [t for t in [*BASE, *TABLES] if t != name and re.search(rf"\b(from|join)\s+{t}\b", text)]
    if used:
        text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: logical(spark, sf_dir, t) for t in used})


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text with the logical tables the body needs, in dependency order."""
    texts = {n: make(Duck) for n, make in TABLES.items()} | (extra or {})
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in texts:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text, re.I):
                visit_name(name)

    def visit_name(name: str) -> None:
        visit(texts[name])
        if name not in needed:
            needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{n} as ({texts[n]})" for n in needed)
    stripped = body.lstrip()
    if stripped.lower().startswith("with recursive "):
        return f"with recursive {head},\n{stripped[15:]}"
    if stripped.lower().startswith("with "):
        return f"with {head},\n{stripped[5:]}"
    return f"with {head}\n{stripped}"
