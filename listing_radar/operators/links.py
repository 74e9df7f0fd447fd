"""URL policy, robots rules, link relevance and reachability over tables of already fetched pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions import urls as U
from listing_radar.functions.text import contains_any, contains_any_ci
from listing_radar.operators.scale import (
    broadcast_if_small,
    carry_forward,
    first_per_key,
    is_small,
    join_unique,
    top_n_per_key,
)
from listing_radar.session import cut_lineage, cut_to_table

LITERAL_ROWS = 5_000


def _matching_suffix(df: DataFrame, host: str, domains: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """Flag hosts that equal a listed domain or lie below it, on distinct hosts and by equality."""
    hosts = df.select(*keys, host).distinct()
    suffixes = hosts.select(*keys, host, F.explode(U.host_suffixes(F.col(host))).alias("_domain"))
    hits = suffixes.join(broadcast_if_small(domains), [*keys, "_domain"], "left_semi").select(*keys, host).distinct()
    hits = hits.withColumn(flag, F.lit(True))
    return join_unique(df, hits, [*keys, host], F.col("url"))


def url_policy(urls: DataFrame, sources: DataFrame, blocklist: DataFrame, with_ipv6: bool = False) -> DataFrame:
    """Adds ``skip_reason`` ('none' if the URL may be read): scheme, blocked domain, private network,
    host not allowed for the source, in this order. With catalogs of checked size nothing is shuffled."""
    blocked = blocklist.select(
        F.lower(F.regexp_replace(F.trim("domain"), r"^\.+", "")).alias("_domain")).where("_domain != ''").distinct()
    allowed = sources.select("source_id", F.col("allowed_hosts").alias("_allowed"))
    out = urls.withColumn("_host", F.rtrim(U.host_of(F.col("url")), F.lit(".")))
    if is_small(blocked, LITERAL_ROWS):
        names = [r["_domain"] for r in blocked.collect()]
        listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        out = out.withColumn("_blocked", U.host_matches(F.col("_host"), listed))
    else:
        out = _matching_suffix(out, "_host", blocked, "_blocked", [])
    out = out.join(broadcast_if_small(allowed), "source_id", "left")
    permitted = _allowed_by(F.col("_host"), F.coalesce("_allowed", F.array().cast("array<string>")))
    reason = (
        F.when(~U.is_http_url(F.col("url")), F.lit("unsupportedScheme"))
        .when(F.col("_blocked"), F.lit("blockedDomain"))
        .when(U.is_private_host(F.col("_host"), with_ipv6), F.lit("privateNetwork"))
        .when(~permitted, F.lit("blockedDomain"))
        .otherwise(F.lit("none"))
    )
    return out.withColumn("skip_reason", reason).drop("_host", "_blocked", "_allowed")


def robots_rules(lines: DataFrame, segment: Column) -> DataFrame:
    """(host, kind, value, line_no) from robots lines: Disallow of the last agent line if that is ``*``,
    and every Sitemap."""
    line = F.trim(F.regexp_replace(F.col("line"), r"(?s)#.*$", ""))
    parsed = lines.select(
        "host", "line_no",
        F.lower(F.trim(F.regexp_extract(line, r"(?s)^([^:]*):", 1))).alias("_key"),
        F.trim(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)).alias("value"),
    ).where("_key != ''")
    agent = F.when(F.col("_key") == "user-agent", F.col("value"))
    parsed = carry_forward(parsed, ["host"], segment, [F.col("line_no")], agent, "_agent")
    disallow = (F.col("_key") == "disallow") & (F.col("_agent") == "*") & (F.col("value") != "")
    kind = F.when(disallow, F.lit("disallow")).when(F.col("_key") == "sitemap", F.lit("sitemap"))
    return parsed.withColumn("kind", kind).where("kind is not null").select("host", "kind", "value", "line_no")


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop URLs whose path and query start with a Disallow value of their host.

    Equality instead of a prefix comparison per rule: the prefixes of a URL that are as long as one of
    its host's rules are looked up among the rules.
    """
    disallow = rules.where("kind = 'disallow'").select("host", F.col("value").alias("_prefix")).distinct()
    lengths = disallow.groupBy("host").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    out = urls.withColumns({"host": U.host_of(F.col("url")), "_path": U.path_and_query(F.col("url"))})
    pairs = out.select("host", "_path").distinct().join(broadcast_if_small(lengths), "host")
    prefixes = pairs.select(
        "host", "_path",
        F.explode(F.array_distinct(F.transform("_lengths", lambda n: F.left(F.col("_path"), n)))).alias("_prefix"),
    )
    denied = prefixes.join(broadcast_if_small(disallow), ["host", "_prefix"], "left_semi").select("host", "_path").distinct()
    flagged = join_unique(out, denied.withColumn("_denied", F.lit(True)), ["host", "_path"], F.col("url"))
    return flagged.where("_denied is null").drop("_denied", "_path")


def _allowed_by(host: Column, allowed: Column) -> Column:
    lowered = F.transform(allowed, lambda h: F.lower(F.regexp_replace(h, r"^\.+", "")))
    return (F.size(allowed) == 0) | U.host_matches(host, lowered)


def link_relevance(links: DataFrame, allowed: Column, include: Column, exclude: Column) -> DataFrame:
    """Links worth reading: host allowed, no irrelevant word, a wanted pattern or word or a PDF."""
    url = F.col("url")
    target = F.lower(U.path_and_query(url))
    wanted = (
        (F.size(include) == 0) | contains_any_ci(target, include) | contains_any(target, V.LINK_RELEVANT_TERMS)
        | F.lower(U.path_of(url)).endswith(".pdf")
    )
    return links.where(
        U.is_http_url(url) & _allowed_by(U.host_of(url), allowed) & ~contains_any(target, V.LINK_IRRELEVANT_TERMS)
        & wanted & ~contains_any_ci(target, exclude)
    )


def link_priority(url: Column) -> list[Column]:
    """More relevant words first, then the URL."""
    return [relevant_terms(url).desc(), url.asc()]


def relevant_terms(url: Column) -> Column:
    target = F.lower(U.path_and_query(url))
    return reduce(lambda a, b: a + b, [target.contains(t).cast("int") for t in V.LINK_RELEVANT_TERMS])


def sitemap_relevance(urls: DataFrame, include: Column, exclude: Column) -> DataFrame:
    """Adds ``is_child`` (another sitemap) and keeps children and relevant pages."""
    path = F.lower(U.unescape_data(U.path_of(F.col("url"))))
    child = F.lower(U.path_of(F.col("url"))).endswith(".xml")
    wanted = (F.size(include) == 0) | contains_any_ci(path, include) | contains_any(path, V.SITEMAP_RELEVANT_TERMS)
    return urls.withColumn("is_child", child).where(child | (wanted & ~contains_any_ci(path, exclude)))


def thin_page(html: Column) -> Column:
    """Less than 220 characters outside of tags: the page needs rendering."""
    text = F.trim(F.regexp_replace(html, r"(?s)<[^>]*>?|>", ""))
    return F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < V.THIN_PAGE_LENGTH


def union_discovered(*lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URLs of several discovery lists (earlier list wins): the first spelling per source and normalized
    URL, and the number of duplicates per source. Each list has source_id, url, seq."""
    every = reduce(
        lambda a, b: a.unionByName(b),
        [d.select("source_id", "url", "seq").withColumn("list_no", F.lit(i)) for i, d in enumerate(lists)],
    ).withColumn("normalized", U.normalize_url(F.col("url")))
    firsts = first_per_key(every, ["source_id", "normalized"], [F.col("list_no"), F.col("seq")])
    per_url = every.groupBy("source_id", "normalized").agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return firsts, per_url.groupBy("source_id").agg(F.sum("_extra").alias("duplicates"))


def readable_pages(pages: DataFrame, sources: DataFrame | None = None, blocklist: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Pages (source_id, url) that the URL policy (``sources`` with ``blocklist``) and the robots ``rules`` allow to read."""
    known = pages.select("source_id", "url").distinct()
    if sources is not None:
        known = url_policy(known, sources, blocklist).where("skip_reason = 'none'").select("source_id", "url")
    return known if rules is None else robots_filter(known, rules).select("source_id", "url")


def reachable_pages(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int,
                    spread: str = "url", sources: DataFrame | None = None, blocklist: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Breadth-first reading order over fetched pages: (source_id, url, depth, place).

    ``seeds`` (source_id, url, seq), ``links`` (source_id, from_url, to_url, rank) and ``pages`` use
    normalized URLs. One round per depth: frontier join, first way per URL, minus what was seen. The
    place of a page is the chain of link ranks that leads to it, which sorts like the queue of a
    breadth-first walk without ever numbering a level. The page cap keeps the first ``max_pages``. Pages that
    the policy or the robots rules deny (see ``readable_pages``) open no links and take no place. Only pages that
    a round has reached are looked up and judged, each in its own round; a small frontier is broadcast to pages and
    links, so that neither table is shuffled or made distinct as a whole.
    """
    def reached(frontier: DataFrame) -> DataFrame:
        """The rows of a frontier whose page is there and may be read."""
        keys = frontier.select("source_id", "url")
        met = pages.select("source_id", "url").join(broadcast_if_small(keys), ["source_id", "url"], "left_semi").distinct()
        if sources is not None or rules is not None:
            met = readable_pages(cut_to_table(met), sources, blocklist, rules)
        return cut_to_table(frontier.join(met, ["source_id", "url"], "left_semi"))

    ranked = seeds.withColumn("place", F.format_string("%012d", F.col("seq")))
    frontier = first_per_key(ranked.select("source_id", "url", "place"), ["source_id", "url"], [F.col("place")])
    frontier = cut_lineage(frontier.withColumn("depth", F.lit(0)).select("source_id", "url", "place", "depth"))
    seen, read = frontier, reached(frontier)
    every = read
    for depth in range(1, max_depth + 1):
        opened = read.select("source_id", F.col("url").alias("from_url"), "place")
        steps = links.join(broadcast_if_small(opened), ["source_id", "from_url"]).select(
            "source_id", F.col("to_url").alias("url"), F.concat_ws("/", "place", F.format_string("%06d", "rank")).alias("place"))
        firsts = first_per_key(steps, ["source_id", "url"], [F.col("place")])
        frontier = firsts.join(seen.select("source_id", "url"), ["source_id", "url"], "left_anti")
        frontier = cut_lineage(frontier.withColumn("depth", F.lit(depth)).select("source_id", "url", "place", "depth"))
        if frontier.isEmpty():
            break
        seen, read = seen.unionByName(frontier), reached(frontier)
        every = every.unionByName(read)
    return top_n_per_key(every, ["source_id"], [F.col("depth"), F.col("place")], max_pages, F.col(spread))


def crawl_report(urls: DataFrame) -> DataFrame:
    """Per source: discovered, fetched and skipped counts by skip reason."""
    return urls.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("urls_discovered"),
        F.count_if(F.col("skip_reason") == "none").alias("urls_fetched"),
        F.count_if(F.col("skip_reason") != "none").alias("urls_skipped"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("skip_reason") != "none", F.col("skip_reason")))), ",")
        .alias("skip_reasons"),
    )
