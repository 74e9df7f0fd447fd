"""Feed files to feed items: (source_id, external_id, title, summary, official_url, related_urls,
municipality_hint, published_at, seq).

``files`` are raw documents as rows (source_id, source_url, document_date, content). Every format is read in one pass that gives
items or, for a document that cannot be read, one row with an ``error``; ``read_feed`` parts them into the items and the failures
that a radar run takes. Repeated elements of XML are taken out by a streaming parser and read with the built-in XPath functions.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from listing_radar.fixed_values import CALENDAR_LINK_FOLDER, NOTICE_LINK_MARK
from listing_radar.functions import urls as U
from listing_radar.functions.dates import parse_feed_date
from listing_radar.functions.text import clean_evidence, normalize_text
from listing_radar.operators.candidates import first_per_key_capped, valid_feed_items
from listing_radar.operators.matching import match_words
from listing_radar.session import cut_to_table
from listing_radar.sources.archives import UNREADABLE, named_members, reason
from listing_radar.sources.html import html_facts
from listing_radar.sources.xml import element_rows

_NO_LINKS = "array<string>"


def read_documents(spark: SparkSession, path: str, source_id: str, source_url: str, document_date: str) -> DataFrame:
    """Whole files as rows, in path order."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return raw.select(
        F.lit(source_id).alias("source_id"), F.lit(source_url).alias("source_url"),
        F.lit(document_date).cast("date").alias("document_date"), "file", F.col("value").alias("content"))


def _elements(files: DataFrame, tag: str, above: tuple[str, ...] = (), roots: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of the given local name, namespaces dropped, in document order, or a row with the document's fault."""
    rows = element_rows(files, tag, above, roots)
    if "seq_base" in files.columns:
        rows = rows.withColumn("seq", F.col("seq_base") + F.col("seq"))
    return rows


def _child(name: str) -> Column:
    return F.trim(F.coalesce(F.xpath_string("xml", F.lit(f"/*/{name}[1]")), F.lit("")))


def _plain_text(c: Column) -> Column:
    """Whole text of an HTML fragment."""
    text = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_html(c: Column) -> Column:
    """Text of an HTML fragment, as stored."""
    return clean_evidence(_plain_text(c), 4_000)


def _items(df: DataFrame, external_id: Column, title: Column, summary: Column, url: Column,
           published: Column | None = None, related: Column | None = None, hint: Column | None = None,
           search: Column | None = None) -> DataFrame:
    """``search`` is the uncut text that matching reads; title and summary are excerpts. A row with an ``error`` has that alone."""
    rows = df.select(
        "source_id", external_id.alias("external_id"), title.alias("title"), summary.alias("summary"),
        url.alias("official_url"),
        (F.array().cast(_NO_LINKS) if related is None else related).alias("related_urls"),
        (F.lit(None).cast("string") if hint is None else hint).alias("municipality_hint"),
        (F.lit(None).cast("timestamp") if published is None else published).alias("published_at"),
        F.col("seq").cast("long").alias("seq"),
        (F.concat_ws(" ", title, summary) if search is None else search).alias("search_text"),
        F.col("error"),
    )
    return rows.select("source_id", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in rows.columns[1:-1]], "error")


def _good(tagged: DataFrame) -> DataFrame:
    return tagged.where("error is null").drop("error")


def _failures(tagged: DataFrame) -> DataFrame:
    """(source_id, error), one row per source with a document that cannot be read."""
    return tagged.where("error is not null").groupBy("source_id").agg(F.min("error").alias("error"))


def _rss(files: DataFrame) -> DataFrame:
    rows = _elements(files, "item")
    guid, link = _child("guid"), _child("link")
    resolved = U.resolve_url(F.col("source_url"), F.when(link != "", link).otherwise(guid))
    return _items(rows, F.when(guid != "", guid).otherwise(resolved), _child("title"), strip_html(_child("description")),
                  resolved, parse_feed_date(_child("pubDate")), search=F.concat_ws(" ", _child("title"), _plain_text(_child("description"))))


def _atom(files: DataFrame) -> DataFrame:
    rows = _elements(files, "entry")
    folder = F.trim(F.coalesce(F.xpath_string("xml", F.lit("(//ContractFolderID)[1]")), F.lit("")))
    author = F.trim(F.coalesce(F.xpath_string("xml", F.lit("(/*/author[1]//name)[1]")), F.lit("")))
    link = F.coalesce(F.xpath_string("xml", F.lit("/*/link[1]/@href")), F.lit(""))
    context = F.xpath("xml", F.lit("//*[self::CityName or self::CountrySubentity or self::ContractFolderID]/text()"))
    context = F.filter(context, lambda v: F.trim(v) != "")
    lowered = F.transform(context, F.lower)
    context = F.array_join(F.filter(context, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1), " ")
    identity, published = _child("id"), _child("published")
    return _items(
        rows, F.when(folder != "", F.concat_ws("|", author, folder)).otherwise(identity), clean_evidence(_child("title"), 500),
        clean_evidence(F.concat_ws(" ", _child("summary"), context), 4_000),
        U.resolve_url(F.col("source_url"), F.when(link != "", link).otherwise(identity)),
        parse_feed_date(F.when(published != "", published).otherwise(_child("updated"))),
        search=F.concat_ws(" ", _child("title"), _child("summary"), context))


def read_archives(archives: DataFrame) -> DataFrame:
    """Members of small zip archives that stand in a column ``archive`` as documents; for files see ``read_archive_files``. What
    cannot be read becomes a row with ``error``."""
    kept = [c for c in archives.columns if c != "archive"]
    schema = T.StructType([*[archives.schema[c] for c in kept], T.StructField("member", T.StringType()),
                           T.StructField("seq_base", T.LongType()), T.StructField("content", T.StringType()), T.StructField("error", T.StringType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                def out(member=None, number=0, content=None, error=None, row=row):
                    values = row[kept].to_dict() | {"member": member, "seq_base": number << 32, "content": content, "error": error}
                    return pd.DataFrame([values], columns=schema.names)

                try:
                    with zipfile.ZipFile(io.BytesIO(row["archive"])) as archive:
                        for number, member in named_members(archive, ".atom"):
                            yield out(member.filename, number, archive.read(member).decode("utf-8", "replace"))
                except UNREADABLE as problem:
                    yield out(error=reason(problem))

    return archives.mapInPandas(read, schema)


@F.udtf(returnType="identifier string, title string, url string, position int, error string")
class NestedNotices:
    """Every object, at any depth, that has an identifier, a title and a link; for text that is no JSON, what is wrong with it."""

    def eval(self, text: str):
        try:
            pending = [json.loads(text)]
        except (TypeError, ValueError, RecursionError) as problem:
            yield None, None, None, None, f"{type(problem).__name__}: {problem}"[:200]
            return
        position = 0
        while pending:
            element = pending.pop()
            if isinstance(element, dict):
                texts = {}
                for key, value in element.items():
                    if isinstance(value, str):
                        texts.setdefault(key.lower(), value.encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip())
                found = [texts.get(k, "") for k in ("identificador", "titulo", "url_html")]
                if all(found):
                    yield (*found, position, None)
                    position += 1
                pending.extend(reversed(list(element.values())))
            elif isinstance(element, list):
                pending.extend(reversed(element))


def _nested_json(files: DataFrame) -> DataFrame:
    rows = files.lateralJoin(NestedNotices(F.col("content").outer())).withColumnRenamed("position", "seq")
    return _items(rows.withColumnRenamed("title", "_t"), F.col("identifier"), F.col("_t"), F.col("_t"), F.col("url"),
                  F.col("document_date").cast("timestamp"))


def _gazette_xml(files: DataFrame) -> DataFrame:
    """Dispositions with the nearest section and authority above them, empty if there is none."""
    rows = _elements(files, "disposicion", ("organismo", "seccion"))
    rows = rows.withColumns({"_authority": F.col("above")[0], "_section": F.col("above")[1]})
    title = _child("titulo")
    return _items(rows, _child("identificador"), clean_evidence(title, 500),
                  clean_evidence(F.concat_ws(" ", "_authority", "_section", _child("rango"), title), 4_000),
                  _child("url_html"), F.col("document_date").cast("timestamp"),
                  search=F.concat_ws(" ", title, "_authority", "_section", _child("rango")))


def _sitemap(files: DataFrame) -> DataFrame:
    rows = _elements(files, "url", roots=("urlset", "sitemapindex"))
    resolved = U.resolve_url(F.col("source_url"), _child("loc"))
    titles = F.array_join(F.filter(F.xpath("xml", F.lit("//title/text()")), lambda t: F.trim(t) != ""), " ")
    whole = F.concat_ws(" ", titles, U.path_words(resolved))
    searchable = clean_evidence(whole, 2_000)
    items = _items(rows, resolved, searchable, searchable, resolved, parse_feed_date(_child("lastmod")), search=whole)
    return items.where(_LINKED)


def sitemap_children(files: DataFrame) -> DataFrame:
    """Child sitemaps of index documents, as absolute URLs, first per URL."""
    rows = _elements(files, "sitemap").where("error is null").select("source_id", "seq", U.resolve_url(F.col("source_url"), _child("loc")).alias("url"))
    rows = rows.where("url != ''")
    return rows.groupBy("source_id", F.lower("url").alias("_k")).agg(F.min_by("url", "seq").alias("url")).drop("_k")


def _search_results(files: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Answers of a search service. The place hint comes from the query, not from the result. ``files`` may number the queries
    (``query_no``); the number is kept and items of a later query come later."""
    schema = ("query string, results array<struct<url:string,title:string,content:string,publishedDate:string,"
              "published_date:string>>, _corrupt_record string")
    answer = F.from_json("content", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = files.withColumn("query_no", (F.col("query_no") if "query_no" in files.columns else F.lit(0)).cast("long")).withColumn("a", answer)
    error = F.when(F.col("a").isNull() | F.col("a._corrupt_record").isNotNull(), "unreadable search answer").when(
        F.col("a.query").isNull() | F.col("a.results").isNull(), "search answer without query or results")
    rows = rows.withColumns({"error": error, "_query": F.col("a.query")})
    official = municipalities.select("official_name", "enabled", "ord", F.array().cast("array<string>").alias("aliases"),
                                     F.array().cast("array<string>").alias("localities"))
    rows = match_words(rows, normalize_text(F.col("_query")), official, "_hint")
    rows = rows.select("source_id", "query_no", "_hint", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("a.results"))).alias("pos", "r"))
    url, title = F.col("r.url"), F.col("r.title")
    rows = rows.where(F.col("error").isNotNull() | U.is_https_url(url) & (F.trim(F.coalesce(title, F.lit(""))) != ""))
    normalized = U.normalize_url(url)
    return _items(rows.withColumn("seq", F.col("query_no") * (1 << 32) + F.col("pos")), normalized, title, F.coalesce("r.content", F.lit("")), normalized,
                  parse_feed_date(F.coalesce("r.publishedDate", "r.published_date")), F.array(normalized), F.col("_hint"))


def scan_search_results(files: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Items with ``query_no``, the number of the query whose answer they are from, as ``distinct_by_url_capped`` takes them."""
    return _good(_search_results(files, municipalities)).withColumn("query_no", F.shiftright("seq", 32))


def invalid_search_answers(files: DataFrame) -> DataFrame:
    answer = F.from_json("content", "query string, results array<string>")
    return files.where(answer["query"].isNull() | answer["results"].isNull()).select("source_id", "source_url")


#: Items with a link, and faults.
_LINKED = "error is not null or official_url != ''"


def _pages(files: DataFrame) -> DataFrame:
    return files.withColumnRenamed("content", "html")


def _blocks(facts: DataFrame, *more: str) -> DataFrame:
    """The blocks of every page, and the pages that cannot be read."""
    rows = facts.select("source_id", "source_url", "error", *more, F.inline_outer(F.when(F.col("error").isNull(), F.col("blocks"))))
    return rows.where("error is not null or pos is not null")


def _html_blocks(files: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """Elements of the item selectors (article and li if none): heading or text, first link."""
    facts = html_facts(_pages(files), blocks=[", ".join(selectors or ["article", "li"])])
    rows = _blocks(facts).withColumnRenamed("title", "_title").withColumnRenamed("pos", "seq")
    resolved = F.when(F.col("href").isNotNull(), U.resolve_url(F.col("source_url"), F.col("href"))).otherwise(F.col("source_url"))
    items = _items(rows, resolved, clean_evidence(F.coalesce("_title", "text"), 500), clean_evidence(F.col("text"), 4_000), resolved,
                   search=F.concat_ws(" ", "_title", "text"))
    return items.where(_LINKED)


def _notice_table(files: DataFrame) -> DataFrame:
    """Table rows with an announcement link; second cell as title, first date of the row."""
    facts = html_facts(_pages(files), blocks=["tr"], link_mark=NOTICE_LINK_MARK)
    rows = _blocks(facts).withColumnRenamed("pos", "seq")
    resolved = U.resolve_url(F.col("source_url"), F.coalesce("marked_href", F.lit("")))
    title = F.coalesce(F.try_element_at("cells", F.lit(2)), F.col("text"))
    day = F.regexp_extract("text", r"\b(\d{2}/\d{2}/\d{4})\b", 1)
    published = F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("dd/MM/yyyy"))
    return _items(rows.where("error is not null or marked_href is not null"), resolved, clean_evidence(title, 500),
                  clean_evidence(F.col("text"), 4_000), resolved, published, search=F.concat_ws(" ", title, "text"))


def _link_index(files: DataFrame, source_name: str, selectors: list[str]) -> DataFrame:
    """Links in the selected scope; source name, link text and path words are the searchable text."""
    facts = html_facts(_pages(files), blocks=[", ".join(selectors)])
    inner = F.expr("filter(links, l -> l.pos >= b.pos and l.href = b.href)")
    rows = facts.select("source_id", "source_url", "error", "links", F.explode_outer(F.when(F.col("error").isNull(), F.col("blocks"))).alias("b")).where("error is not null or b is not null")
    link_text = F.when(F.col("b.tag") == "a", F.col("b.text")).otherwise(F.try_element_at(inner, F.lit(1))["text"])
    rows = rows.withColumn("seq", F.col("b.pos")).withColumn("_text", F.coalesce(link_text, F.lit("")))
    resolved = U.resolve_url(F.col("source_url"), F.coalesce("b.href", F.lit("")))
    searchable = clean_evidence(
        F.concat_ws(" ", F.lit(source_name), clean_evidence(F.col("_text"), 500), U.path_words(resolved)), 1_000)
    whole = F.concat_ws(" ", F.lit(source_name), "_text", U.path_words(resolved))
    return _items(rows, resolved, searchable, searchable, resolved, search=whole).where(_LINKED)


def _detail_page(files: DataFrame, content_selectors: list[str], link_selectors: list[str], allowed_hosts: list[str]) -> DataFrame:
    """Detail pages as items; a page that lacks every content block is a fault."""
    n = len(content_selectors)
    facts = html_facts(_pages(files), blocks=[*content_selectors, *link_selectors])
    content = F.filter("blocks", lambda b: b["selector"] < n)
    # by selector, then position; an element that several selectors name counts once
    ordered = F.array_sort(F.transform(content, lambda b: F.struct(b["selector"].alias("s"), b["pos"].alias("p"), b["text"].alias("t"))))
    positions = F.transform(ordered, lambda b: b["p"])
    once = F.filter(ordered, lambda b, i: F.array_position(positions, b["p"]) == i + 1)
    links = F.array_sort(F.transform(F.filter("blocks", lambda b: b["selector"] >= n),
                                     lambda b: F.struct(b["selector"].alias("s"), b["pos"].alias("p"), b["href"].alias("h"))))
    hosts = F.array(*[F.lit(h.lower()) for h in allowed_hosts]) if allowed_hosts else F.array().cast(_NO_LINKS)
    absolute = F.transform(F.filter(links, lambda l: l["h"].isNotNull()), lambda l: U.resolve_url(F.col("source_url"), l["h"]))
    external = F.transform(
        F.filter(absolute, lambda u: U.is_https_url(u) & ~F.array_contains(hosts, U.host_of(u))), U.strip_query)
    lowered = F.transform(external, F.lower)
    related = F.slice(F.filter(external, lambda u, i: F.array_position(lowered, F.lower(u)) == i + 1), 1, 10)
    rows = facts.withColumns({"_parts": F.transform(once, lambda b: b["t"]), "_related": related, "seq": F.lit(0)})
    rows = rows.withColumnRenamed("title", "_title")
    title = clean_evidence(F.coalesce("h1", "_title", U.path_of(F.col("source_url"))), 500)
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.size("_parts") == 0, F.concat(F.lit("no content block: "), "source_url"))))
    return _items(rows, F.col("source_url"), title, clean_evidence(F.array_join("_parts", " "), 8_000), F.col("source_url"),
                  related=F.col("_related"), search=F.concat_ws(" ", title, F.array_join("_parts", " ")))


def scan_detail_page(files: DataFrame, content_selectors: list[str], link_selectors: list[str],
                     allowed_hosts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Detail pages as items, and the failures: sources with a page that cannot be read or lacks every content block."""
    tagged = _detail_page(files, content_selectors, link_selectors, allowed_hosts)
    return _good(tagged), _failures(tagged)


def find_calendar_summary(files: DataFrame) -> DataFrame:
    """First link of each page into the gazette folder that ends in .xml."""
    def wanted(link: Column) -> Column:
        return F.lower(link["href"]).contains(CALENDAR_LINK_FOLDER.lower()) & F.lower(link["href"]).endswith(".xml")

    # within the row, since two pages may have one URL
    urls = F.transform(F.filter("links", wanted), lambda link: U.resolve_url(F.col("source_url"), link["href"]))
    first = F.try_element_at(F.filter(urls, lambda url: url != ""), F.lit(1))
    return html_facts(_pages(files)).select("source_id", "source_url", first.alias("url")).where("url is not null")


#: Per format its one pass over documents: items, and a row with ``error`` for every document that cannot be read.
TAGGED = {
    "rss": _rss,
    "nestedJson": _nested_json,
    "atom": _atom,
    "zipAtom": _atom,
    "gazetteXml": _gazette_xml,
    "noticeTable": _notice_table,
    "sitemap": _sitemap,
    "htmlBlocks": _html_blocks,
    "htmlLinks": _link_index,
    "detailPage": _detail_page,
    "searchResults": _search_results,
}


def _tagged(files: DataFrame, feed_format: str, **options) -> DataFrame:
    if feed_format not in TAGGED:
        raise ValueError(f"unknown feed format: {feed_format}")
    return TAGGED[feed_format](files, **options)


def scan(feed_format: str):
    """The items of one format as they stand; documents that cannot be read have none."""

    def read(files: DataFrame, *given, **options) -> DataFrame:
        return _good(TAGGED[feed_format](files, *given, **options))

    return read


scan_rss, scan_atom, scan_nested_json, scan_gazette_xml, scan_sitemap = map(scan, ("rss", "atom", "nestedJson", "gazetteXml", "sitemap"))
scan_html_blocks, scan_notice_table, scan_link_index = map(scan, ("htmlBlocks", "noticeTable", "htmlLinks"))


def read_feed(files: DataFrame, feed_format: str, max_items: int = 2**31 - 1, **options) -> tuple[DataFrame, DataFrame]:
    """Items and failures of the documents of one format, each read once.

    Items are valid ones, the first per key, the first ``max_items`` per source; a source with a document that cannot be read has
    none. Failures are (source_id, error), one row per source, as ``radar_run`` takes them. Documents of archives (``zipAtom``) are
    the rows of ``read_archive_files`` or ``read_archives``, of which those with an ``error`` are failures too.
    """
    tagged = cut_to_table(_tagged(files, feed_format, **options))
    failures = _failures(tagged)
    items = _good(tagged).join(failures.select("source_id"), "source_id", "left_anti")
    return first_per_key_capped(valid_feed_items(items), max_items), failures


def parse_feed(files: DataFrame, feed_format: str, max_items: int, **options) -> DataFrame:
    """Items of one format, valid ones only, first per key, first ``max_items`` per source. Documents that cannot be read have
    none, see ``read_feed``."""
    return first_per_key_capped(valid_feed_items(_good(_tagged(files, feed_format, **options))), max_items)


def failed_feeds(files: DataFrame, feed_format: str, **options) -> DataFrame:
    """The failures alone."""
    return _failures(_tagged(files, feed_format, **options))


def failed_archives(archives: DataFrame) -> DataFrame:
    """(source_id, error), one row per source with an archive or member that cannot be read."""
    return _failures(_atom(read_archives(archives)))


def scan_zip_atom(archives: DataFrame, max_items: int) -> DataFrame:
    """Entries of all members in name order; the item limit of a source is applied in this order. A source with an archive
    that cannot be read has no items."""
    return read_feed(read_archives(archives), "zipAtom", max_items)[0]
