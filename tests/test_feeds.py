import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from listing_radar.sources import feeds as S, tables
from listing_radar.sources.html import html_facts
from listing_radar.sources.jsonld import json_ld_nodes, node_address, offer_range
from listing_radar.sinks import tables as K


@pytest.fixture
def files(spark):
    def make(content, url="https://h.example.org/feed/x"):
        return spark.createDataFrame([("s1", url, date(2026, 7, 1), content)], "source_id string, source_url string, document_date date, content string")

    return make


def test_rss(files):
    xml = """<?xml version="1.0"?><rss xmlns:dc="http://d"><channel><title>c</title>
      <item><title>Uno</title><link>/a</link><guid>g1</guid><description>&lt;p&gt;Texto &amp;amp; <![CDATA[<b>más</b>]]>&lt;/p&gt;</description><pubDate>Mon, 20 Jul 2026 10:00:00 GMT</pubDate></item>
      <item><title>Dos</title><link></link><guid>https://h.example.org/b</guid></item></channel></rss>"""
    rows = S.scan_rss(files(xml)).orderBy("seq").collect()
    assert [(r.external_id, r.title, r.official_url) for r in rows] == [("g1", "Uno", "https://h.example.org/a"), ("https://h.example.org/b", "Dos", "https://h.example.org/b")]
    assert rows[0].summary == "Texto & más" and rows[1].published_at is None


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:cac="u"><entry><id>i1</id><author><name>Ayto</name></author><link href="https://h.example.org/{n}"/>
  <title>T {n}</title><summary>S</summary><updated>2026-07-02T00:00:00Z</updated><cac:Folder><cac:ContractFolderID>F{n}</cac:ContractFolderID><cac:CityName>Villa</cac:CityName><cac:CityName>villa</cac:CityName></cac:Folder></entry></feed>"""


def test_atom(files):
    row = S.scan_atom(files(ATOM.format(n=1))).first()
    assert (row.external_id, row.title, row.summary, row.official_url) == ("Ayto|F1", "T 1", "S F1 Villa", "https://h.example.org/1")


def test_zip_members_in_name_order(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for n in (2, 1, 3):
            archive.writestr(f"m{n}.atom", ATOM.format(n=n))
        archive.writestr("other.txt", "x")
    df = spark.createDataFrame([("s1", "https://h.example.org/z", date(2026, 7, 1), bytearray(data.getvalue()))],
                               "source_id string, source_url string, document_date date, archive binary")
    assert [r.title for r in S.scan_zip_atom(df, 2).orderBy("seq").collect()] == ["T 1", "T 2"]
    broken = df.limit(1).withColumns({"archive": F.lit(b"no zip"), "source_id": F.lit("broken")})
    assert [r.source_id for r in S.failed_archives(df.unionByName(broken)).collect()] == ["broken"]
    assert S.scan_zip_atom(broken, 10).count() == 0


def test_nested_json(files):
    text = '{"data":{"item":{"identificador":"A","titulo":"T","url_html":"https://x/1"},"more":[{"item":[{"Identificador":"B","titulo":"U","url_html":"https://x/2"},{"titulo":"no"}]}]}}'
    rows = S.scan_nested_json(files(text)).orderBy("seq").collect()
    assert [(r.external_id, r.title) for r in rows] == [("A", "T"), ("B", "U")]
    assert S.scan_nested_json(files("no json")).count() == 0


def test_gazette(files):
    xml = """<sumario><seccion nombre="B. Autoridades"><apartado><organismo nombre="Ayuntamiento de X"><disposicion><identificador>D1</identificador><rango>ANUNCIO</rango><titulo>Plan parcial</titulo><url_html>https://b/1</url_html></disposicion></organismo></apartado></seccion></sumario>"""
    row = S.scan_gazette_xml(files(xml)).first()
    assert (row.external_id, row.summary) == ("D1", "Ayuntamiento de X B. Autoridades ANUNCIO Plan parcial")


def test_sitemap(files):
    xml = """\n<urlset xmlns="s" xmlns:image="i"><url><loc>https://h.example.org/obra-nueva/los_pinos</loc><lastmod>2026-07-01</lastmod><image:image><image:title>Los Pinos</image:title></image:image></url></urlset>"""
    row = S.scan_sitemap(files(xml)).first()
    assert row.title == "Los Pinos obra nueva los pinos"
    index = "<sitemapindex><sitemap><loc>/a.xml</loc></sitemap><sitemap><loc>https://o.example.org/b.xml</loc></sitemap></sitemapindex>"
    assert {r.url for r in S.sitemap_children(files(index)).collect()} == {"https://h.example.org/a.xml", "https://o.example.org/b.xml"}


def test_xml_of_any_depth_and_cdata(files):
    xml = """\n<?xml version="1.0" encoding="ISO-8859-1"?><!-- <![CDATA[ --><!DOCTYPE rss><rss><x><y:item><title><![CDATA[A & B <!-- c --> </item>]]></title>
      <link><![CDATA[https://h.example.org/?a=1&b=2]]></link><guid>ñ&nbsp;g & h</guid><item><title>in</title></item></y:item></x></rss>"""
    rows = S.scan_rss(files(xml)).orderBy("seq").collect()
    assert [(r.title, r.official_url) for r in rows] == [("A & B <!-- c --> </item>", "https://h.example.org/?a=1&b=2"), ("in", rows[1].official_url)]
    assert rows[0].external_id == "ñ&nbsp;g & h" and S.failed_feeds(files(xml), "rss").count() == 0
    gazette = """<s><disposicion><identificador>D0</identificador></disposicion><seccion nombre="S"><organismo nombre="O"><p><disposicion><identificador>D1</identificador></disposicion></p></organismo>
      <disposicion><identificador>D2</identificador></disposicion></seccion></s>"""
    assert [(r.external_id, r.summary.strip()) for r in S.scan_gazette_xml(files(gazette)).orderBy("seq").collect()] == [("D0", ""), ("D1", "O S"), ("D2", "S")]


@pytest.mark.parametrize("bad", ["<rss><item><title>a</title><guid>g</guid></item><item><title>b", "<rss><item><title>a</titel></item></rss>", "<rss><item><guid>g</guid></item></rss><rss/>", "", None])
def test_unreadable_xml_is_a_failure_not_a_short_feed(files, bad):
    good = files("<rss><item><title>a</title><guid>https://h.example.org/g</guid></item></rss>").withColumn("source_id", F.lit("s2"))
    both = files(bad).unionByName(good)
    assert [(r.source_id, bool(r.error)) for r in S.failed_feeds(both, "rss").collect()] == [("s1", True)]
    assert [r.source_id for r in S.parse_feed(both, "rss", 10).collect()] == ["s2"]


def test_failed_xml_of_other_kinds(spark, files):
    assert S.failed_feeds(files("<html/>"), "sitemap").count() == 1 and S.failed_feeds(files("<urlset/>"), "sitemap").count() == 0
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("m1.atom", ATOM.format(n=1))
        archive.writestr("m2.atom", ATOM.format(n=2)[:-20])
    df = spark.createDataFrame([("s1", "https://h.example.org/z", date(2026, 7, 1), bytearray(data.getvalue()))],
                               "source_id string, source_url string, document_date date, archive binary")
    assert [r.source_id for r in S.failed_archives(df).collect()] == ["s1"] and S.scan_zip_atom(df, 10).count() == 0


def test_search_results(spark, files):
    places = spark.createDataFrame([("Villa Alta", True, 0), ("Villa", True, 1)], "official_name string, enabled boolean, ord int")
    text = '{"query":"obra nueva Villa Alta","results":[{"url":"https://a.example.org/x?utm_source=1","title":"T","content":"C"},{"url":"http://b.example.org","title":"T"},{"url":"https://c.example.org","title":" "}]}'
    rows = S.scan_search_results(files(text), places).collect()
    assert [(r.official_url, r.municipality_hint) for r in rows] == [("https://a.example.org/x", "Villa Alta")]
    assert S.invalid_search_answers(files("{}")).count() == 1


def test_html_blocks_and_notices(files):
    html = "<ul><li class='n'><h3>Título</h3> cuerpo <a href='/p/1'>ver</a></li><li>otro <a href='mailto:x'>m</a></li></ul>"
    rows = S.scan_html_blocks(files(html), ["li"]).collect()
    assert [(r.title, r.official_url) for r in rows] == [("Título", "https://h.example.org/p/1")]
    table = "<table><tr><td>1<td>Licencia<td><a href='Tablon.do?action=verAnuncio&id=7'>v</a> 03/07/2026</tr><tr><td>x</td></tr></table>"
    row = S.scan_notice_table(files(table)).collect()
    assert [(r.title, r.official_url) for r in row] == [("Licencia", "https://h.example.org/feed/Tablon.do?action=verAnuncio&id=7")]
    assert row[0].published_at.day == 3


def test_detail_page(files):
    html = "<h1>Obra</h1><div class='c'>Texto</div><p id='l'><a href='https://out.example.net/a?x=1#y'>o</a></p><p id='l'><a href='https://h.example.org/in'>i</a></p>"
    items, failed = S.scan_detail_page(files(html), [".c"], ["#l"], ["h.example.org"])
    row = items.first()
    assert (row.title, row.summary, row.related_urls) == ("Obra", "Texto", ["https://out.example.net/a"])
    assert failed.count() == 0
    assert S.scan_detail_page(files("<p>x</p>"), [".c"], [], [])[1].count() == 1


def test_link_index(files):
    row = S.scan_link_index(files("<div class='i'><a href='/obra/los-pinos'>Los Pinos</a></div>"), "Promotora", [".i"]).first()
    assert row.title == "Promotora Los Pinos obra los pinos"


def test_parse_feed_limits(files):
    xml = "<rss>" + "".join(f"<item><title>T{i}</title><guid>G{i % 3}</guid><link>https://x.example.org/{i}</link></item>" for i in range(9)) + "</rss>"
    assert [r.title for r in S.parse_feed(files(xml), "rss", 2).orderBy("seq").collect()] == ["T0", "T1"]


def test_html_facts_and_json_ld(spark):
    html = """<html><head><title>P</title><link rel=canonical href="/c?utm_source=1"><meta property="og:title" content="OG"><script type="application/ld+json">{"@graph":[{"@type":"Product","NAME":"Res","brand":{"name":"B"},
      "address":{"streetAddress":"C 1","addressLocality":"Villa"},"geo":{"latitude":40.5,"longitude":"-3,7"},"offers":[{"lowPrice":"625.000"},{"price":700000.5}]},{"@type":"Thing","name":"x"}]}</script>
      <script type="application/ld+json">{bad</script></head><body><h1>H</h1><p>uno<p>dos<script>no</script></body></html>"""
    facts = html_facts(spark.createDataFrame([("u", html)], "page_url string, html string"))
    row = facts.first()
    assert (row.title, row.h1, row.canonical, row.meta["og:title"], row.text) == ("P", "H", "/c?utm_source=1", "OG", "H uno dos")
    nodes = json_ld_nodes(facts, "page_url")
    got = nodes.select("name", "brand", node_address(nodes).alias("a"), offer_range(F.col("offer_prices")).alias("o"), "longitude").collect()
    assert [(r.name, r.brand, r.a, float(r.o.price_from), float(r.o.price_to)) for r in got] == [("Res", "B", "C 1, Villa", 625000.0, 700000.5)]


def test_page_dir_and_lists(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.html").write_text("<meta name='source-url' content='https://own.example.org/'>x")
    (tmp_path / "p" / "2.html").write_text("y")
    (tmp_path / "p" / "3.html").write_text("z")
    rows = tables.read_page_dir(spark, str(tmp_path / "p"), ["https://a.example.org/1", "https://a.example.org/2"]).collect()
    assert sorted(r.url for r in rows) == ["https://a.example.org/2", "https://fixture.invalid/3.html", "https://own.example.org/"]
    (tmp_path / "u.txt").write_text("# note\n\n https://a.example.org/x \nnope\n")
    (tmp_path / "u.json").write_text('{"urls": ["https://b.example.org/", 3]}')
    assert [r.url for r in tables.read_manual_urls(spark, str(tmp_path / "u.txt")).collect()] == ["https://a.example.org/x"]
    assert [r.url for r in tables.read_manual_urls(spark, str(tmp_path / "u.json")).collect()] == ["https://b.example.org/"]


def test_catalogs(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"municipalities":[{"officialName":"Villa","aliases":["V"],"localities":[],"latitude":40.1,"longitude":-3.2,"enabled":true}]}')
    row = tables.read_catalog(spark, str(tmp_path / "m.json"), "municipalities").first()
    assert (row.ord, row.official_name, row.aliases) == (0, "Villa", ["V"])
    (tmp_path / "d.json").write_text('{"domains":["a.example.org"]}')
    assert tables.read_catalog(spark, str(tmp_path / "d.json"), "domains").first().domain == "a.example.org"
    (tmp_path / "c.csv").write_text("COD_GEO;NOMBRE_ACTUAL;LONGITUD_ETRS89;LATITUD_ETRS89;ORIGENCOOR\n1;Villa;-3.5;40.5;M\n")
    assert tables.read_centroid_csv(spark, str(tmp_path / "c.csv")).first().LATITUD_ETRS89 == 40.5


def test_state_snapshots(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.load_state(spark, path) is None
    for n in range(5):
        assert K.save_state(spark.range(n + 1), path, f"{n:03d}")
    assert not K.save_state(spark.range(99), path, "900", publishable=False)
    assert tables.load_state(spark, path).count() == 5
    folders = tables.snapshot_folders(spark, path)
    assert len(folders) == 3
    newest = folders[0].replace("file:", "")
    for part in (tmp_path / "state" / newest.rsplit("/", 1)[1]).glob("*.parquet"):
        part.write_bytes(b"broken")
    for part in (tmp_path / "state" / newest.rsplit("/", 1)[1]).glob(".*.crc"):
        part.write_bytes(b"")
    assert tables.load_state(spark, path).count() == 4


def test_every_format_tells_its_faults_apart(spark, files):
    places = spark.createDataFrame([(0, "Villa", True)], "ord int, official_name string, enabled boolean")
    deep = "[" * 200_000 + "]" * 200_000
    notice = '{"identificador": "a\\ud800", "titulo": "T", "url_html": "https://x.example.org/1"}'
    cases = [
        ("nestedJson", [notice, "{}", "7"], ['{"a": ', "", None, deep], {}),
        ("rss", ["<rss><item><title>T</title><link>/x</link></item></rss>", "<rss/>"], ["<rss><item><title>T</title></item>", None, "<rss/><rss/>"], {}),
        ("sitemap", ["<urlset><url><loc>/a</loc></url></urlset>", "<sitemapindex/>"], ["<html/>"], {}),
        ("gazetteXml", ["<sumario><disposicion><identificador>i</identificador><titulo>T</titulo><url_html>https://x.example.org/1</url_html></disposicion></sumario>"], ["<sumario>"], {}),
        ("searchResults", ['{"query": "villa", "results": [{"url": "https://x.example.org/1", "title": "T"}]}', '{"query": "q", "results": []}'], ["{}", '{"query": "q"', None, '{"results": []}'], {"municipalities": places}),
        ("detailPage", ["<h1>T</h1><main>text</main>"], ["<p>no block</p>"], {"content_selectors": ["main"], "link_selectors": ["a"], "allowed_hosts": []}),
        ("htmlBlocks", ["<article>T <a href='/x'>x</a></article>", "", "<p>none</p>"], [], {}),
    ]
    for feed, good, bad, options in cases:
        one, none = S.read_feed(files(good[0]), feed, **options)
        assert (one.count(), none.count()) == (1, 0), feed
        for text in good[1:]:
            assert [x.count() for x in S.read_feed(files(text), feed, **options)] == [0, 0], (feed, text)
        for text in bad:
            items, failures = S.read_feed(files(text), feed, **options)
            assert items.count() == 0 and [r.source_id for r in failures.collect()] == ["s1"] and failures.first().error, (feed, str(text)[:30])
        both = files(good[0])
        for text in [*good, *bad]:
            both = both.unionByName(files(text))
        items, failures = S.read_feed(both, feed, **options)
        assert (items.count(), failures.count()) == ((0, 1) if bad else (1, 0)), feed


def test_members_of_archives_are_read_apart(spark, tmp_path):
    from listing_radar.sources.archives import read_archive_files

    for name, members in (("good", 12), ("spoilt", 5)):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as archive:
            for n in range(members):
                archive.writestr(f"m{n:02d}.ATOM", ATOM.format(n=n))
            archive.writestr("other.txt", "x")
            end = data.tell()
        whole = bytearray(data.getvalue())
        if name == "spoilt":
            whole[whole.index(b"<title>T 3") + 7] ^= 1
        assert end < len(whole)
        (tmp_path / f"{name}.zip").write_bytes(whole)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    sources = spark.createDataFrame([(n, "https://h.example.org/z", date(2026, 7, 1), f"/any/{n}.zip") for n in ("good", "spoilt", "broken")],
                                    "source_id string, source_url string, document_date date, file string")
    members = read_archive_files(spark, str(tmp_path), sources, partition_bytes=1)
    tasks = members.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) == 18 and {r.n for r in tasks} == {1}  # a task per member, and one for the archive that is none
    items, failures = S.read_feed(members, "zipAtom", max_items=10)
    assert [(r.source_id, r.title) for r in items.orderBy("seq").collect()] == [("good", f"T {n}") for n in range(10)]
    assert {r.source_id: bool(r.error) for r in failures.collect()} == {"broken": True, "spoilt": True}
    assert read_archive_files(spark, str(tmp_path / "good.zip"), sources).count() == 12
    (tmp_path / "none").mkdir()
    assert read_archive_files(spark, str(tmp_path / "none"), sources).count() == 0


def test_many_small_archives_share_partitions(tmp_path):
    from listing_radar.sources import archives as A

    for n in range(600):
        with zipfile.ZipFile(tmp_path / f"a{n:03d}.zip", "w") as archive:
            archive.writestr("m.atom", ATOM.format(n=n))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    reader = A.MemberReader({"path": str(tmp_path), "partitionbytes": "1"})
    parts = reader.partitions()
    assert len(parts) <= 2 * A.PARTITIONS < 600
    rows = [row for part in parts for row in reader.read(part)]
    assert sorted(row[0].rsplit("/", 1)[1] for row in rows) == sorted([f"a{n:03d}.zip" for n in range(600)] + ["broken.zip"])
    assert [row[0].rsplit("/", 1)[1] for row in rows if row[4]] == ["broken.zip"]


def test_query_numbers_order_search_results(spark, files):
    from listing_radar.operators.candidates import distinct_by_url_capped

    places = spark.createDataFrame([(0, "Villa", True)], "ord int, official_name string, enabled boolean")
    answer = '{{"query": "q", "results": [{}]}}'
    result = '{{"url": "https://x.example.org/{}", "title": "T{}"}}'
    texts = [answer.format(",".join(result.format(u, u) for u in urls)) for urls in ([3, 1], [1, 2, 4], [5])]
    answers = None
    for number, text in enumerate(texts):
        one = files(text).withColumn("query_no", F.lit(len(texts) - number))
        answers = one if answers is None else answers.unionByName(one)
    rows = S.scan_search_results(answers, places)
    assert [r.title for r in distinct_by_url_capped(rows, 2, 4).orderBy("query_no", "seq").collect()] == ["T5", "T1", "T2", "T3"]


def test_calendar_pages_of_one_url_each_have_their_link(spark):
    rows = [("s", "https://h.example.org/a", None, f'<a href="/x.pdf">a</a><a href="/CM_Boletin_BOCM/{n}.xml">b</a>') for n in (1, 2)]
    pages = spark.createDataFrame(rows, "source_id string, source_url string, document_date date, content string")
    assert sorted(r.url for r in S.find_calendar_summary(pages).collect()) == [f"https://h.example.org/CM_Boletin_BOCM/{n}.xml" for n in (1, 2)]


def test_references_without_semicolon(spark):
    html = "<title>a&amp;b&amp</title><script type='application/ld+json'>{\"a\": \"x&y\"}</script><p>c&lt d&#65;</p>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    as_written = html_facts(pages, ended_references=True).first()
    assert (as_written.title, as_written.text, as_written.json_ld) == ("a&b&amp", "c&lt dA", ['{"a": "x&y"}'])
    assert html_facts(pages).first().title == "a&b&"
