from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from listing_radar.functions import dates, patterns as P, text as X, urls as U


def test_normalize_text(values):
    assert values(X.normalize_text, "  Árbol-ÑANDÚ, 3º² ", None, "été") == ["arbol nandu 3º", "", "ete"]


def test_normalize_title_keeps_punctuation(values):
    assert values(X.normalize_title, " Plan  Parcial:\tÁrea 1 ") == ["plan parcial: area 1"]


def test_normalize_company(values):
    assert values(X.normalize_company, "Casas Norte, S.L.", "Casas SA", "Uno Sociedad Anónima SL") == ["casas norte", "casas", "uno"]


def test_clean_evidence(values):
    long = values(lambda c: X.clean_evidence(c, 10), "a \n b", "x" * 30)
    assert long == ["a b", "x" * 9 + "…"]


def test_normalize_url(values):
    given = [
        "HTTP://WWW.Example.org:8080/A/b/?utm_source=x&b=2&a=1%20z&REF=q#top", "https://example.org", "https://example.org/a/../c/./d/",
        "https://example.org/añ o?x=a+b&y", "not a url ",
    ]
    expected = [
        "https://www.example.org/A/b?a=1%20z&b=2", "https://example.org/", "https://example.org/c/d",
        "https://example.org/a%C3%B1%20o?x=a%2Bb&y=", "not a url",
    ]
    assert values(U.normalize_url, *given) == expected
    assert values(U.normalize_url, *expected) == expected


def test_resolve_url(values):
    base = F.lit("https://h.example.org/a/b.html?q=1#f")
    links = ["c.html", "/x?y", "../z", "//o.example.org/p", "?n=2", "#g", "mailto:a@b", "http://o.example.org", ""]
    assert values(lambda c: U.resolve_url(base, c), *links) == [
        "https://h.example.org/a/c.html", "https://h.example.org/x?y", "https://h.example.org/z", "https://o.example.org/p",
        "https://h.example.org/a/b.html?n=2", "https://h.example.org/a/b.html?q=1#g", "", "http://o.example.org/", "https://h.example.org/a/b.html?q=1"]


def test_addresses(values):
    hosts = ["8.8.8.8", "10.1.1.1", "100.64.0.1", "172.32.0.1", "name.example.org", "::1", "2001:db8::1", "2606:4700::1111", "::ffff:10.0.0.1"]
    assert values(lambda c: U.is_public_ip(c, with_ipv6=True), *hosts) == [True, False, False, True, None, False, False, True, False]


def test_spanish_decimal(values):
    texts = ["625.000 €", "1.234,50 euros", "210,5", "12.5", "abc", "1.000.000"]
    assert values(P.parse_spanish_decimal, *texts) == [
        Decimal("625000"), Decimal("1234.50"), Decimal("210.5"), Decimal("12.5"), None, Decimal("1000000")]


def test_monthly_prices_are_no_prices(values):
    got = values(P.price_range, "Desde 625.000 € con acabados de calidad, trastero, jardín propio y dos plazas de garaje. La cuota de la hipoteca: 60.000 € al mes", "Hasta 700.000 euros y desde 450 000 € hoy", "nada")
    assert [(r.price_from, r.price_to) for r in got] == [(Decimal("625000"), None), (Decimal("450000"), Decimal("700000")), (None, None)]


def test_areas(values):
    texts = ["4 dormitorios, 3 baños y 210 m2 construidos", "desde 120 m² hasta 150 m² construidos", "superficie construida de 99,5 m2", "sin datos"]
    assert [(r.min, r.max) for r in values(P.built_area, *texts)] == [
        (Decimal("210"), None), (Decimal("120"), Decimal("150")), (Decimal("99.5"), None), (None, None)]
    plots = ["parcelas de 500 a 1.200 m²", "250 metros de parcela y 400 metros de parcela"]
    assert [(r.min, r.max) for r in values(P.plot_area, *plots)] == [(Decimal("500"), Decimal("1200")), (Decimal("250"), Decimal("400"))]


def test_rooms_and_units(values):
    assert [(r.min, r.max) for r in values(P.bedrooms, "3 o 4 dormitorios", "2 habitaciones", "x")] == [(3, 4), (2, None), (None, None)]
    assert values(P.total_units, "24 nuevas viviendas", "3 viviendas disponibles") == [24, None]
    assert values(P.available_units, "3 viviendas disponibles", "unidades: 5 disponibles", "Última vivienda", "x") == [3, 5, 1, None]


def test_statuses(values):
    assert values(P.commercial_status, "ÚLTIMAS VIVIENDAS en venta", "Agotado", "Precomercialización", "nada") == [
        "lastUnits", "soldOut", "preSales", "unknown"]
    assert values(P.construction_status, "Licencia concedida. En construcción", "licencia de obra solicitada") == ["underConstruction", "planned"]
    assert values(P.property_types, "chalets adosados y pareados", "no son adosados", "vivienda independiente") == [
        ["Adosado", "Pareado"], [], ["Independiente"]]


def test_delivery(values):
    got = values(P.delivery, "Entrega prevista 2º trimestre 2027", "entrega Q3 2027", "sin fecha")
    assert [r.date for r in got] == [date(2027, 6, 30), date(2027, 12, 31), None]


def test_developer_and_title(values):
    assert values(P.developer_name, "Promueve: Casas Norte SL obras iniciadas", "x") == ["Casas Norte SL", None]
    assert values(P.brochure_title, "Residencial Los Pinos: 20 viviendas") == ["Residencial Los Pinos"]


def test_feed_dates(values):
    got = values(lambda c: F.date_format(dates.parse_feed_date(c), "yyyy-MM-dd HH:mm"), "Mon, 20 Jul 2026 10:00:00 +0200", "2026-07-20T08:00:00Z", "2026-07-20", "x", None)
    assert got == ["2026-07-20 08:00", "2026-07-20 08:00", "2026-07-20 00:00", None, None]


def test_batches_cover_the_range(spark):
    rows = spark.range(1).select(F.inline(dates.batch_ranges(F.lit(date(2024, 1, 1)), F.lit(date(2024, 3, 5)), 10))).collect()
    days = [d.toordinal() for r in rows for d in [r["from"]]]
    assert rows[0]["from"] == date(2024, 1, 1) and rows[-1]["to"] == date(2024, 3, 5)
    assert all(b - a == 10 for a, b in zip(days, days[1:]))
    assert all(rows[i]["to"].toordinal() + 1 == rows[i + 1]["from"].toordinal() for i in range(len(rows) - 1))


def test_ngrams(values):
    assert values(lambda c: X.word_ngrams(c, 2), "a b a", "") == [["a", "b", "a b", "b a"], []]


def test_literals_of_patterns_lose_no_match(spark):
    """A pattern is left out only where it cannot match, also with letters that Java folds to plain ones."""
    from listing_radar import fixed_values as V

    examples = {
        V.PAT_TERMS: "Obra nueva", V.PAT_PRICE: "desde 325.000 €", V.PAT_BUILT_AREA: "120 m2 construidos", V.PAT_PLOT_AREA: "parcela de 300 m²",
        V.PAT_PLOT_VALUE: "300 metros de parcela", V.PAT_BEDROOMS: "3 habitaciones", V.PAT_BATHROOMS: "2 baños", V.PAT_GARAGE: "2 plazas de garaje",
        V.PAT_INDEPENDENT: "chalets independientes", V.PAT_SEMI_DETACHED: "pareados", V.PAT_TOWNHOUSE: "adosadas", V.PAT_NOT_TOWNHOUSE: "no son adosados",
        V.PAT_PRIVATE_POOL: "piscina privada", V.PAT_COMMUNITY_POOL: "piscina común", V.PAT_SOLD_OUT: "agotada", V.PAT_LAST_UNITS: "últimas unidades",
        V.PAT_UPCOMING: "próxima fase", V.PAT_ON_SALE: "a la venta", V.PAT_PRE_SALES: "precomercialización", V.PAT_COMPLETED: "llave en mano",
        V.PAT_UNDER_CONSTRUCTION: "obras iniciadas", V.PAT_LICENSED: "licencia obtenida", V.PAT_LICENCE_REQUESTED: "licencia de obra solicitada",
        V.PAT_DELIVERY: "entrega prevista 2026", V.PAT_UNITS: "12 viviendas", V.PAT_AVAILABLE: "3 unidades disponibles", V.PAT_SINGLE_AVAILABLE: "última vivienda",
        V.PAT_DEVELOPER: "Promueve: Casa Norte", V.PAT_BROCHURE_TITLE: "Residencial Sur", V.PAT_COMMERCIAL_EVIDENCE: "próximamente", V.PAT_CONSTRUCTION_EVIDENCE: "en construcción"}
    assert examples.keys() == V.PAT_NEEDS.keys()
    spellings = [lambda x: x, str.upper, lambda x: x.replace("s", "ſ"), lambda x: x.replace("i", "İ"), lambda x: x.replace("i", "ı").replace("k", "K"), lambda x: f"xx {x}. yy"]
    texts = [(make(x),) for x in [*examples.values(), "nada", ""] for make in spellings] + [(None,)]
    df = spark.createDataFrame(texts, "x string").select("x", P.folded(F.col("x")).alias("low"))
    x, low = F.col("x"), F.col("low")
    for pattern, example in examples.items():
        rows = df.select("x", F.coalesce(x.rlike(V.FLAGS + pattern), F.lit(False)).alias("raw"), P.matches(x, pattern, low).alias("m")).collect()
        assert [r.x for r in rows if r.raw != r.m] == [] and example in [r.x for r in rows if r.m]
    priced = df.where("x = 'nada' or x is null").select(P.price_range(x, low)["price_from"].alias("p"), P.bedrooms(x)["min"].alias("b"), P.evidence_fragment(x, V.PAT_PRICE, low).alias("e"))
    assert {tuple(r) for r in priced.collect()} == {(None, None, "")}


def test_brochures_of_links_and_of_the_page_itself(spark):
    from listing_radar.plans.promotions import brochure_urls

    links = F.array(*[F.struct(F.lit(h).alias("href")) for h in ("/A.PDF?x=1", "c.html?f=.pdf", "#top", " ?a", "x/../b.pdf", "")])
    found = spark.range(1).select(brochure_urls(F.lit("https://h.example.org/d/p.pdf"), links, F.lit(None).cast("array<string>")).alias("u")).first().u
    base = "https://h.example.org"
    assert found == sorted([f"{base}/A.PDF?x=1", f"{base}/d/p.pdf#top", f"{base}/d/p.pdf?a", f"{base}/d/b.pdf", f"{base}/d/p.pdf"])


def test_pages_of_a_batch_are_read_a_few_at_a_time():
    import pandas as pd
    from listing_radar.sources import html

    batches = [pd.DataFrame({"html": range(n)}) for n in (0, html.PAGES_AT_ONCE, 2 * html.PAGES_AT_ONCE + 1)]
    found = list(html.slices(batches))
    assert [len(f) for f in found] == [html.PAGES_AT_ONCE] * 3 + [1]
    assert [v for f in found for v in f["html"]] == [v for b in batches for v in b["html"]]
