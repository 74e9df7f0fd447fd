from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from listing_radar import schemas
from listing_radar.operators.candidates import upsert_candidates
from listing_radar.plans import enrichment, promotions as P, radar
from listing_radar.sinks import tables as K
from listing_radar.sources import manifests
from listing_radar.sources.tables import load_state, snapshot_folders
from listing_radar.streaming import state as S
from listing_radar.streaming.radar import candidate_state, health_stream, radar_stream

NOW = datetime(2026, 7, 1)


@pytest.fixture
def places(spark):
    return spark.createDataFrame([(0, "Villa", [], ["El Soto"], True, 40.5, -3.5), (1, "Cerro", [], [], True, 40.1, -3.1)],
                                 "ord int, official_name string, aliases array<string>, localities array<string>, enabled boolean, latitude double, longitude double")


def page(spark, *html):
    rows = [(f"https://a.example.org/p{i}", h, NOW) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "url string, html string, fetched_at timestamp")


SOURCE = {"source_id": "s", "source_kind": "officialPromoter", "allowed_hosts": ["a.example.org"], "custom_selectors": {}}
LD = """<script type="application/ld+json">{"@type":"Product","name":"Los Pinos","address":{"addressLocality":"Villa"},"brand":{"name":"Norte SL"},"offers":{"price":"625000"}}</script>"""


def test_extraction(spark, places):
    pages = page(
        spark, f"<title>x</title>{LD}<p>4 dormitorios, 3 baños. <a href='/d.pdf'>dossier</a></p>",
        "<h1>Residencial Sur</h1><p>Obra nueva en El Soto: desde 450.000 €. 20 viviendas. Próximamente</p>", "<h1>Contacto</h1><p>Villa</p>")
    rows, failed = P.extract_promotions(pages, SOURCE, places)
    got = {r.name: r for r in rows.collect()}
    assert set(got) == {"Los Pinos", "Residencial Sur"} and failed.count() == 0
    one, two = got["Los Pinos"], got["Residencial Sur"]
    assert (one.municipality, one.price_from, one.bedrooms_min, one.developer_name) == ("Villa", Decimal("625000.00"), 4, "Norte SL")
    assert one.brochure_urls == ["https://a.example.org/d.pdf"]
    assert [e.field for e in one.evidence] == ["name", "priceFrom", "bedrooms", "bathrooms", "developerName"]
    assert (two.municipality, two.price_from, two.total_units, two.commercial_status) == ("Villa", Decimal("450000.00"), 20, "upcoming")


def test_missing_root_fails_the_page(spark, places):
    rows, failed = P.extract_promotions(page(spark, "<p>x</p>"), {**SOURCE, "content_selector": "#main"}, places)
    assert rows.count() == 0 and failed.count() == 1


def test_overrides_and_fixed_place(spark, places):
    source = {**SOURCE, "custom_selectors": {"name": ".t", "priceFrom": ".p"}, "fixed_municipality": "Cerro"}
    rows, _ = P.extract_promotions(page(spark, "<h1>H</h1><b class='t'>Nombre</b><i class='p'>325.000 €</i> Villa"), source, places)
    row = rows.first()
    assert (row.name, row.municipality, row.price_from) == ("Nombre", "Cerro", Decimal("325000.00"))


def test_promotion_run(spark, places, tmp_path):
    rows, _ = P.extract_promotions(page(spark, LD, LD, "<h1>Residencial Sur</h1>Obra nueva en Cerro desde 450.000 €"), SOURCE, places)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    sources = spark.createDataFrame([("s", ["https://a.example.org/"])], "source_id string, start_urls array<string>")
    runs = spark.createDataFrame([("s", "success", 3, 3, 0, 3, NOW, NOW + timedelta(seconds=2))],
                                 "source_id string, status string, urls_discovered int, urls_fetched int, urls_skipped int, promotions_extracted int, started_at_utc timestamp, finished_at_utc timestamp")
    previous = spark.createDataFrame([], schemas.PROMOTIONS)
    run = P.promotion_run(rows, runs, previous, sources, places, F.lit(NOW), True)
    run.state.write.parquet(str(tmp_path / "state"))
    written = spark.read.parquet(str(tmp_path / "state"))
    state = written.collect()
    assert len(state) == 2 and {r.location_precision for r in state} == {"municipalityCentroid"}
    pinos = next(r for r in state if r.name == "Los Pinos")
    assert pinos.source_urls == ["https://a.example.org/p0", "https://a.example.org/p1"]
    assert pinos.source_confidence == Decimal("0.91")
    assert {r.kind for r in run.changes.collect()} == {"added"}
    report = run.report.first()
    assert (report.status, report.publishable, report.new_promotions, report.duration_seconds) == ("success", True, 2, 2.0)
    K.write_csv(written, str(tmp_path / "csv"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv"))).splitlines()
    assert lines[0].startswith("\ufeffid,name,municipality") and len([x for x in lines if x.startswith("sn-")]) == 2
    K.write_geojson(written, str(tmp_path / "geo"))
    K.write_dataset_json(written, str(tmp_path / "json"))
    assert "coordinates" in "".join(p.read_text() for p in (tmp_path / "geo").glob("*.txt"))


def test_enrichment_run(spark):
    promotions = P.empty_facts(spark.createDataFrame([
        ("sn-1", "Pinos", "Villa", "https://x/1"), ("sn-2", "Sur", "Cerro", "https://x/2"), ("sn-3", "Oeste", "Cerro", "https://x/3"), ("sn-4", "Este", "Cerro", "https://y/4")],
        "id string, name string, municipality string, canonical_url string"))
    pages = spark.createDataFrame([("sn-1", "https://x/1", "Pinos desde 450.000 € y 3 dormitorios", NOW), ("sn-2", "https://x/2", "nada", NOW)],
                                  "promotion_id string, url string, text string, fetched_at timestamp")
    proposals = spark.createDataFrame([], schemas.ENRICHMENTS)
    sources = spark.createDataFrame([(1, "s", "https://x/", [])], "ord int, source_id string, base_url string, allowed_hosts array<string>")
    usage = spark.createDataFrame([("sn-1", 70, 0, 0, 30, 0, 100, Decimal("0.000250"))], "promotion_id string, " + schemas.USAGE)

    def run(state, **options):
        return enrichment.enrichment_run(promotions, pages, sources, state, "gpt-5.6-luna", 800, Decimal("1"), 5, 3, 8000, F.lit(NOW), **options)

    first = run(proposals, usage=usage)
    assert {r.promotion_id: r.decision for r in first.queue.collect()} == {"sn-1": "admitted", "sn-2": "admitted", "sn-3": "failed", "sn-4": "failed"}
    assert {r.field: r.value_text for r in first.fields.where("reject_reason is null").collect()} == {"priceFrom": "450000.00", "bedroomsMin": "3"}
    state = {r.promotion_id: r for r in first.state.collect()}
    assert len(state) == 4 and [f.field for f in state["sn-1"].fields] == ["priceFrom", "bedroomsMin"] and state["sn-2"].fields == []
    assert state["sn-3"].warnings == ["No se obtuvo evidencia textual para 'Oeste'."] and "fuente" in state["sn-4"].warnings[0]
    report = first.report.first()
    assert (report.eligible, report.processed, report.failed, report.proposed_fields, report.total_tokens, report.estimated_cost_usd) == (4, 2, 2, 2, 100, Decimal("0.000250"))

    # an accepted proposal goes stale when its page changes; what has not changed is not asked again
    kept = spark.createDataFrame(
        [r.asDict(recursive=True) | {"status": "accepted" if r.promotion_id == "sn-1" else r.status} for r in state.values()], schemas.ENRICHMENTS)
    pages = pages.withColumn("text", F.when(F.col("promotion_id") == "sn-1", "Pinos desde 460.000 €").otherwise(F.col("text")))
    second = run(kept)
    assert {r.promotion_id: r.decision for r in second.queue.collect()} == {"sn-1": "admitted", "sn-2": "cached", "sn-3": "failed", "sn-4": "failed"}
    assert sorted(r.status for r in second.state.where("promotion_id = 'sn-1'").collect()) == ["pending", "stale"]
    planned = run(kept, dry_run=True)
    assert planned.report.first().planned == 1 and planned.state.count() == kept.count()


def items(spark, texts):
    rows = [("s", f"x{i}", t, t, f"https://a.example.org/{i}", [], None, NOW, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.FEED_ITEMS)


@pytest.fixture
def catalog(spark, places):
    sources = spark.createDataFrame([("s", "S", "regionalGazette", "daily", None, False, True, [("/3", "rejected")], ["a.example.org"])],
                                    "source_id string, source_name string, source_kind string, cadence string, fixed_municipality string, ignore_exclusion_terms boolean, "
                                    "enabled boolean, review_rules array<struct<url_pattern:string,status:string>>, allowed_hosts array<string>")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "term string")
    terms = spark.createDataFrame([("plan parcial", "planning"), ("licencia", "buildingPermit")], "term string, kind string")
    return radar.RadarCatalog(sources, places, terms, words("viviendas"), words("garaje"))


TEXTS = ["Plan parcial de viviendas en Villa", "Licencia viviendas Villa garaje", "Licencia viviendas", "Plan parcial viviendas El Soto", "Plan Parcial, licencia: viviendas. Cerro"]


def test_radar_run(spark, catalog, places):
    failures = spark.createDataFrame([], "source_id string, error string")
    run = radar.radar_run(items(spark, TEXTS), failures, spark.createDataFrame([], schemas.CANDIDATES), spark.createDataFrame([], schemas.SOURCE_HEALTH), catalog, F.lit(NOW))
    got = {r.official_url[-1]: r for r in run.candidates.collect()}
    assert set(got) == {"0", "3", "4"}
    assert (got["3"].status, got["3"].municipality, got["4"].kind, got["4"].confidence) == ("rejected", "Villa", "planning", Decimal("0.70"))
    assert run.health.first().status == "healthy"
    assert {r.municipality: r.status for r in run.coverage.collect()} == {"Villa": "centralOnly", "Cerro": "centralOnly"}
    queue, domains, totals = radar.triage_report(run.candidates, F.lit(NOW), F.array().cast("array<string>"))
    assert queue.count() == 2 and totals.first().candidates == 2 and domains.count() == 1


def test_several_faults_are_one_failed_run(spark, catalog):
    failures = spark.createDataFrame([("s", "b"), ("s", "a"), ("other", "x")], "source_id string, error string")
    run = radar.radar_run(items(spark, TEXTS), failures, spark.createDataFrame([], schemas.CANDIDATES), spark.createDataFrame([], schemas.SOURCE_HEALTH), catalog, F.lit(NOW))
    assert [(r.source_id, r.success, r.error) for r in run.source_runs.collect()] == [("s", False, "a")]
    health = run.health.first()
    assert (health.status, health.consecutive_failures) == ("degraded", 1) and run.candidates.count() == 0


def test_radar_stream_equals_batch(spark, catalog, tmp_path):
    source = tmp_path / "in"
    for n in range(2):
        items(spark, TEXTS).where(f"seq % 2 = {n}").coalesce(1).write.mode("append").parquet(str(source))
    query = radar_stream(spark, str(source), str(tmp_path / "state"), str(tmp_path / "cp"), catalog, F.lit(NOW), max_files=1)
    query.awaitTermination(120)
    streamed = candidate_state(spark, str(tmp_path / "state"))
    batch = upsert_candidates(spark.createDataFrame([], schemas.CANDIDATES), radar.match(items(spark, TEXTS), catalog, F.lit(NOW)), [F.col("seq")])
    key = ["id", "title", "status", "municipality"]
    assert sorted(map(tuple, streamed.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))


def test_batches_rewrite_their_own_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "id long, n long"
    fold = lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))
    batches = [spark.range(200).selectExpr("id", "1L as n"), spark.createDataFrame([(3, 10), (4, 10), (900, 5)], schema), spark.createDataFrame([], schema), spark.createDataFrame([(3, 1)], schema)]
    sizes = [len(S.fold_batch(spark, path, n, batch, "id", schema, fold, buckets=64)) for n, batch in enumerate(batches)]
    assert sizes[0] > 55 and 1 < sizes[1] <= 3 and sizes[2:] == [0, 1]
    want = {i: 1 for i in range(200)} | {3: 12, 4: 11, 900: 5}
    assert dict(map(tuple, S.read_state(spark, path, schema).collect())) == want
    for n in (1, 3):  # a batch that comes again, whatever it holds, changes nothing
        assert S.fold_batch(spark, path, n, batches[0], "id", schema, fold) == []
    assert dict(map(tuple, S.read_state(spark, path, schema).collect())) == want
    assert S.committed(spark, path) == [1, 2, 3]
    files = {n: len(list((tmp_path / "state" / "data" / f"batch={n:012d}").rglob("*.parquet"))) for n in (0, 1, 3)}
    assert files[0] >= 55 and files[1] <= 3 and files[3] == 1  # as many as the batch has touched
    before = sum(1 for _ in (tmp_path / "state" / "data").rglob("*.parquet"))
    for n in range(4, 9):
        S.fold_batch(spark, path, n, spark.createDataFrame([(3, 1)], schema), "id", schema, fold)
    assert sum(1 for _ in (tmp_path / "state" / "data").rglob("*.parquet")) <= before + 2  # old buckets go
    assert dict(map(tuple, S.read_state(spark, path, schema).collect())) == want | {3: 17}
    crashed = tmp_path / "state" / "data" / "batch=000000000009" / "bucket=1"  # written, but without a manifest
    crashed.mkdir(parents=True)
    (crashed / "part.parquet").write_bytes(b"half")
    assert S.fold_batch(spark, path, 9, spark.createDataFrame([(4, 1)], schema), "id", schema, fold) and S.read_state(spark, path, schema).count() == 201


def test_damaged_files_fall_back_to_the_snapshot_before(spark, tmp_path):
    path = str(tmp_path / "state")
    for n in range(3):
        assert K.save_state(spark.range(10 * (n + 1)).repartition(3), path, f"{n:03d}")
    newest = tmp_path / "state" / "run_id=002"
    assert manifests.stated_rows(spark, str(newest)) == 30 and load_state(spark, path).count() == 30
    last = sorted(newest.glob("part-*.parquet"))[-1]
    whole = last.read_bytes()
    last.write_bytes(whole[:-20])  # the last part file only
    assert load_state(spark, path).count() == 20
    last.unlink()
    assert load_state(spark, path).count() == 20
    (tmp_path / "state" / "run_id=001" / "_manifest.json").write_text("{")
    assert load_state(spark, path).count() == 10
    (tmp_path / "state" / "run_id=000" / "_manifest.json").unlink()
    with pytest.raises(ValueError, match="no sound snapshot"):
        load_state(spark, path)


@pytest.mark.parametrize("batch_rows", [2000, 3])
def test_health_stream_equals_counters(spark, tmp_path, batch_rows):
    from listing_radar.operators.health import run_counters

    rows = [(f"s{i % 2}", i, NOW + timedelta(minutes=25 * i), i % 3 != 1, 0 if i % 4 else 2, 0, None) for i in range(48)]
    runs = spark.createDataFrame(rows, schemas.SOURCE_RUNS)
    for part in range(3):
        runs.where(f"run_id div 16 = {part}").orderBy(F.xxhash64("run_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("s0", -1, NOW - timedelta(hours=1), False, 0, 0, None)], schemas.SOURCE_RUNS)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    given = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        stream = health_stream(spark.readStream.schema(schemas.SOURCE_RUNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        name = f"health_{batch_rows}"
        query = stream.writeStream.format("memory").queryName(name).outputMode("update")
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)
    got = {r.run_id: (r.consecutive_failures, r.consecutive_empty_runs, r.status) for r in spark.table(name).collect()}
    expected = {r.run_id: (r.consecutive_failures, r.consecutive_empty_runs, r.status) for r in run_counters(runs, F.to_date("checked_at")).collect()}
    assert got.pop(-1)[2] == "late" and got == expected


def test_a_busy_source_is_folded_slice_by_slice():
    """A million runs of one source in disorder: no more than a slice of them is held."""
    import numpy as np
    import pandas as pd

    from listing_radar.streaming.radar import HealthProcessor

    class Kept(dict):
        most = 0

        def updateValue(self, key, value):
            self[key] = value

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    n = 1_000_000
    order = np.random.default_rng(1).permutation(n)
    frame = pd.DataFrame({"checked_at": pd.Timestamp(NOW) + pd.to_timedelta(order * 60, unit="s"), "run_id": order, "success": order % 5 != 0, "items_read": order % 3})
    processor = HealthProcessor(7 * 86_400)
    processor.state, processor.waiting = Value(), Kept()
    sizes, last = [], None
    for out in processor.handleInputRows(("s",), (frame[k : k + 50_000] for k in range(0, n, 50_000)), None):
        assert out.run_id.is_monotonic_increasing and (last is None or out.run_id.iloc[0] == last + 1)
        sizes.append(len(out))
        last = out.run_id.iloc[-1]
    assert sum(sizes) == n and max(sizes) <= 10_000 and not processor.waiting
    assert processor.state.value[:3] == (0, 1, True) and (out.status != "late").all()
