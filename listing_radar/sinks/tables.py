"""Published files, logs and state snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar.fixed_values import CSV_COLUMNS
from listing_radar.operators.explore import dataset_order
from listing_radar.operators.quality import by_municipality, dataset_statistics
from listing_radar.sources.manifests import write_manifest
from listing_radar.sources.tables import snapshot_folders


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.title() for part in rest)


def dataset_documents(promotions: DataFrame) -> DataFrame:
    """One JSON document per listing, keys in camelCase, missing values left out."""
    return promotions.select("municipality", "name", "id", F.to_json(
        F.struct(*[F.col(c).alias(_camel(c)) for c in promotions.columns])).alias("document"))


def write_dataset_json(promotions: DataFrame, path: str, header: DataFrame | None = None) -> None:
    """Ordered documents, and next to them the header, the statistics and the counts per place."""
    dataset_documents(promotions).orderBy(*dataset_order()).select("document").write.mode("overwrite").text(f"{path}/promotions")
    dataset_statistics(promotions).write.mode("overwrite").json(f"{path}/statistics")
    by_municipality(promotions).write.mode("overwrite").json(f"{path}/by_municipality")
    if header is not None:
        header.write.mode("overwrite").json(f"{path}/header")


def _plain(c: Column) -> Column:
    text = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(text, r"\.$", "")


#: Tells spreadsheet programs that a file is UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def csv_rows(promotions: DataFrame) -> DataFrame:
    """The 24 exported columns as text, arrays joined by `` | ``."""
    out = []
    for name, column in CSV_COLUMNS.items():
        kind, value = dict(promotions.dtypes)[column], F.col(column)
        if kind.startswith("array"):
            value = F.array_join(value, " | ")
        elif kind == "timestamp":
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            value = _plain(value)
        out.append(F.coalesce(value.cast("string"), F.lit("")).alias(name))
    return promotions.select(*out)


def write_csv(promotions: DataFrame, path: str) -> None:
    """Range-sorted by id over all tasks; quotes are doubled. Every part is a file of its own, with byte-order mark and header."""
    rows = csv_rows(promotions).orderBy("id")
    first, *rest = rows.columns
    rows.select(F.col(first).alias(BYTE_ORDER_MARK + first), *rest).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", encoding="UTF-8")


def geojson_features(promotions: DataFrame) -> DataFrame:
    """One feature per located listing, longitude before latitude."""
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("id"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(
            "name", "municipality", F.col("price_from").alias("priceFrom"), F.col("commercial_status").alias("commercialStatus"),
            F.col("location_precision").alias("locationPrecision"), F.col("canonical_url").alias("canonicalUrl"),
        ).alias("properties"),
    )
    return promotions.where("latitude is not null and longitude is not null").select("id", F.to_json(feature).alias("feature"))


def write_geojson(promotions: DataFrame, path: str) -> None:
    geojson_features(promotions).orderBy("id").select("feature").write.mode("overwrite").text(path)


def write_run_report(report: DataFrame, path: str, run_id: str) -> None:
    report.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_report(report: DataFrame, items: DataFrame, path: str) -> None:
    """A report of one row and its item rows."""
    report.write.mode("overwrite").json(f"{path}/report")
    items.write.mode("overwrite").parquet(f"{path}/report_items")


def save_state(state: DataFrame, path: str, run_id: str, publishable: bool = True, dry_run: bool = False,
               keep: int = 3) -> bool:
    """Write a snapshot of its own folder and drop all but the last ``keep``. Nothing is written when the
    run is not publishable. The manifest is written last, so a reader never takes half of a snapshot."""
    if dry_run or not publishable:
        return False
    state.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
    spark = state.sparkSession
    write_manifest(spark, f"{path}/run_id={run_id}")
    for folder in snapshot_folders(spark, path)[keep:]:
        old = spark._jvm.org.apache.hadoop.fs.Path(folder)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return True
