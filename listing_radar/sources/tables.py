"""Catalogs, page folders and state snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from listing_radar import schemas
from listing_radar.functions.urls import is_http_url
from listing_radar.sources.manifests import read_if_sound


def read_page_dir(spark: SparkSession, path: str, start_urls: list[str]) -> DataFrame:
    """HTML files of a folder as pages. URL: the page's own source-url tag, else the start URL at the
    file's place in name order, else a made-up one."""
    raw = spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("html"))
    starts = F.array(*[F.lit(u) for u in start_urls]) if start_urls else F.array().cast("array<string>")
    # only the first files, one per start URL, get a number
    named = raw.select("file").orderBy("file").limit(len(start_urls)).withColumn(
        "place", F.row_number().over(Window.orderBy("file")))
    raw = raw.join(F.broadcast(named), "file", "left")
    place = F.col("place")
    stated = F.regexp_extract("html", r"(?is)<meta[^>]*name=[\"']source-url[\"'][^>]*content=[\"']([^\"']*)", 1)
    url = F.coalesce(
        F.nullif(stated, F.lit("")), F.try_element_at(starts, place),
        F.concat(F.lit("https://fixture.invalid/"), F.col("file")))
    return raw.select(url.alias("url"), "html", F.lit("text/html").alias("content_type"), F.lit("fixture").alias("extractor_hint"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def seed_urls(sources: DataFrame) -> DataFrame:
    rows = sources.select("source_id", F.posexplode("start_urls").alias("seq", "url"))
    return rows.where(is_http_url(F.col("url")))


def read_manual_urls(spark: SparkSession, path: str) -> DataFrame:
    """URL list: text lines (blank and # lines dropped), or JSON, an array or an object with ``urls``."""
    if path.lower().endswith(".json"):
        raw = spark.read.text(path, wholetext=True)
        listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "urls array<string>")["urls"])
        rows = raw.select(F.posexplode(listed).alias("seq", "url"))
    else:
        raw = spark.read.text(path, wholetext=True)
        rows = raw.select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "url"))
    rows = rows.select("seq", F.trim("url").alias("url"))
    return rows.where((F.col("url") != "") & ~F.col("url").startswith("#") & is_http_url(F.col("url")))


def read_catalog(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Named array of a catalog file as rows, with its position as ``ord``. Keys are read without case."""
    schema = schemas.CATALOGS[name]
    document = spark.read.schema(schema).json(path, multiLine=True)
    entry = document.schema[name].dataType.elementType
    if getattr(entry, "fields", None) is None:
        return document.select(F.posexplode(name).alias("ord", schemas.PLAIN_NAMES[name]))
    rows = document.select(F.posexplode(name).alias("ord", "e")).select("ord", "e.*")
    return rows.toDF(*[schemas.snake(c) for c in rows.columns])


def read_centroid_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema=schemas.CENTROID_CSV)


def load_state(spark: SparkSession, path: str, generations: int = 3) -> DataFrame | None:
    """Newest snapshot of the last ``generations`` whose files agree with its manifest; None without any, an error if none of them
    agrees. The data are not read for it."""
    folders = snapshot_folders(spark, path)
    if not folders:
        return None
    for folder in folders[:generations]:
        state = read_if_sound(spark, folder)
        if state is not None:
            return state
    raise ValueError(f"no sound snapshot in {path}")


def snapshot_folders(spark: SparkSession, path: str) -> list[str]:
    """Complete snapshots (they have a success marker), newest first."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    runs = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("run_id=")]
    done = [p for p in runs if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((p.toString() for p in done), reverse=True)


