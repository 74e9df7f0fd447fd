"""Manifests: small files, written last, that say which data files make up a table.

A reader takes the newest manifest that agrees with the files as the file system describes them; the data are not read for it.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

NAME = "_manifest.json"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name first, so that no reader sees a part of it; an existing file is replaced."""
    system, place = _file_system(spark, path)
    waiting = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}.writing")
    out = system.create(waiting, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(place):
        system.delete(place, False)
    if not system.rename(waiting, place):
        raise OSError(f"cannot rename {waiting.toString()}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None if it is not there or fails its checksum."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    except Py4JJavaError as problem:
        if problem.java_exception.getClass().getSimpleName() != "ChecksumException":
            raise
        return None
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    system, place = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)


def described_files(spark: SparkSession, folder: str) -> dict[str, list]:
    """Length and checksum (null where the file system keeps none) of every data file of a folder."""
    system, place = _file_system(spark, folder)
    out = {}
    for status in system.listStatus(place):
        name = status.getPath().getName()
        if status.isFile() and name[0] not in "_.":
            checksum = system.getFileChecksum(status.getPath())
            out[name] = [status.getLen(), None if checksum is None else checksum.toString()]
    return out


def write_manifest(spark: SparkSession, folder: str) -> None:
    """Say of a written Parquet folder which files it has, with their lengths, checksums and numbers of rows (from their footers)."""
    files = described_files(spark, folder)
    rows: dict[str, int] = {}
    if files:
        counted = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"))
        rows = {r.name: r.n for r in counted.collect()}  # a row per file
    write_text(spark, f"{folder}/{NAME}", json.dumps({"files": {name: [*known, rows.get(name, 0)] for name, known in files.items()}}, indent=1))


def agrees(spark: SparkSession, folder: str) -> bool:
    """Whether a folder has a manifest and exactly the files that it names, unchanged as far as the file system tells."""
    text = read_text(spark, f"{folder}/{NAME}")
    if text is None:
        return False
    try:
        stated = {name: known[:2] for name, known in json.loads(text)["files"].items()}
    except (ValueError, KeyError, TypeError, AttributeError):
        return False
    return stated == described_files(spark, folder)


def stated_rows(spark: SparkSession, folder: str) -> int:
    """Number of rows that a manifest states."""
    return sum(known[2] for known in json.loads(read_text(spark, f"{folder}/{NAME}"))["files"].values())


def read_if_sound(spark: SparkSession, folder: str) -> DataFrame | None:
    return spark.read.parquet(folder) if agrees(spark, folder) else None
