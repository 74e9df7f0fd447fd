"""Members of zip archives as documents: a data source whose partitions are members.

The central directory at the end of an archive names its members with their sizes and places, so planning reads that alone. A task
opens the archive at its members' places and unpacks them one after the other; no task holds an archive. What cannot be read, a whole
archive or one member, is a row with ``error``.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from listing_radar.operators.scale import broadcast_if_small

#: What opening an archive or unpacking a member may raise.
UNREADABLE = (zipfile.BadZipFile, OSError, EOFError, RuntimeError, NotImplementedError, ValueError, struct.error, zlib.error)
#: Unpacked bytes of small members that one partition takes together.
PARTITION_BYTES = 32 << 20
#: Partitions that a smaller size may lead to; with more members they grow up to ``PARTITION_BYTES`` first.
PARTITIONS = 256
SCHEMA = "file string, member string, number long, content string, error string"


@dataclass
class Members(InputPartition):
    """Some members of archives: a file with members by name and number, or with the reason why it has none."""

    archives: list[tuple[str, list[tuple[str, int]], str | None]]


def reason(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"[:200]


def named_members(archive: zipfile.ZipFile, suffix: str) -> list[tuple[int, zipfile.ZipInfo]]:
    """Members with a suffix, whatever its case, numbered in the order of their names."""
    return list(enumerate(sorted((m for m in archive.infolist() if m.filename.lower().endswith(suffix)), key=lambda m: m.filename)))


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".atom").lower()
        self.most = int(options.get("partitionbytes") or options.get("partitionBytes") or PARTITION_BYTES)

    def partitions(self) -> list[Members]:
        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.Directory:
            files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith(".zip"))
        else:
            files = [path]
        entries, total = [], 0  # (file, member's name and number or None, size, error)
        for file in files:
            try:
                with system.open_input_file(file) as data, zipfile.ZipFile(data) as archive:
                    named = named_members(archive, self.suffix)
            except UNREADABLE as problem:
                entries.append((file, None, 0, reason(problem)))
                continue
            for number, member in named:
                entries.append((file, (member.filename, number), member.file_size, None))
                total += member.file_size
        most = max(self.most, min(PARTITION_BYTES, total // PARTITIONS))
        out, size = [Members([])], 0
        for file, member, length, error in entries:
            if out[-1].archives and size + length > most:
                out.append(Members([]))
                size = 0
            archives = out[-1].archives
            if not archives or archives[-1][0] != file:
                archives.append((file, [], error))
            if member is not None:
                archives[-1][1].append(member)
            size += length
        return out

    def read(self, partition: Members):
        system, _ = fs.FileSystem.from_uri(self.path)
        for file, members, error in partition.archives:
            if error is not None:
                yield file, None, -1, None, error
                continue
            with system.open_input_file(file) as data, zipfile.ZipFile(data) as archive:
                for name, number in members:
                    try:
                        yield file, name, number, archive.read(name).decode("utf-8", "replace"), None
                    except UNREADABLE as problem:
                        yield file, name, number, None, reason(problem)


class ZipMembers(DataSource):
    """``path``: an archive or a folder of archives; ``suffix``: of the members to read; ``partitionBytes``: unpacked bytes together."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def read_archive_files(spark: SparkSession, path: str, sources: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Members as documents of their sources. ``sources`` are (source_id, source_url, document_date, file), where a file is named by
    the end of its path. ``seq_base`` keeps the members of an archive apart, in the order of their names."""
    spark.dataSource.register(ZipMembers)
    members = spark.read.format("zip_members").option("partitionBytes", str(partition_bytes)).load(path)
    named = members.withColumn("_name", F.substring_index("file", "/", -1)).drop("file")
    rows = named.join(broadcast_if_small(sources.withColumn("_name", F.substring_index("file", "/", -1)), sources), "_name")
    return rows.select("source_id", "source_url", "document_date", "member", F.shiftleft(F.greatest("number", F.lit(0).cast("long")), 32).alias("seq_base"), "content", "error")
