"""GTFS archives as a data source: members are read by ranges of the file, and rows leave in batches.

    register(spark)
    spark.read.format("gtfs_archive").option("member", "stops.txt").load(folder)

Only the directory at the end of each archive is read to plan the partitions. A partition is one large member, or small
members up to SPLIT bytes; a member is one stream, as its compression has no places to start from. No archive and no
member lies in memory as a whole. Paths are those of Arrow's file systems (local, hdfs, s3, gs); for others read
`binaryFile` and use feeds.archive_rows().
"""

from __future__ import annotations

import csv
import io
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "feed string, file string, row bigint, fields map<string,string>, error string"
ARROW = pa.schema([("feed", pa.string()), ("file", pa.string()), ("row", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
SPLIT = 32 << 20  # compressed bytes of the members that share a partition
CHUNK = 1 << 20
#: What a broken archive or member raises. A file that can't be opened or read is no such case: its task fails and is tried again.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, struct.error, RuntimeError, ValueError)


def member_rows(stream: io.RawIOBase | io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str]]]:
    """Number and fields of each row of a .txt member that is not blank; a byte order mark goes, missing fields are empty."""
    text = io.TextIOWrapper(stream, "utf-8-sig", errors="replace", newline="")
    for i, row in enumerate(csv.DictReader(text)):
        if any((v or "").strip() for k, v in row.items() if k):
            yield i, {k.strip(): v or "" for k, v in row.items() if k}


class _Ranges(io.RawIOBase):
    """A file of Arrow's as Python's; a place before its start is an OSError, as zipfile expects when it looks for the directory."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + (0, self.file.tell(), self.file.size())[whence]
        if to < 0:
            raise OSError("before the start of the file")
        return self.file.seek(to)

    def readinto(self, into) -> int:
        return self.file.readinto(into)

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(system: fs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(_Ranges(system.open_input_file(path)), CHUNK)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    feeds, files, numbers, fields, errors = zip(*rows, strict=True)
    columns = [feeds, files, numbers, [None if f is None else list(f.items()) for f in fields], errors]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


@dataclass
class Members(InputPartition):
    """(archive, position in its directory, name, error) of each member; an archive without directory has only an error."""

    parts: list[tuple[str, int, str | None, str | None]]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, member: str | None, batch: int):
        self.path, self.member, self.batch = path, member, batch

    def _directory(self, system: fs.FileSystem, path: str) -> list[tuple[int, tuple]]:
        try:
            with _opened(system, path) as f, zipfile.ZipFile(f) as z:
                listed = [(k, m) for k, m in enumerate(z.infolist()) if m.filename.endswith(".txt")]
        except BROKEN as e:
            return [(0, (path, -1, None, _reason(e)))]
        return [(m.compress_size, (path, k, m.filename, None)) for k, m in listed if self.member in (None, m.filename)]

    def partitions(self) -> list[Members]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        paths = [root]
        if found.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(root, recursive=True))
            paths = sorted(f.path for f in inside if f.is_file and f.path.endswith(".zip"))
        bins, room = [], 0
        with ThreadPoolExecutor(16) as pool:
            for size, part in (m for d in pool.map(lambda p: self._directory(system, p), paths) for m in d):
                if not bins or size > room:
                    bins, room = [*bins, []], SPLIT
                bins[-1].append(part)
                room -= size + 1024  # opening costs too
        return [Members(b) for b in bins] or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        csv.field_size_limit(1 << 30)
        rows: list[tuple] = []
        for path, k, name, error in partition.parts:
            feed = posixpath.basename(path)
            for row in [(feed, name, None, None, error)] if error else self._rows(system, path, k, feed, name):
                rows.append(row)
                if len(rows) == self.batch:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _rows(self, system: fs.FileSystem, path: str, k: int, feed: str, name: str) -> Iterator[tuple]:
        with _opened(system, path) as f, zipfile.ZipFile(f) as z:
            info = z.infolist()[k]
            try:
                with z.open(info) as whole:  # its checksum first, so that a broken member gives no rows
                    while whole.read(CHUNK):
                        pass
            except BROKEN as e:
                yield feed, name, None, None, _reason(e)
                return
            with z.open(info) as stream:
                for i, fields in member_rows(stream):
                    yield feed, name, i, fields, None


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gtfs_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("member"), int(self.options.get("batch", 5000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str, member: str | None = None, batch: int = 5000) -> DataFrame:
    """Rows of the .txt members (or of one of them) of the archive or the folder of .zip files at `path`: feed (the
    file's name), file, row, fields by name, error.

    A broken archive or member gives one row instead of its own: error says why, and row and fields are null; an archive
    without directory has no file either. An archive without such members and an empty folder give nothing; a missing
    path raises. Of members with one name all are read. Bytes that are no UTF-8 become replacement characters.
    """
    register(spark)
    reader = spark.read.format("gtfs_archive").option("batch", str(batch))
    return (reader.option("member", member) if member else reader).load(path)


class _Counted(io.RawIOBase):
    """An output stream whose write() says how much it took, which zipfile counts on."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)


def write_archives(lines: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """Writes an archive `feed`.zip below `folder` for each feed of `lines` (feed, file, line), each file's lines by `order`.

    Returns feed and lines (their number), once written; nothing is written before the result is asked for. A feed's lines
    meet in one task, sorted by Spark, and pass on as they come. An archive gets its name when it is whole, so an attempt
    that is lost leaves none, and a second attempt writes the same. An empty table writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        feed = file = out = archive = member = temporary = None
        n = 0

        def close() -> pa.RecordBatch:
            member.close()
            archive.close()
            out.close()
            system.move(temporary, f"{root}/{feed}.zip")
            return pa.RecordBatch.from_pydict({"feed": pa.array([feed], pa.string()), "lines": pa.array([n], pa.int64())})

        for batch in batches:
            for one, name, line in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if one != feed or archive is None:
                    if archive is not None:
                        yield close()
                    feed, file, n, temporary = one, None, 0, f"{root}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    archive = zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_DEFLATED)
                if name != file:
                    if file is not None:
                        member.close()
                    file, member = name, archive.open(name, "w", force_zip64=True)
                member.write(f"{line or ''}\r\n".encode())
                n += 1
        if archive is not None:
            yield close()

    rows = lines.filter("feed is not null and file is not null").select("feed", "file", "line", *order)
    return rows.repartition("feed").sortWithinPartitions("feed", "file", *order).mapInArrow(write, "feed string, lines bigint")
