"""Zip archives as a sink: members deflated in parallel, places by prefix sums, one central directory an archive.

Members (archive, name, content) are compressed wherever their rows are. The place of each member's header is the sum of what lies before it in
the archive, in the order of names, so it is known before anything is written; the writer then streams compressed members to the file one after the
other and keeps of each only its directory entry. Tasks write under temporary names, which the driver makes final when all tasks are
done, and removes if one fails; what a failed attempt left is never seen under an archive's name. Time stamps are fixed, so equal
members give equal bytes. Places and sizes beyond four gigabytes take the 64-bit records of the format.

Archives go to any file system that Arrow knows (local or mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lodestar.runtime import Scratch, arrow_rows

# Fixed values of the zip format
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
VERSION, VERSION64, UTF8, DEFLATED, DATE = 20, 45, 0x800, 8, 0x21
HEADER = 30
LIMIT, MOST = 0xFFFFFFFF, 0xFFFF

ROW = "archive string, name string, crc long, size long, packed long, offset long, data binary"


def deflated(members: DataFrame) -> DataFrame:
    """(archive, name, crc, size, packed, data) of members (archive, name, content); a null content is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = content or b""
                packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                data = packer.compress(raw) + packer.flush()
                yield pa.RecordBatch.from_pylist([{"archive": archive, "name": name, "crc": zlib.crc32(raw), "size": len(raw), "packed": len(data), "data": data}])

    return members.select("archive", "name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "archive string, name string, crc long, size long, packed long, data binary")


def placed(packed: DataFrame) -> DataFrame:
    """``packed`` with offset: where a member's local header begins."""
    before = W.partitionBy("archive").orderBy("name").rowsBetween(W.unboundedPreceding, -1)
    extra = F.when((F.col("size") >= LIMIT) | (F.col("packed") >= LIMIT), 20).otherwise(0)
    at = F.coalesce(F.sum(HEADER + F.octet_length("name") + extra + F.col("packed")).over(before), F.lit(0))
    slim = packed.select("archive", "name", "size", "packed").withColumn("offset", at.cast("long")).select("archive", "name", "offset")
    return packed.join(slim, ["archive", "name"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary and final names


def _local(row, name: bytes) -> bytes:
    big = row.size >= LIMIT or row.packed >= LIMIT
    extra = struct.pack("<HHQQ", 1, 16, row.size, row.packed) if big else b""
    return LOCAL + struct.pack("<5H3I2H", VERSION64 if big else VERSION, UTF8, DEFLATED, 0, DATE, row.crc, *((LIMIT, LIMIT) if big else (row.packed, row.size)), len(name), len(extra)) + name + extra


def _central(row, name: bytes) -> bytes:
    wide = [v for v in (row.size, row.packed, row.offset) if v >= LIMIT]
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    clip = lambda v: min(v, LIMIT)
    version = VERSION64 if wide else VERSION
    return CENTRAL + struct.pack("<6H3I5H2I", version, version, UTF8, DEFLATED, 0, DATE, row.crc, clip(row.packed), clip(row.size), len(name), len(extra), 0, 0, 0, 0, clip(row.offset)) + name + extra


def _end(n: int, size: int, start: int) -> bytes:
    out = b""
    if n > MOST or size >= LIMIT or start >= LIMIT:
        out = END64 + struct.pack("<Q2H2I4Q", 44, VERSION64, VERSION64, 0, 0, n, n, size, start) + LOCATOR64 + struct.pack("<IQI", 0, start + size, 1)
    return out + END + struct.pack("<4H2IH", 0, 0, min(n, MOST), min(n, MOST), min(size, LIMIT), min(start, LIMIT), 0)


class ZipWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        return store, path.rstrip("/")

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, root = self._store()
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        files: list[tuple[str, str]] = []
        out, now, at, directory = None, None, 0, []

        def finish() -> None:
            start = at
            for entry in directory:
                out.write(entry)
            out.write(_end(len(directory), sum(map(len, directory)), start))
            out.close()

        for row in iterator:
            if row.archive != now:
                if out is not None:
                    finish()
                now, at, directory = row.archive, 0, []
                temp = f"{root}/_temporary-{task.partitionId()}-{task.taskAttemptId()}-{len(files)}"
                files.append((temp, f"{root}/{now}"))
                out = store.open_output_stream(temp)
            if row.offset != at:
                raise ValueError(f"{now}: {row.name} should lie at {row.offset}, not {at}")
            name = row.name.encode()
            head = _local(row, name)
            out.write(head)
            out.write(row.data)
            at += len(head) + row.packed
            directory.append(_central(row, name))
        if out is not None:
            finish()
        return Written(files)

    def commit(self, messages) -> None:
        store, _ = self._store()
        for message in messages:
            for temp, final in message.files if message else ():
                store.move(temp, final)

    def abort(self, messages) -> None:
        store, _ = self._store()
        for message in messages:
            for temp, _final in message.files if message else ():
                if store.get_file_info(temp).type != fs.FileType.NotFound:
                    store.delete_file(temp)


class ZipArchives(DataSource):
    """Rows of ``ROW``, an archive's rows together and in the order of their offsets; option ``path``: the folder."""

    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def schema(self) -> str:
        return ROW

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"])


def write_zips(members: DataFrame, folder: str) -> None:
    """Write members (archive, name, content) to one zip file an archive under ``folder``; an archive that is there is replaced.

    Names must be unique in their archive (see ``corpus.unique_names``); archive names are file names.
    """
    spark = members.sparkSession
    scratch = Scratch(spark, "zip")
    with arrow_rows(spark, 16):  # members may be large
        packed = scratch.write(deflated(members), "packed")
    spark.dataSource.register(ZipArchives)
    rows = placed(packed).select(*[c.split()[0] for c in ROW.split(", ")]).repartition("archive").sortWithinPartitions("archive", "offset")
    rows.write.format("zip_archives").option("path", folder).mode("append").save()
    scratch.drop("packed")
