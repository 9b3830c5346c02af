"""WARC archives: a writer with revisit records and a sequential reader.

Writer: one gzip member per record, archives rolled at ``ARCHIVE_BYTES``, each partition its own archives in a
shared folder. A payload of at least ``MIN_REVISIT`` bytes that several records share is stored once, in the
record of the largest id; the others become revisit records that carry the digest and length of the full
payload and the id that they refer to.

Reader: walks an archive member by member with an incremental zlib inflater over fixed-size reads, frames each
record by its Content-Length, and verifies the block against WARC-Block-Digest (and, where the payload is in
the record, WARC-Payload-Digest). A damaged member raises; nothing is skipped in silence. Archives of other writers are
read too (see ``parse``).

Defined cases: a null payload counts as empty; ids may repeat (all rows with the largest id of a digest are
responses) and a null id is written as empty; empty tables give no archive and no record.
Scale: digests are pre-aggregated per partition, groups of copies meet only as one (digest, largest id) row,
and the payload column is never shuffled while that table of repeated digests fits a checked broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.runtime import Scratch, bound_arrow, small

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 256 << 10
#: zlib level: 1 is about three times as fast as 6 for a quarter more bytes on web pages.
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
#: How our own record ids begin.
OWN = "<urn:page:"

RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string())])


def _urn(page_id: int | None) -> str:
    return f"{OWN}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed; a revisit's block is empty, its payload headers describe the full payload."""
    digest = hashlib.sha1(payload).hexdigest()
    block = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest() if revisit else digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without a time stamp, so that a retried task writes the same bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, *, payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload column) rows as archives under ``folder``; returns (archive, n_records).

    The write happens when the result is evaluated. A retried or speculative task writes under a name of its own
    and moves it into place, so the archives are whole and the same whichever attempt wins.
    """
    spark = pages.sparkSession
    bound_arrow(spark, 256)
    base = pages.select("page_id", "url", F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    keyed = base.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    shared = keyed.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1")
    tmp = Scratch(spark, "warc-digests")
    shared = tmp.write(shared.select(F.col("digest").alias("shared_digest"), "keeper"), "shared")
    rows = keyed.join(small(shared, shared.count(), 96), (F.col("digest") == F.col("shared_digest")) & (F.col("n") >= MIN_REVISIT), "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        out, name, n, size, k = None, "", 0, 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                final = f"{root}/part-{part:06d}-{k:04d}.warc.gz"
                fs.move(name, final)
                done.append((f"{folder.rstrip('/')}/{final.rsplit('/', 1)[1]}", n))
                out = None

        for batch in batches:
            for page_id, url, body, ref in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is not None and size >= archive_bytes:
                    close()
                    k += 1
                if out is None:
                    name, n, size = f"{root}/.{uuid.uuid4().hex}", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                data = member(record(page_id, url, body, ref, ref is not None))
                out.write(data)
                n, size = n + 1, size + len(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done]), pa.array([c for _, c in done], pa.int64())], names=["archive", "n_records"])

    return rows.mapInArrow(run, "archive string, n_records long")


class Damaged(ValueError):
    """An archive that is cut off or whose digests do not hold."""


def members(read, size: int = READ_BYTES) -> Iterator[bytes]:
    """The uncompressed bytes of each gzip member; ``read(n)`` gives up to n bytes, none at the end."""
    pending = b""
    while True:
        pending = pending or read(size)
        if not pending:
            return
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            if not pending and not (pending := read(size)):
                raise Damaged("the archive ends inside a record")
            parts.append(inflater.decompress(pending))
            pending = inflater.unused_data if inflater.eof else b""
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined, and the first of equal names counts."""
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    out: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", text).split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _holds(said: str, data: bytes) -> bool:
    """Whether a labelled digest (``sha1:...``, in hex or base32) is that of the data; algorithms that are not known here are taken on trust."""
    name, _, value = said.partition(":")
    if name.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(name.lower().replace("-", ""), data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def parse(data: bytes) -> dict:
    """A record's fields, after framing by Content-Length and digest verification.

    Records of other writers are read as well: of any type, with digests in hex or base32 or without, with an HTTP message as their block (the
    payload is its body). Their page_id is null, ``record_id`` names them; the length of a payload that is not in the record is null unless it is told.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise Damaged("a member does not start with a WARC header")
    field = _fields(head)
    who = field.get("warc-record-id", "")
    if not field.get("content-length", "").isdecimal() or "warc-type" not in field:
        raise Damaged(f"{who}: no Content-Length or no type")
    n = int(field["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise Damaged(f"{who}: Content-Length does not frame the record")
    kind, said, payload = field["warc-type"], field.get("warc-payload-digest"), block
    http = field.get("content-type", "").lower().startswith("application/http")
    if http:
        start, _, payload = block.partition(b"\r\n\r\n")
    whole = kind != "revisit"
    if "warc-block-digest" in field and not _holds(field["warc-block-digest"], block):
        raise Damaged(f"{who}: digest mismatch")
    coded = http and b"transfer-encoding" in start.lower()  # such a digest may be of the body as sent or as meant
    if whole and said is not None and not coded and not _holds(said, payload):
        raise Damaged(f"{who}: digest mismatch")
    number = lambda name: int(x) if (x := field.get(name, "").removeprefix(OWN).rstrip(">")).lstrip("-").isdecimal() and field[name].startswith(OWN) else None
    told = field.get("warc-payload-length", "")
    return {
        "page_id": number("warc-record-id"), "url": field.get("warc-target-uri", ""), "record_type": kind, "refers_to": number("warc-refers-to"),
        "payload_bytes": int(told) if told.isdecimal() else len(payload) if whole else None,
        "payload_digest": said.removeprefix("sha1:") if said is not None else hashlib.sha1(payload).hexdigest() if whole else None, "payload": payload, "record_id": who,
    }


def read_archives(archives: DataFrame, *, keep_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of the archives named in column ``archive``, read one after another, batch by batch."""
    names = [f.name for f in RECORD if keep_payload or f.name != "payload"]
    kinds = {"page_id": "long", "refers_to": "long", "payload_bytes": "long", "payload": "binary"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    arrow = pa.schema([RECORD.field(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for data in members(f.read):
                        rows.append({k: v for k, v in parse(data).items() if k in names})
                        held += len(data) if keep_payload else 256
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return archives.select("archive").mapInArrow(run, schema)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "warc")
    folder = tmp.path("archives")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    listing = tmp.write(write_archives(pages, folder if "://" in folder else f"file://{folder}"), "listing")
    n = max(1, listing.count())
    records = read_archives(listing.repartition(min(n, max(spark.sparkContext.defaultParallelism, 8) * 4)), keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT payload_digest AS dg, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d LEFT JOIN k ON payload_digest = dg AND payload_bytes >= 1000
"""
