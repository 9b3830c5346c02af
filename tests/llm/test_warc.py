import base64
import hashlib
import io

import pytest

from lodestar.llm import warc
from lodestar.runtime import Scratch


def round_trip(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, extra int")
    tmp = Scratch(spark, "t")
    listing = tmp.write(warc.write_archives(df, "file://" + tmp.path("a"), archive_bytes=3000), "l")
    return warc.read_archives(listing).collect()


def test_round_trip_and_revisits(spark):
    big = "é" * 600
    rows = [(1, "u", big, 0), (2, "u", big, 0), (3, None, big, 0), (4, "u", "short", 0), (5, "u", "short", 0), (6, "u", None, 0), (7, "a\r\nb", "", 0), (8, "u", "\r\n\r\nWARC/1.1" + "z" * 5000, 0)]
    got = {r.page_id: r for r in round_trip(spark, rows)}
    assert len(got) == len(rows)
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        r = got[page_id]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        if page_id in (1, 2):
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("revisit", 3, b"")
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, payload)


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def test_members_over_small_reads_and_damage():
    data = [warc.record(i, "u", b"x" * (i * 37), None, False) for i in range(9)]
    archive = b"".join(map(warc.member, data))
    assert list(warc.members(io.BytesIO(archive).read, 7)) == data
    with pytest.raises(warc.Damaged):
        list(warc.members(io.BytesIO(archive[:-5]).read, 64))
    with pytest.raises(warc.Damaged):
        warc.parse(data[3].replace(b"xxx", b"xyx", 1))
    with pytest.raises(warc.Damaged):
        warc.parse(data[3][:-1])


def foreign(block, **fields):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in fields.items()}}
    return "WARC/1.0\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers():
    info = warc.parse(foreign(b"software: x\r\n", WARC_Type="warcinfo", Content_Type="application/warc-fields"))
    assert (info["record_type"], info["page_id"], info["payload_bytes"], info["record_id"]) == ("warcinfo", None, 13, "<urn:uuid:1>")
    body = b"<p>hi</p>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    page = warc.parse(foreign(block, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=b32(body), WARC_Block_Digest=b32(block), WARC_Target_URI="http://e/\r\n x"))
    assert (page["payload"], page["payload_bytes"], page["url"]) == (body, len(body), "http://e/ x")
    gone = warc.parse(foreign(b"", WARC_Type="revisit", WARC_Payload_Digest=b32(body), WARC_Refers_To="<urn:uuid:0>"))
    assert (gone["payload_bytes"], gone["refers_to"], gone["payload_digest"]) == (None, None, b32(body)[5:])
    assert warc.parse(foreign(b"GET /", WARC_Type="request", WARC_Block_Digest="xyz:1"))["record_type"] == "request"
    assert warc.parse(foreign(body, WARC_Block_Digest="sha256:" + hashlib.sha256(body).hexdigest()))["payload_digest"] == hashlib.sha1(body).hexdigest()
    for bad in (foreign(block, Content_Type="application/http", WARC_Payload_Digest=b32(block)), foreign(body, WARC_Block_Digest=b32(b"")), foreign(body, Content_Length="x")):
        with pytest.raises(warc.Damaged):
            warc.parse(bad)


def test_repeated_and_null_ids(spark):
    big = "z" * 1500
    got = round_trip(spark, [(5, "u", big, 0), (5, "u", big, 0), (None, "u", big, 0), (None, "u", "s", 0), (2, "u", big, 0)])
    shape = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert shape == [(2, "revisit", 5, 1500), (5, "response", None, 1500), (5, "response", None, 1500), (None, "response", None, 1), (None, "revisit", 5, 1500)]
