import io
import json
import zipfile

import pytest

from lodestar.sources import chunkers, corpus
from lodestar.sources.store import Store

TEXTS = {
    "brd": "intro line\nmore\r\n\r\n# One\n## Two ##\nbody a\nbody b\n\n \t\nbody c\n# Three\n",
    "transcript": "\n hello all\nAna: first\nmore\nNote: not a speaker\n[00:01] Bob: second\n\n",
    "form": 'id,q,a\n"F-1",what,"x, y"\n\nF-2,why,z\n',
    "jira": '[{"key": "A-1", "t": "br{ce \\" }"}, {"id": 7, "x": {"y": 1}}, {"z": 2}]',
    "other": "para one\nstill\n\n\npara two\x0b\n",
}


def python_paragraphs(raw):
    out, pos, start, end = [], 0, None, 0
    for line in raw.splitlines(keepends=True):
        if line.strip():
            start, end = (pos if start is None else start), pos + len(line)
        elif start is not None:
            out.append((start, end))
            start = None
        pos += len(line)
    return out + ([(start, end)] if start is not None else [])


def test_chunks_are_verbatim_slices(spark):
    docs = spark.createDataFrame([(k, k, v) for k, v in TEXTS.items()] + [("none", "brd", None), ("empty", "form", "")], "doc_id string, source_type string, text string")
    rows = chunkers.chunk(docs).orderBy("doc_id", "idx").collect()
    assert all(r.text == TEXTS[r.doc_id][r.start : r.end] for r in rows)
    by = {k: [(r.location, r.text) for r in rows if r.doc_id == k] for k in TEXTS}
    assert by["brd"] == [("(top)", "intro line\nmore\r\n"), ("One", "# One\n"), ("One › Two ##", "## Two ##\n"), ("One › Two ##", "body a\nbody b\n"), ("One › Two ##", "body c\n"), ("Three", "# Three\n")]
    assert [x[0] for x in by["transcript"]] == ["(intro)", "Ana", "Bob"] and by["transcript"][0][1] == " hello all\n"
    assert by["form"] == [("F-1", '"F-1",what,"x, y"\n'), ("F-2", "F-2,why,z\n")]
    assert [x[0] for x in by["jira"]] == ["A-1", "7", ""]
    assert [(r.start, r.end) for r in rows if r.doc_id == "other"] == python_paragraphs(TEXTS["other"])


def test_manifest_documents_and_word_files(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Spec", "Title") + p("Scope", "Heading3") + p("Text") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "s.docx").write_bytes(data.getvalue())
    (tmp_path / "docs" / "m.txt").write_bytes("caf\xe9 ok".encode("cp1252"))
    (tmp_path / "manifest.json").write_text("﻿" + json.dumps({"domain": "d", "docs": [{"doc_id": "s", "file": "docs/s.docx"}, {"doc_id": "m", "file": "docs/m.txt", "source_type": "transcript"}]}), encoding="utf-8")
    rows = {r.doc_id: (r.source_type, r.text) for r in corpus.documents(spark, str(tmp_path)).collect()}
    assert rows == {"s": ("brd", "# Spec\n\n### Scope\n\nText\n\na | b"), "m": ("transcript", "café ok")}
    assert {r.name: r.size for r in corpus.files(spark, str(tmp_path / "docs")).collect()}["m.txt"] == "7 B"


def test_pdf_lines_names_and_csv(spark, tmp_path):
    words = [("d", 0, 1, 0.0, 10.0, 20.0, "Title"), ("d", 1, 1, 50.0, 40.2, 10.0, "world"), ("d", 2, 1, 0.0, 40.0, 10.0, "hello"), ("d", 3, 1, 0.0, 60.0, 11.5, "Sub"), ("d", 4, 2, 0.0, 10.0, 10.0, "end")]
    df = spark.createDataFrame(words, "doc_id string, seq int, page int, x0 double, top double, size double, text string")
    assert [r.line for r in corpus.pdf_lines(df).orderBy("page", "bucket").collect()] == ["# Title", "hello world", "## Sub", "end"]
    names = spark.createDataFrame([("f", "a.md", 1), ("f", "a.md", 2), ("g", "a.md", 3), ("f", "b", 4), ("f", "b", 5)], "folder string, name string, seq int")
    assert sorted(r.unique_name for r in corpus.unique_names(names).collect()) == ["a.md", "a.md", "a_1.md", "b", "b_1"]
    (tmp_path / "x.csv").write_text('a,b\n"1 ""q""\nz",2\n,\n3,4\n')
    assert [tuple(r) for r in corpus.client_csv(spark, str(tmp_path / "x.csv")).collect()] == [('1 "q"\nz', "2"), ("3", "4")]
    entries = spark.createDataFrame([("b", False), ("A", False), ("z", True)], "name string, is_dir boolean")
    assert [r.name for r in corpus.listing(entries).collect()] == ["z", "A", "b"]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "id string, project_id string, v int, seq int")
    s.upsert(rows(("a", "p", 1, 1), ("a", "p", 2, 2), ("b", "p", 3, 1), ("c", "q", 4, 1)), "reqs")
    s.upsert(rows(("b", "p", 9, 1)), "reqs")
    have = lambda: sorted((r.id, r.project_id, r.v) for r in s.read("reqs").collect())
    assert have() == [("a", "p", 2), ("b", "p", 9), ("c", "q", 4)]
    with pytest.raises(ValueError):
        s.upsert(rows(("a", "q", 1, 1)), "reqs")
    s.delete_project("q", "reqs")
    assert have() == [("a", "p", 2), ("b", "p", 9)] and s.read("nothing") is None


def test_files_of_one_name_keep_apart_and_pdf_is_not_text(spark, tmp_path):
    for d, t in (("a", "first"), ("b c", "second")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "readme.md").write_text(t)
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 junk")
    docs = [{"doc_id": "1", "file": "a/readme.md"}, {"doc_id": "2", "file": "./b c/readme.md"}, {"doc_id": "3", "file": "x.pdf"}]
    (tmp_path / "manifest.json").write_text(json.dumps({"docs": docs}))
    assert sorted((r.doc_id, r.text) for r in corpus.documents(spark, str(tmp_path)).collect()) == [("1", "first"), ("2", "second"), ("3", None)]


def test_documents_are_replaced_by_key(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "project_id string, doc_id string, idx int, text string")
    many = [("p", f"d{i}", 0, "x") for i in range(300)]
    s.replace_docs(rows(("7", "d", 0, "a"), ("7", "d", 1, "b"), ("7", "e", 0, "c"), ("p", "d", 0, "x"), *many))
    s.replace_docs(rows(("7", "d", 0, "new")))
    have = lambda: sorted((str(r.project_id), r.doc_id, r.text) for r in s.read("chunks").collect() if str(r.project_id) == "7" or r.doc_id == "d")
    assert have() == [("7", "d", "new"), ("7", "e", "c"), ("p", "d", "x")] and s.read("chunks").count() == 303
    s.replace_docs(rows(("p", "zz", 0, "y")).limit(0), docs=rows(("7", "e", 0, "")))
    assert have() == [("7", "d", "new"), ("p", "d", "x")]
    assert len(list((tmp_path / "chunks" / "project_id=p").iterdir())) <= 64


def test_streams_keep_projects_apart_and_survive_restarts(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestar.operators import review
    from lodestar.streaming import ingest

    schema = "project_id string, doc_id string, source_type string, text string"
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "t" / "chunks"), str(tmp_path / "ck")
    put = lambda *x: spark.createDataFrame(list(x), schema).coalesce(1).write.mode("append").parquet(src)
    put(("p", "d", "note", "one\n\ntwo"), ("q", "d", "note", "three"))
    ingest.ingest_documents(spark, src, schema, out, ck)
    put(("p", "d", "note", "four"))
    ingest.ingest_documents(spark, src, schema, out, ck)
    assert sorted((r.project_id, r.text) for r in spark.read.parquet(out).collect()) == [("p", "four"), ("q", "three")]

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder, log = str(tmp_path / "state"), str(tmp_path / "log")
    spark.createDataFrame([], events.schema).coalesce(1).write.mode("append").parquet(log)
    assert ingest.fold_reviews(spark, str(tmp_path / "no*"), events.schema, str(tmp_path / "none")).count() == 0
    for k in range(4):  # every call is a restart: nothing is kept but the folder
        events.filter(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(log)
        got = ingest.fold_reviews(spark, log, events.schema, folder)
    want = review.review_log(events).groupBy("requirement_id").agg(F.max(F.struct("seq", "action")).alias("last"), F.count("*").alias("n"))
    want = {(r.requirement_id, "rejected" if r["last"].action == "reject" else "approved", r.n) for r in want.collect()}
    assert {tuple(r) for r in got.collect()} == want
