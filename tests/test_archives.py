"""Zip and Word sinks, read back by other readers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from lodestar.operators import document
from lodestar.sources import archive, corpus, word


def members():
    return [("a.zip", f"dir/é{i}.txt", bytes([i % 251]) * (i * 97)) for i in range(60)] + [("b.zip", "only", None), ("b.zip", "empty", b"")]


def test_archives_open_and_reruns_are_equal(spark, tmp_path):
    df = spark.createDataFrame(members(), "archive string, name string, content binary")
    first = None
    for k in (5, 2):
        archive.write_zips(df.repartition(k), f"{tmp_path}/out")
        seen = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
        assert set(seen) == {"a.zip", "b.zip"}
        for name, data in seen.items():
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: c or b"" for a, n, c in members() if a == name}
        first = first or seen
        assert seen == first


def test_64_bit_records():
    class Row:
        name, crc, size, packed, offset = "x", 7, 5 << 30, 6 << 30, 9 << 30

    head = archive._local(Row, b"x")
    assert len(head) == archive.HEADER + 1 + 20 and head[archive.HEADER + 1 :][4:12] == (5 << 30).to_bytes(8, "little")
    entry = archive._central(Row, b"x")
    assert entry[-24:-16] == (5 << 30).to_bytes(8, "little") and entry[-8:] == (9 << 30).to_bytes(8, "little")
    assert archive._end(70_000, 10, 20).startswith(archive.END64) and archive._end(3, 10, 20).startswith(archive.END)


def test_a_failed_write_leaves_nothing_under_a_final_name(spark, tmp_path):
    spark.dataSource.register(archive.ZipArchives)
    rows = spark.createDataFrame([("a.zip", "x", 0, 0, 0, 0, b""), ("a.zip", "y", 0, 0, 0, 5, b"")], archive.ROW).coalesce(1)
    with pytest.raises(Exception, match="should lie at 5"):
        rows.write.format("zip_archives").option("path", f"{tmp_path}/out").mode("append").save()
    assert not (tmp_path / "out" / "a.zip").exists()


def test_word_files_hold_the_document(spark, tmp_path):
    md = "# 1. Scope & <aim>\n\nPlain **bold** and **both** ends ** here\n- item *one*\n\n| Term | Note |\n|---|---|\n| a | **b** |\n| c | d & e |\nafter\n\n| Last | X |\n|---|---|\n"
    docs = spark.createDataFrame([("d", "Title", "for p", md), ("e", None, None, "")], "doc_id string, title string, subtitle string, text string")
    archive.write_zips(word.parts(docs), f"{tmp_path}/out")
    data = (tmp_path / "out" / "d.docx").read_bytes()
    text = corpus.docx_text(data)
    assert text == "# Title\n\n## for p\n\n# 1. Scope & <aim>\n\nPlain bold and both ends ** here\n\nitem *one*\n\nTerm | Note\na | b\nc | d & e\n\nafter\n\nLast | X"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode()
        assert 'TOC \\o "1-3"' in xml and xml.count("<w:tbl>") == xml.count("</w:tbl>") == 2 and xml.count("<w:b/>") == 7
        assert set(z.namelist()) == {*word.STATIC, "word/document.xml"}
    assert corpus.docx_text((tmp_path / "out" / "e.docx").read_bytes()) == ""


def test_specifications_keep_sections_and_rows_in_word(spark, tmp_path):
    md = "## 1. Introduction\n### 1.1 Purpose\nText.\n\n## 2. Overall Description\n### 2.3 User Classes and Characteristics\n| User Class | Description |\n|---|---|\n| a | b |\n\n- **REQ-1:** It shall work.\n- **NFR-2:** Fast.\n\n## Appendix A: Glossary\n| Term | Definition |\n|---|---|\n| t | d |\n\n## Appendix B: Analysis Models\nThe principal entities (a) are here\n"
    docs = spark.createDataFrame([("p-1", md), ("p-2", md.replace("REQ-1", "XYZ-1"))], "doc_id string, text string")
    archive.write_zips(word.parts(docs.withColumn("title", F.lit("Specification")).withColumn("subtitle", F.col("doc_id"))), f"{tmp_path}/out")
    lines = document.structure(docs).collect()
    for doc in {r.doc_id for r in lines}:
        text = corpus.docx_text((tmp_path / "out" / f"{doc}.docx").read_bytes())
        want = [r for r in lines if r.doc_id == doc]
        assert [x for x in text.split("\n") if x.startswith("#")][2:] == [r.line.strip().replace("**", "") for r in want if r.kind == "heading"]
        assert sum(" | " in x for x in text.split("\n")) >= sum(r.kind in ("table_head", "table_row") and any(r.cells) for r in want)
    # the format checks give the same on the Word form, with a section renamed as well
    text = {r.doc_id: r.text for r in docs.collect()}
    cut = spark.createDataFrame([(d, "t", "s", t.replace("## 2. Overall Description", "## 2. Other")) for d, t in text.items()], "doc_id string, title string, subtitle string, text string")
    archive.write_zips(word.parts(cut), f"{tmp_path}/cut")
    forms = [(f"plain {d}", t) for d, t in text.items()] + [(f"cut {d}", r.text) for r in cut.collect() for d in [r.doc_id]]
    forms += [(f"{k} word {d}", corpus.docx_text((tmp_path / place / f"{d}.docx").read_bytes(), markdown=True)) for k, place in (("plain", "out"), ("cut", "cut")) for d in text]
    broken = {}
    for r in document.violations(spark.createDataFrame(forms, "doc_id string, text string")).collect():
        broken.setdefault(r.doc_id, []).append((r.rule, r.detail))
    for d in text:
        for k in ("plain", "cut"):
            assert sorted(broken.get(f"{k} {d}", [])) == sorted(broken.get(f"{k} word {d}", []))
        assert any("2" in x for _, x in broken[f"cut {d}"])
