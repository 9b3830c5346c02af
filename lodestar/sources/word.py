"""Word documents as a sink: lines of a Markdown document become the paragraphs and tables of an OOXML part, natively.

A document's lines come from ``document.structure``. Each line is rendered to XML on its own by column functions; a table opens at its head
and closes after its last row. Parts are rows, and a Word file is a zip archive of them (``archive.write_zips``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.document import structure

# Fixed values of the OOXML format
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml"
SIZES = {1: 32, 2: 26, 3: 24, 4: 22, 5: 22, 6: 22}


def _style(sid: str, name: str, size: int, bold: bool) -> str:
    level = f'<w:pPr><w:outlineLvl w:val="{int(sid[-1]) - 1}"/></w:pPr>' if sid.startswith("Heading") else ""
    return f'<w:style w:type="paragraph" w:styleId="{sid}"><w:name w:val="{name}"/>{level}<w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{size}"/></w:rPr></w:style>'


STATIC = {
    "[Content_Types].xml": f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/word/document.xml" ContentType="{_MAIN}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{_MAIN}.styles+xml"/></Types>',
    "_rels/.rels": f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "word/styles.xml": f"{_XML}<w:styles {_W}>" + _style("Normal", "Normal", 22, False) + _style("Title", "Title", 56, True) + _style("Subtitle", "Subtitle", 28, False) + _style("ListBullet", "List Bullet", 22, False)
    + "".join(_style(f"Heading{k}", f"heading {k}", s, True) for k, s in SIZES.items()) + "</w:styles>",
}
TOC = '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText xml:space="preserve"> TOC \\o "1-3" \\h \\z \\u </w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
BREAK = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'


def escaped(c: Column) -> Column:
    """Text for XML: marks as entities; control characters, which XML cannot hold, as blanks."""
    plain = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", " ")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def runs(text: Column) -> Column:
    """Runs of a line, bold between pairs of ``**``; a mark without a partner stays."""
    parts = F.split(text, r"\*\*", -1)
    n = F.size(parts)
    # with an even number of pieces the last mark has no partner
    parts = F.when(n % 2 == 0, F.concat(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), F.array(F.concat_ws("**", F.element_at(parts, F.greatest(n - 1, F.lit(1))), F.element_at(parts, n))))).otherwise(parts)
    run = lambda t, i: F.when(t == "", "").otherwise(F.concat(F.lit("<w:r>"), F.when(i % 2 == 1, "<w:rPr><w:b/></w:rPr>").otherwise(""), F.lit('<w:t xml:space="preserve">'), escaped(t), F.lit("</w:t></w:r>")))
    return F.array_join(F.transform(parts, run), "")


def _paragraph(style: Column | str, text: Column) -> Column:
    named = F.lit(style) if isinstance(style, str) else style
    return F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), named, F.lit('"/></w:pPr>'), runs(text), F.lit("</w:p>"))


def body(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, xml) of the lines of Markdown documents (doc_id, text) that show."""
    lines = structure(docs)
    bare = F.trim("line")
    level = F.length(F.regexp_extract("line", r"^(#{1,6})", 1))
    title = F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1))
    cell = lambda bold: lambda x: F.concat(F.lit("<w:tc><w:tcPr/><w:p>"), runs(F.concat(F.lit("**"), x, F.lit("**"))) if bold else runs(x), F.lit("</w:p></w:tc>"))
    row = F.concat(F.lit("<w:tr>"), F.when(F.col("kind") == "table_head", F.array_join(F.transform("cells", cell(True)), "")).otherwise(F.array_join(F.transform("cells", cell(False)), "")), F.lit("</w:tr>"))
    ends = F.coalesce(F.lead("table").over(W.partitionBy("doc_id").orderBy("line_no")), F.lit(-1)) != F.col("table")
    close = F.when(ends, F.lit("</w:tbl>" + "<w:p/>")).otherwise("")
    begin = F.lit('<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/><w:tblW w:w="0" w:type="auto"/></w:tblPr>')
    xml = (
        F.when(F.col("kind") == "heading", _paragraph(F.concat(F.lit("Heading"), level.cast("string")), title))
        .when(F.col("kind") == "table_head", F.concat(begin, row, close)).when(F.col("kind") == "table_row", F.concat(row, close)).when(F.col("kind") == "table_rule", close)
        .when(bare.rlike(r"^[-*]\s+"), _paragraph("ListBullet", F.regexp_replace(bare, r"^[-*]\s+", ""))).when(F.col("kind") == "text", _paragraph("Normal", bare))
    )
    return lines.select("doc_id", "line_no", xml.alias("xml")).filter("xml is not null")


def parts(docs: DataFrame) -> DataFrame:
    """Members (archive, name, content) of one Word file a document (doc_id, title, subtitle, text): a title page, a table of contents, the text."""
    inner = body(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "xml"))), lambda x: x["xml"]), "").alias("body"))
    front = F.concat(_paragraph("Title", F.coalesce("title", F.lit(""))), _paragraph("Subtitle", F.coalesce("subtitle", F.lit(""))), F.lit(BREAK + TOC + BREAK))
    whole = F.concat(F.lit(f"{_XML}<w:document {_W}><w:body>"), front, F.coalesce("body", F.lit("")), F.lit("<w:sectPr/></w:body></w:document>"))
    made = docs.join(inner, "doc_id", "left").select(F.concat("doc_id", F.lit(".docx")).alias("archive"), whole.alias("xml"))
    fixed = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("content")) for n, t in STATIC.items()]
    every = F.explode(F.array(*fixed, F.struct(F.lit("word/document.xml").alias("name"), F.col("xml").alias("content"))))
    return made.select("archive", every.alias("m")).select("archive", "m.name", F.encode("m.content", "UTF-8").alias("content"))
