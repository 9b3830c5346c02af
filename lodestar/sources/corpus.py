"""Corpus sources: manifests, files with tolerant decoding, Word text, words of PDF pages, listings, table store."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import lexicons as lex
from lodestar.functions.text import human_size

MANIFEST = "domain string, project string, version string, description string, docs array<struct<doc_id:string,file:string,source_type:string>>"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, source_type) of ``folder``/manifest.json; a byte order mark is tolerated."""
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest.json", multiLine=True).select(F.explode("docs").alias("d")).select("d.*")


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^./\\]+)$", 1))


def _typed(declared: Column, file: Column, table: dict[str, str], default: str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.when(F.trim(declared) != "", declared), F.try_element_at(known, extension(file)), F.lit(default))


def ingest_type(declared: Column, file: Column) -> Column:
    return _typed(declared, file, lex.INGEST_TYPES, "unknown")


def upload_type(file: Column) -> Column:
    return _typed(F.lit(None).cast("string"), file, lex.UPLOAD_TYPES, "brd")


def decode(data: bytes) -> str:
    """UTF-8 (a byte order mark dropped), else Windows-1252, else UTF-8 with replacement marks."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


#: What ends a heading's or a paragraph's text: any block tag, opened or closed. Inline tags only are stripped.
_BLOCK_TAG = r"</?(?:h[1-6]|p|div|article|section|main|header|footer|nav|aside|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|form|fieldset|figure|blockquote|pre|hr|body|html)(?=[\s/>])"


def html_markdown(html: Column) -> Column:
    """All headings (``#`` by level) and paragraphs of a page in order, blank lines between; entities stay as they are."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)(?=[\s>]).*?</\1\s*>", " ")
    block = r"(?is)<(h[1-6]|p)(?=[\s/>])[^>]*>.*?(?=" + _BLOCK_TAG + r"|\z)"

    def line(block: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.regexp_replace(block, r"<[^>]*>", ""), r"(?U)\s+", " "))
        level = F.substring(block, 3, 1).try_cast("int")
        # a paragraph that begins with the heading's mark is escaped
        return F.when(plain == "", "").when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), plain)).otherwise(F.regexp_replace(plain, "^#", r"\\#"))

    blocks = F.filter(F.transform(F.regexp_extract_all(shown, F.lit(block), F.lit(0)), line), lambda x: x != "")
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n"))


_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes, markdown: bool = False) -> str:
    """Body blocks of a Word file in order: headings as ``#`` lines, table rows with bars, blank lines between blocks.

    With ``markdown``, tables have the outer bars and the rule under their head that format checks look for, blank rows included.
    """

    def plain(e) -> str:
        return "".join(t.text or "" for t in e.iter(f"{_NS}t")).strip()

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
    out: list[str] = []
    for block in body if body is not None else []:
        if block.tag == f"{_NS}p" and (text := plain(block)):
            style = next((e.get(f"{_NS}val", "") for e in block.iter(f"{_NS}pStyle")), "").lower().replace(" ", "")
            level = 1 if style == "title" else 2 if style == "subtitle" else 0
            if style.startswith("heading"):
                digits = re.findall(r"\d+", style)
                level = min(6, max(1, int(digits[0]))) if digits else 2
            out.append(f"{'#' * level} {text}" if level else text)
        elif block.tag == f"{_NS}tbl":
            rows = [[plain(c) for c in r.iter(f"{_NS}tc")] for r in block.iter(f"{_NS}tr")]
            if markdown and rows:
                out.append("\n".join([f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]]))
            elif kept := [" | ".join(r) for r in rows if any(r)]:
                out.append("\n".join(kept))
    return "\n\n".join(out)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, ext, size_bytes, size) of the files under a folder, without reading them."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(extension(name) == "", "—").otherwise(extension(name))
    return meta.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size_bytes"), human_size(F.col("length")).alias("size"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, source_type, text) of a corpus folder by its manifest; Word files by their XML, others as text.

    The manifest's ``file`` is a path relative to the folder. There is no reader for PDF files here, so their text is
    null, and not their bytes (see ``pdf_lines`` for words that another tool has taken out).
    """

    @F.pandas_udf(T.StringType())
    def text(content: pd.Series, ext: pd.Series) -> pd.Series:
        read = {"docx": docx_text, "pdf": lambda _: None}
        return pd.Series([read.get(e, decode)(bytes(c)) for c, e in zip(content, ext, strict=True)], dtype=object)

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    key = F.regexp_replace(F.translate("file", "\\", "/"), r"^(\./)+", "")
    listed = manifest(spark, folder).withColumn("source_type", ingest_type(F.col("source_type"), F.col("file"))).withColumn("at", key)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.expr(f"substring(path, {len(whole) + 2})").alias("at"), "content")
    return listed.join(read, "at").select("doc_id", "file", "source_type", text("content", extension(F.col("file"))).alias("text"))


def corpora(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(id, kind, doc_id, file, source_type) of every folder under ``root`` with a manifest; one that cannot be read, or lists nothing, has one row of nulls."""
    read = spark.read.schema(MANIFEST).json(f"{root}/*/manifest.json", multiLine=True)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/manifest\.json$", 1)
    rows = read.select(F.url_decode(folder).alias("id"), F.lit(kind).alias("kind"), F.explode_outer("docs").alias("d")).select("id", "kind", "d.*")
    return rows.withColumn("source_type", F.when(F.col("file").isNotNull(), ingest_type(F.col("source_type"), F.col("file"))))


def upload_manifest(files: DataFrame) -> DataFrame:
    """(domain, docs) of uploaded files (domain, name), one manifest each: the doc_id is the name without its extension, the file lies in ``docs/``.

    A manifest is one JSON object by its format, so a domain's file names are gathered; their contents are not.
    """
    name = F.regexp_extract("name", r"([^/\\\\]+)$", 1)
    doc = F.struct(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("doc_id"), F.concat(F.lit("docs/"), name).alias("file"), upload_type(name).alias("source_type"))
    return files.groupBy("domain").agg(F.sort_array(F.collect_set(doc)).alias("docs"))


def pdf_lines(words: DataFrame) -> DataFrame:
    """Lines of PDF words (doc_id, seq, page, x0, top, size, text), with headings by font size.

    The body size is the most frequent one (the first seen among equals); words whose rounded third of ``top``
    agrees are a line, from left to right; 1.3 and 1.12 times the body size make headings.
    """
    per = words.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    body = per.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    rows = words.withColumn("bucket", F.bround(F.col("top") / 3)).groupBy("doc_id", "page", "bucket").agg(F.sort_array(F.collect_list(F.struct("x0", "seq", "text"))).alias("w"), F.max("size").alias("size"))
    line = F.array_join(F.transform("w", lambda x: x["text"]), " ")
    mark = F.when(F.col("size") >= 1.3 * F.col("body"), "# ").when(F.col("size") >= 1.12 * F.col("body"), "## ").otherwise("")
    return rows.join(body, "doc_id").select("doc_id", "page", "bucket", F.concat(mark, line).alias("line"))


def client_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Quoted fields, doubled quotes, line ends in fields; blank rows are dropped."""
    reader = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true")
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out.dropna("all")


def listing(entries: DataFrame, cap: int = 2000) -> DataFrame:
    """Directory listing: folders first, then by lower-case name, at most ``cap`` (the cap is the feature)."""
    return entries.orderBy(~F.col("is_dir"), F.lower("name"), "name").limit(cap)


def unique_names(entries: DataFrame) -> DataFrame:
    """Names that repeat in a folder get ``_1``, ``_2`` ... before the extension, in order of ``seq``."""
    n = F.row_number().over(W.partitionBy("folder", "name").orderBy("seq")) - 1
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    return entries.withColumn("n", n).withColumn("unique_name", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), ext))).drop("n")
