"""Chunkers: documents (doc_id, source_type, text) to chunks with exact character offsets.

Every chunk is a verbatim slice: text = substring(document, start + 1, end - start), offsets in code points.
Lines end as Python's ``splitlines`` has them. All are window queries by document, but for the scan of JSON texts.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar import lexicons as lex

#: A place after a line's end: CR LF counts as one end.
LINE_END = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0B\f\x1c\x1d\x1e\u0085\u2028\u2029])"
LEVELS = 16
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start, end): lines with their ends; none for an empty or null text."""
    cut = docs.select("doc_id", F.posexplode(F.filter(F.split("text", LINE_END, -1), lambda x: F.length(x) > 0)).alias("line_no", "line"))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length("line")).over(w)
    return cut.withColumn("end", end).withColumn("start", F.col("end") - F.length("line")).select("doc_id", "line_no", "line", "start", "end")


def _blank(c: Column) -> Column:
    return c.rlike(BLANK)


def _sliced(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, source_type, idx, location, text, start, end) of spans (doc_id, location, start, end)."""
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("start")) - 1
    out = spans.withColumn("idx", idx).join(docs.select("doc_id", "source_type", "text"), "doc_id")
    return out.select("doc_id", "source_type", "idx", "location", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "start", "end")


def paragraph_spans(docs: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines(docs).withColumn("block", F.sum(_blank(F.col("line")).cast("int")).over(w)).filter(~_blank(F.col("line")))
    return marked.groupBy("doc_id", "block").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", F.lit("(para)").alias("location"), "start", "end")


def markdown_spans(docs: DataFrame) -> DataFrame:
    """Headings and paragraph blocks; the location is the trail of headings above.

    A line carries the last heading of each level; one is in the trail if none of a higher level came after it. Levels
    beyond ``LEVELS`` count as that one.
    """
    stripped = F.regexp_replace("line", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    rows = lines(docs).withColumn("s", stripped).withColumn("head", F.col("s").startswith("#"))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    level = F.length("s") - F.length(F.regexp_replace("s", "^#+", ""))
    title = F.regexp_replace(F.regexp_replace("s", "^#+", ""), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    at = lambda k: F.last(F.when(F.col("head") & (F.least(level, F.lit(LEVELS)) == k), F.struct("line_no", title.alias("title"))), ignorenulls=True).over(w)
    rows = rows.withColumn("heads", F.array(*[at(k) for k in range(1, LEVELS + 1)]))
    above = lambda i: F.slice("heads", F.lit(1), i)
    trail = F.filter("heads", lambda x, i: x.isNotNull() & ~F.exists(above(i), lambda y: F.coalesce(y["line_no"] > x["line_no"], F.lit(False))))
    joined = F.array_join(F.transform(trail, lambda x: x["title"]), " › ")
    place = F.when(joined == "", "(top)").otherwise(joined)
    # a heading is a block of its own; blank lines and headings end blocks
    rows = rows.withColumn("location", place).withColumn("block", F.sum(((F.col("s") == "") | F.col("head")).cast("int")).over(w))
    kept = rows.filter(F.col("s") != "").groupBy("doc_id", "block", "head", "location")
    return kept.agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "location", "start", "end")


def transcript_spans(docs: DataFrame) -> DataFrame:
    """Speaker turns; what stands before the first cue is the intro."""
    name = F.regexp_extract("line", lex.SPEAKER, 1)
    rows = lines(docs).withColumn("name", name).withColumn("cue", (F.col("name") != "") & ~F.lower("name").isin(*lex.NON_SPEAKER))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("turn", F.sum(F.col("cue").cast("int")).over(w))
    begin = F.min(F.when((F.col("turn") > 0) | ~_blank(F.col("line")), F.col("start")))
    turns = rows.groupBy("doc_id", "turn").agg(begin.alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("cue"), F.col("name"))).alias("speaker"))
    return turns.filter("start is not null").select("doc_id", F.coalesce("speaker", F.lit("(intro)")).alias("location"), "start", "end")


def csv_spans(docs: DataFrame) -> DataFrame:
    """One span per physical line after the header; the location is the first field."""
    rows = lines(docs).filter(~_blank(F.col("line")))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no"))).filter("n > 1")
    field = F.from_csv(F.regexp_replace("line", r"[\r\n]+$", ""), F.lit("f string"))["f"]
    return rows.select("doc_id", F.coalesce(F.trim(field), F.lit("")).alias("location"), "start", "end")


_STRING = re.compile(r'"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)', re.S)


def object_spans(raw: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost {...}, aware of strings: a running sum of braces outside strings."""
    code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    step = (code == ord("{")).astype(np.int32) - (code == ord("}"))
    for m in _STRING.finditer(raw):
        step[m.start() : m.end()] = 0
    depth = np.cumsum(step)
    # where the depth leaves 0 by an opening brace and comes back to it by a closing one: these alternate
    opens, closes = np.flatnonzero((step == 1) & (depth == 1)), np.flatnonzero((step == -1) & (depth == 0))
    return list(zip(opens.tolist(), (closes + 1).tolist()))  # noqa: B905  the last object may be open


@F.udtf(returnType="start int, end int")
class ObjectSpans:
    """Rows of ``object_spans``."""

    def eval(self, text: str):
        yield from object_spans(text or "")


def picked(item: Column, *keys: str) -> Column:
    """The first of these keys of a JSON object whose value says something (not null, false, 0 or empty), as text; else the empty string.

    The object is parsed once, as a VARIANT; text that is no object picks nothing.
    """
    v = F.try_parse_json(item)
    values = [F.try_variant_get(v, f"$.{k}", "string") for k in keys]
    said = [F.when(~x.isin("", "0", "0.0", "false", "[]", "{}", "null"), F.when(x == "true", "True").otherwise(x)) for x in values]
    return F.coalesce(*said, F.lit(""))


def json_spans(docs: DataFrame) -> DataFrame:
    """The outermost objects of a JSON text; the location is the object's key or id."""
    found = docs.lateralJoin(ObjectSpans(F.col("text").outer()))
    item = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select("doc_id", picked(item, "key", "id").alias("location"), "start", "end")


CHUNKERS = {"brd": markdown_spans, "email": markdown_spans, "legacy": markdown_spans, "transcript": transcript_spans, "form": csv_spans, "jira": json_spans}


def chunk(docs: DataFrame) -> DataFrame:
    """Chunks of documents by their source type; unknown types are cut into paragraphs."""
    docs = docs.select("doc_id", "source_type", "text")
    parts = []
    for spans in dict.fromkeys([*CHUNKERS.values(), paragraph_spans]):
        types = [t for t, f in CHUNKERS.items() if f is spans]
        mine = docs.filter(F.col("source_type").isin(*types)) if types else docs.filter(~F.coalesce(F.col("source_type").isin(*CHUNKERS), F.lit(False)))
        parts.append(_sliced(spans(mine).select("doc_id", "location", F.col("start").cast("long"), F.col("end").cast("long")), mine))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
