"""Grounding: locating quotes in texts, span joins and coverage."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import lexicons as lex
from lodestar.functions import numeric as nu
from lodestar.functions.classify import expects_nothing

_PRE = str.maketrans(lex.PRE_FROM, lex.PRE_TO)
CAPTURED, PARTIAL = 0.6, 0.2


def locate(quote: str | None, text: str | None) -> tuple[int, int] | None:
    """Place of a quote: exact, else with any case, white space and typographic marks."""
    if not quote or text is None:
        return None
    at = text.find(quote)
    if at >= 0:
        return at, at + len(quote)
    parts = quote.translate(_PRE).split()
    hit = re.search(r"\s+".join(map(re.escape, parts)), text.translate(_PRE), re.IGNORECASE) if parts else None
    return hit.span() if hit else None


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(_SPAN)
def locate_span(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    found = [locate(q, t) or (None, None) for q, t in zip(quote, text, strict=True)]
    return pd.DataFrame({"start": pd.array([f[0] for f in found], dtype="Int32"), "end": pd.array([f[1] for f in found], dtype="Int32")})


def contains_join(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, doc_id, start, end, ...docs' other columns but text): verbatim finds, at their first place (see ``location``)."""
    from lodestar.operators.location import locate_join

    return locate_join(docs, quotes, tolerant=False).drop("verbatim")


#: Offsets are cut into buckets of this many characters, so that spans meet only those near them.
SPAN = 1024


def _bucket(c: Column) -> Column:
    return F.floor(c / SPAN)


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str] = ("s", "e"), right_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of rows that agree in ``on`` and whose spans share a character, each pair once.

    Spans are half open; touching ends do not overlap, and an empty span overlaps nothing. Both sides go to every bucket
    that their span touches and meet in the first one that both touch, so a text with many spans on both sides costs
    what its crowded places hold, not the product.
    """
    (ls, le), (rs, re_) = ((F.col(x) for x in pair) for pair in (left_span, right_span))
    spread = lambda df, s, e, first, b: df.filter(s < e).withColumn(first, _bucket(s)).withColumn(b, F.explode(F.sequence(_bucket(s), _bucket(e - 1))))
    a, b = spread(left, ls, le, "_fa", "_bucket"), spread(right, rs, re_, "_fb", "_bucket")
    met = a.join(b, [*on, "_bucket"]).filter((F.col("_bucket") == F.greatest("_fa", "_fb")) & (ls < re_) & (rs < le))
    return met.drop("_bucket", "_fa", "_fb")


def containing(outer: DataFrame, inner: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``outer`` (on, start, end, ...) whose span contains that of at least one row of ``inner`` (on, start, end).

    Ends may coincide, and an empty inner span lies in every outer one that reaches its place.
    """
    inner = inner.select(*on, F.col("start").alias("_s"), F.col("end").alias("_e"), _bucket(F.col("start")).alias("_bucket")).dropna().distinct()
    spans = outer.select(*on, "start", "end").distinct().filter(F.col("start") <= F.col("end"))
    spread = spans.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("start")), _bucket(F.col("end")))))
    hit = spread.join(inner, [*on, "_bucket"]).filter((F.col("start") <= F.col("_s")) & (F.col("_e") <= F.col("end")))
    return outer.join(hit.select(*on, "start", "end").distinct(), [*on, "start", "end"], "left_semi")


def best_coverage(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """(item_id, best, status): best coverage of each gold item's spans by any span of the same document."""
    each = gold.select("item_id", "doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    pairs = overlapping(each.select("doc_id", "s", "e").distinct(), spans.select("doc_id", "start", "end").distinct(), ["doc_id"])
    met = pairs.groupBy("doc_id", "s", "e").agg(F.max(nu.coverage(F.col("s"), F.col("e"), F.col("start"), F.col("end"))).alias("c"))
    best = each.join(met, ["doc_id", "s", "e"], "left").groupBy("item_id").agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("best"))
    return best.withColumn("status", F.when(F.col("best") >= CAPTURED, "captured").when(F.col("best") >= PARTIAL, "partial").otherwise("missed"))


def recall(verdicts: DataFrame, *by: str) -> DataFrame:
    """Captured count fully and partial count half, over all."""
    got = F.sum(F.when(F.col("status") == "captured", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0))
    return verdicts.groupBy(*by).agg(F.count("*").alias("n"), (got / F.count("*")).alias("recall"))


def chunk_classes(chunks: DataFrame, refs: DataFrame, open_items: DataFrame, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``chunks`` with class: covered by a reference inside it, by an open item at its place, expectedly empty, or a possible miss.

    ``on`` tells documents apart in all three; an open item is at a chunk's place if document and ``location`` agree.
    """
    keys = list(on)
    inside = containing(chunks.select(*keys, "idx", "start", "end"), refs, keys).select(*keys, "idx").distinct().withColumn("by_ref", F.lit(True))
    at = open_items.select(*keys, "location").distinct().withColumn("by_item", F.lit(True))
    out = chunks.join(inside, [*keys, "idx"], "left").join(at, [*keys, "location"], "left")
    kind = F.when(F.col("by_ref"), "covered_by_req").when(F.col("by_item"), "covered_by_openq").when(expects_nothing(F.col("text"), F.col("location")), "expected_nonrequirement").otherwise("possible_miss")
    return out.withColumn("class", kind).drop("by_ref", "by_item")


def coverage_gaps(reqs: DataFrame) -> DataFrame:
    """(project_id, aspect, statement, reason): cross-cutting aspects that no requirement of a project addresses."""
    hay = F.lower(F.concat_ws(" ", F.col("statement"), F.coalesce("nfr_category", F.lit(""))))
    hits = reqs.groupBy("project_id").agg(*[F.coalesce(F.bool_or(hay.rlike(p)), F.lit(False)).alias(f"a{i}") for i, (_, _, p) in enumerate(lex.ASPECTS)])
    every = F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(hint).alias("hint"), F.col(f"a{i}").alias("hit")) for i, (a, hint, _) in enumerate(lex.ASPECTS)])
    rows = hits.select("project_id", F.explode(F.filter(every, lambda x: ~x["hit"])).alias("x"))
    return rows.select("project_id", "x.aspect", F.concat(F.lit("No requirements address "), "x.aspect", F.lit(".")).alias("statement"), F.format_string(lex.GAP_REASON, "x.hint").alias("reason"))


def coverage_counts(classes: DataFrame) -> DataFrame:
    n = {k: F.count_if(F.col("class") == k).alias(k) for k in ("covered_by_req", "covered_by_openq", "expected_nonrequirement", "possible_miss")}
    out = classes.agg(F.count("*").alias("total"), *n.values())
    return out.withColumn("accounted_pct", F.coalesce(F.try_divide(100.0 * (F.col("total") - F.col("possible_miss")), F.col("total")), F.lit(100.0)))
