"""Locating many quotes in many texts, tolerant of case, white space and typographic marks.

Every text is scanned once for all quotes by an Aho-Corasick automaton over their *search form*: marks made plain, cases made one, each run of
white space a single blank. The form keeps one character for each character outside white space, so a map of the runs turns a place in it
back into a place of the text. An automaton's find is checked by the exact pattern at that very place, because cases are folded a
little wider than a case-blind search does. The place of a pair is the one ``grounding.locate`` gives: the first verbatim find if there is one, else the first tolerant one.

Quotes collapse to distinct ones first and are dealt into ranges of up to ``RANGE_BYTES`` by size, an automaton each; a range's list is the only thing that is
broadcast, so memory is bounded however many quotes there are, and the texts are scanned once a range. Texts are never shuffled.

Defined cases: null and empty quotes and null texts are found nowhere; a quote of white space alone is found verbatim only; equal
quotes each get their rows; overlapping quotes do not hinder each other.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import lexicons as lex
from lodestar.functions import text as tx
from lodestar.operators.grounding import locate
from lodestar.operators.ranking import numbered
from lodestar.runtime import Scratch, bound_arrow, small

RANGE_BYTES = 4 << 20
_PRE = str.maketrans(lex.PRE_FROM, lex.PRE_TO)
_BLANKS = re.compile(r"\s+")


class _Fold(dict):
    """Character table: plain marks, and one character for all that a case-blind search takes as equal (or more)."""

    def __missing__(self, code: int) -> str:
        c = chr(code).translate(_PRE)
        # through lower case, upper case and back: cases with several lower forms (Greek sigma, long s, dotless i) become one
        self[code] = c.lower()[0].upper()[0].lower()[0]
        return self[code]


_FOLD = _Fold()


def search_form(text: str) -> str:
    return _BLANKS.sub(" ", text).translate(_FOLD)


class Places:
    """From places in a text's search form to places in the text."""

    def __init__(self, text: str) -> None:
        self.at, self.gained, gained = [], [], 0
        for m in _BLANKS.finditer(text):
            if m.end() - m.start() > 1:
                self.at.append(m.start() - gained + 1)  # where the form goes on after the run
                gained += m.end() - m.start() - 1
                self.gained.append(gained)

    def of(self, place: int) -> int:
        k = bisect_right(self.at, place)
        return place + (self.gained[k - 1] if k else 0)


class Verbatim:
    """An automaton over distinct quotes (key, quote) as they are."""

    def __init__(self, quotes: list[tuple[int, str]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, q in quotes:
            self.automaton.add_word(q, (k, len(q)))
        if quotes:
            self.automaton.make_automaton()
        self.empty = not quotes

    def find(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(key, start, end, True) of the first find of every quote that the text holds."""
        first: dict[int, tuple[int, int]] = {}
        for end, (k, n) in self.automaton.iter(text) if not self.empty else ():
            first.setdefault(k, (end + 1 - n, end + 1))
        return [(k, s, e, True) for k, (s, e) in first.items()]


class Finder:
    """An automaton over the search forms of distinct quotes (key, quote)."""

    def __init__(self, quotes: list[tuple[int, str]]) -> None:
        self.forms: dict[str, list[tuple[int, str]]] = {}
        self.blank = [(k, q) for k, q in quotes if not q.strip()]
        for k, q in quotes:
            if q.strip():
                self.forms.setdefault(search_form(q.strip()), []).append((k, q))
        self.automaton = ahocorasick.Automaton()
        for form in self.forms:
            self.automaton.add_word(form, form)
        if self.forms:
            self.automaton.make_automaton()
        self.patterns: dict[str, re.Pattern] = {}

    def find(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(key, start, end, verbatim) of every quote that the text holds, at its place by ``locate``."""
        out = [(k, at, at + len(q), True) for k, q in self.blank if (at := text.find(q)) >= 0]
        if not self.forms:
            return out
        hits: dict[str, list[int]] = {}
        for end, form in self.automaton.iter(search_form(text)):
            hits.setdefault(form, []).append(end - len(form) + 1)
        if not hits:
            return out
        places, plain = Places(text), text.translate(_PRE)
        for form, starts in hits.items():
            for key, quote in self.forms[form]:
                at = text.find(quote)
                if at >= 0:
                    out.append((key, at, at + len(quote), True))
                    continue
                span = next((m.span() for s in starts if (m := self._pattern(quote).match(plain, places.of(s)))), None)
                if span:
                    out.append((key, *span, False))
        return out

    def _pattern(self, quote: str) -> re.Pattern:
        found = self.patterns.get(quote)
        if found is None:
            if len(self.patterns) > 4096:
                self.patterns.clear()
            found = self.patterns[quote] = re.compile(r"\s+".join(map(re.escape, quote.translate(_PRE).split())), re.IGNORECASE)
        return found


def _ranges(quotes: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Distinct quotes (key, quote, range): ranges hold up to ``RANGE_BYTES`` of them, or one long quote."""
    distinct = quotes.filter("text <> ''").groupBy(F.col("text").alias("quote")).agg(F.count("*").alias("copies"))
    placed = scratch.write(numbered(distinct.withColumn("all", F.lit(0)), "all", ["quote"], "key").drop("all"), "distinct")
    total = placed.agg(F.coalesce(F.sum(F.octet_length("quote") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // RANGE_BYTES))
    return scratch.write(placed.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(n))), "quotes"), n


def locate_join(docs: DataFrame, quotes: DataFrame, tolerant: bool = True) -> DataFrame:
    """(item_id, doc_id, start, end, verbatim, and the other columns of ``docs`` but text) of every quote (item_id, text) and document that holds it.

    Unless ``tolerant``, verbatim finds count alone, and texts are searched as they are.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    scratch = Scratch(spark, "locate")
    held, n = _ranges(quotes, scratch)
    rest = [c for c in docs.columns if c not in ("text", "start", "end", "verbatim", "key")]
    slim = docs.select(*rest, "text").filter("text <> ''")
    schema = T.StructType([*slim.drop("text").schema, T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("verbatim", T.BooleanType())])
    out = None
    for k in range(n):
        listed = spark.sparkContext.broadcast([(r.key, r.quote) for r in held.filter(F.col("range") == k).collect()])  # at most about RANGE_BYTES

        def run(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:
            finder = Finder(listed.value) if tolerant else Verbatim(listed.value)
            for batch in batches:
                found = [(i, *hit) for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()) for hit in finder.find(text)]
                if found:
                    row, key, start, end, verbatim = (list(x) for x in zip(*found, strict=True))
                    same = batch.take(pa.array(row)).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(verbatim)], names=schema.names)

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    found = scratch.write(out, "found")  # so that texts are scanned once, whatever the rest of the plan does
    named = quotes.select("item_id", F.col("text").alias("quote")).join(small(held.select("key", "quote"), held.count(), RANGE_BYTES // 1024), "quote").select("item_id", "key")
    return found.join(small(named, quotes.count(), 64), "key").drop("key")


def valid_spans(found: DataFrame, docs: DataFrame, on: list[str]) -> DataFrame:
    """(on, quote_no, slice, start, end): of located quotes (on, quote_no, start, end) the substantive spans, in the source's own words, each once by (start, end).

    The first quote of a document that lies at a span stands for it.
    """
    first = found.groupBy(*on, "start", "end").agg(F.min("quote_no").alias("quote_no"))
    cut = first.join(docs.select(*on, "text"), on).withColumn("slice", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return cut.filter(tx.is_substantive(F.col("slice"))).select(*on, "quote_no", "slice", "start", "end")


def valid_span_list(quotes: list[str], text: str) -> list[tuple[str, int, int]]:
    """The same of one text's quotes, as a list of (slice, start, end) in the order of the quotes."""
    out: dict[tuple[int, int], str] = {}
    for q in quotes:
        span = locate(q, text)
        if span and span not in out and len(text[slice(*span)]) >= 12 and len(text[slice(*span)].split()) >= 3:
            out[span] = text[slice(*span)]
    return [(s, *span) for span, s in out.items()]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("slice", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def spans_of(quotes, text):
    """``valid_span_list`` as a column function over an array of quotes and a text."""
    import pandas as pd

    return pd.Series([[] if t is None or q is None else [dict(zip(("slice", "start", "end"), x, strict=True)) for x in valid_span_list(list(q), t)] for q, t in zip(quotes, text, strict=True)])
