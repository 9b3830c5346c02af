"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents that go on.

Each works on all its predecessor kept. Nulls, empty tables, repeated rows and more columns are as its operator says;
``n_chars`` is set anew where the text changes. A document without a text, or with one of no letter, has no language
and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.langid import keep_identified
from lodestar.llm.linededup import dedup_lines, drop_emptied
from lodestar.llm.mixing import FADING, curriculum, mix
from lodestar.llm.neardup import keep_one_of_each
from lodestar.llm.pieces import encode_decode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that is trusted; a null ``lang`` is filled."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less later copies of repeated line runs; a document of which nothing is left goes."""
    out = drop_emptied(dedup_lines(docs))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("ld_n_removed") > 0, size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id."""
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows dropped or repeated (three times at most) to weights 5, 2, 1 in turn, sorted by training position."""
    return curriculum(mix(docs, FADING)).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the text that they decode to."""
    return encode_decode(docs, keep_text=False)
