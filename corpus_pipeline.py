"""A corpus pipeline of five stages, each one operator over all that its predecessor kept (``lodestar.llm.stages``).

language_id   documents without a language, or with a score at which held-out labels are mostly wrong, go; a null
              language is filled in
line_dedup    later copies of repeated line runs are deleted; a document of which nothing is left goes
near_dup      of every group of near duplicates the document with the smallest doc_id stays
mix           sources are mixed to weights 5, 2, 1 in turn, changing over training: rows are dropped or repeated (at most
              three times their number) and sorted by training position
pieces        texts are encoded to piece ids and decoded back

Each stage's rows are written as Parquet to the shared folder and read again by the next, so a lost executor
never costs more than the running stage; a stage's rows are dropped as soon as the next one's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.stages import language_id, line_dedup, mix_sources, near_dup, to_pieces
from lodestar.runtime import Scratch

STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dup", near_dup), ("mix", mix_sources), ("pieces", to_pieces)]

#: SQL can express neither the trained language model nor the MinHash forest and the piece encoder; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
