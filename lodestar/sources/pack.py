"""The handoff pack: specification, traceability matrix and manifest of every project whose gate is open."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.operators import reporting, review


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Settings ``base`` with those of ``over`` on top; maps on both sides are merged in turn, anything else is replaced."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return base | both


def refusals(reqs: DataFrame, sources: str = "doc_id") -> DataFrame:
    """(project_id, reason) of projects that may not be handed over: the gate is shut, or an approved row has no source."""
    shut = review.gate(reqs).filter("not ok").select("project_id", "reason")
    bare = reporting.approved(reqs).filter(F.coalesce(F.trim(F.col(sources)), F.lit("")) == "").groupBy("project_id").agg(F.count("*").alias("n"))
    reason = F.concat(F.col("n").cast("string"), F.lit(" approved requirement(s) without a source"))
    return shut.unionByName(bare.join(shut, "project_id", "left_anti").select("project_id", reason.alias("reason")))


def manifest(reqs: DataFrame, delivered: DataFrame, open_numbered: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """One row a project that may be handed over: counts by kind of id, matrix rows, open items and broken format checks (null: not checked)."""
    ids = reporting.srs_ids(reqs).groupBy("project_id").agg(F.count("*").alias("approved"), *[F.count_if(F.col("srs_id").startswith(f"{p}-")).alias(name) for p, name in (("REQ", "functional"), ("NFR", "non_functional"), ("BR", "business"))])
    out = ids.join(refusals(reqs), "project_id", "left_anti")
    for rows, name in ((delivered, "matrix_rows"), (open_numbered, "open_items")):
        out = out.join(rows.groupBy("project_id").agg(F.count("*").alias(name)), "project_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if violations is None:
        return out.withColumn("violations", F.lit(None).cast("long"))
    return out.join(violations.select("project_id", "violations"), "project_id", "left")


def write_pack(folder: str, reqs: DataFrame, documents: DataFrame, delivered: DataFrame, about: DataFrame) -> DataFrame:
    """Write ``srs`` (text), ``rtm`` (CSV) and ``manifest`` (JSON) under ``folder``, a directory for each project; gives the refusals.

    ``documents`` is (project_id, text), ``delivered`` of ``reporting.rtm_delivered``, ``about`` of ``manifest``. What
    an earlier pack left there goes. A project's matrix is one sorted file, as it is delivered; refused projects get nothing.
    """
    refused = refusals(reqs)
    good = lambda df: df.join(refused, "project_id", "left_anti")
    good(documents).select("project_id", "text").write.mode("overwrite").partitionBy("project_id").option("lineSep", "\n").text(f"{folder}/srs")
    rows = good(delivered).repartition("project_id").sortWithinPartitions("project_id", "part", "pos")
    rows.select("project_id", *lex.RTM_CSV_HEADER).write.mode("overwrite").partitionBy("project_id").option("header", "true").option("escape", '"').option("emptyValue", "").csv(f"{folder}/rtm")
    good(about).withColumn("pid", F.col("project_id")).write.mode("overwrite").partitionBy("project_id").json(f"{folder}/manifest")
    return refused
