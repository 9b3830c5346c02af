"""A project's run after its analysis: the pause for review, the gate, and what is generated where it is open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import reporting, review
from lodestar.plans.stages import Stages
from lodestar.streaming import reviews


def deliver(requirements: DataFrame, events: DataFrame | None, stages: Stages) -> dict[str, DataFrame]:
    """Stages review, reviewed, gate and matrix of analyzed requirements (of ``analyze``, or like them) and review events (``reviews.EVENT``).

    With ``stages.pause`` holding "review", the run stops there (``Paused``), its earlier stages written. A later run takes up the events that
    came meanwhile, and the edits in them. Projects whose gate is shut end there: the matrix holds those that are open, and is left out if none is.
    """
    spark = requirements.sparkSession
    stages.source("analyzed", requirements)
    events = events if events is not None else spark.createDataFrame([], reviews.EVENT)
    stages.source("events", events)
    have = set(requirements.columns)
    blank = F.lit(None).cast("string")
    queue = requirements.select(F.col("id").alias("requirement_id"), *[(F.col(f) if f in have else blank).alias(f) for f in reviews.FIELDS], (F.col("status") if "status" in have else F.lit("candidate")).alias("status"))
    decisions = stages.run("review", lambda: reviews.decide(queue, events), ["analyzed", "events"])
    edited = reviews.current(queue, decisions).withColumnRenamed("requirement_id", "id").drop("decisions", "refused")
    reviewed = stages.run("reviewed", lambda: requirements.drop(*reviews.FIELDS, "status").join(edited, "id"), ["analyzed", "review"])
    gate = stages.run("gate", lambda: review.gate(reviewed), ["reviewed"])
    out = {"review": decisions, "reviewed": reviewed, "gate": gate}
    passed = gate.filter("ok").select("project_id")
    if passed.limit(1).count():
        out["matrix"] = stages.run("matrix", lambda: reporting.rtm_rows(reviewed.join(passed, "project_id", "left_semi")), ["reviewed", "gate"])
    return out
