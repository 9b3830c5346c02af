"""Job status from an append-only log, admission of one running job a project, and a table of answered requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_status(log: DataFrame) -> DataFrame:
    """(project_id, state, stage, n): the last entry of each project's log (project_id, seq, state, stage); ties go to the larger state and stage."""
    last = log.groupBy("project_id").agg(F.max(F.struct("seq", "state", "stage")).alias("l"), F.count("*").alias("n"))
    return last.select("project_id", "l.state", "l.stage", "n")


def admit(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests (project_id, seq) with admitted: the first of each project that has no running job."""
    busy = job_status(log).filter("state = 'running'").select("project_id", F.lit(True).alias("busy"))
    first = requests.groupBy("project_id").agg(F.min("seq").alias("first")).join(busy, "project_id", "left")
    return requests.join(first, "project_id").select("project_id", "seq", (F.col("busy").isNull() & (F.col("seq") == F.col("first"))).alias("admitted"))


def unanswered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys of ``requests`` (key) that ``cache`` (key, answer) does not hold: what has to be asked."""
    return requests.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def answered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` with the cached answer; of several answers to a key the first by ``seq`` counts."""
    return requests.join(cache.groupBy("key").agg(F.min_by("answer", "seq").alias("answer")), "key")
