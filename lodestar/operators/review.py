"""Review state: gate, decision log, calibration, sampling, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.operators.ranking import numbered


def gate(reqs: DataFrame) -> DataFrame:
    """(project_id, ok, reason): ready if something is approved and nothing is pending."""
    n = reqs.groupBy("project_id").agg(F.count_if(F.col("status").isin(*lex.PENDING)).alias("p"), F.count_if(F.col("status") == "approved").alias("a"))
    count = lambda c, t: F.concat(F.col(c).cast("string"), F.lit(t))
    reason = (
        F.when(F.col("p") > 0, count("p", lex.GATE_PENDING))
        .when(F.col("a") == 0, F.lit(lex.GATE_NOTHING)).otherwise(count("a", lex.GATE_READY))
    )
    return n.select("project_id", ((F.col("p") == 0) & (F.col("a") > 0)).alias("ok"), reason.alias("reason"))


def review_log(events: DataFrame) -> DataFrame:
    """The event stream read as a decision log: (seq, requirement_id, action, actor, ts)."""
    action = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "click", "edit")
    actor = F.when(F.col("value") < 10, "auto-approve").otherwise("reviewer")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("requirement_id"), action.alias("action"), actor.alias("actor"), "ts").filter("action is not null")


def fold_status(log: DataFrame) -> DataFrame:
    """Status after all decisions: the last one counts; accept and edit approve, reject rejects."""
    last = log.groupBy("requirement_id").agg(F.max_by("action", "seq").alias("action"), F.count("*").alias("n"))
    return last.select("requirement_id", F.when(F.col("action") == "reject", "rejected").otherwise("approved").alias("status"), "n")


def decision_rates(log: DataFrame) -> DataFrame:
    n = log.agg(*[F.count_if(F.col("action") == a).alias(f"{a}s") for a in ("accept", "edit", "reject")])
    total = F.col("accepts") + F.col("edits") + F.col("rejects")
    return n.select("*", total.alias("decisions"), *[F.try_divide(F.col(f"{a}s"), total).alias(f"{a}_rate") for a in ("accept", "edit", "reject")])


def band(confidence: Column) -> Column:
    out = None
    for name, low, high in lex.BANDS:
        test = (confidence >= low) & (confidence < high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def calibration(reqs: DataFrame, log: DataFrame) -> DataFrame:
    """Acceptance of the last human decision by project and confidence band, zero-filled for every project of ``reqs``."""
    last = log.filter("actor <> 'auto-approve'").groupBy("requirement_id").agg(F.max_by("action", "seq").alias("action"))
    seen = reqs.join(last, "requirement_id").groupBy("project_id", band(F.col("confidence")).alias("band")).agg(F.count_if(F.col("action") == "accept").alias("accepted"), F.count("*").alias("decided"))
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).cast("double").alias("low")) for n, lo, _ in lex.BANDS])
    every = reqs.select("project_id").distinct().select("project_id", F.inline(bands))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(seen, ["project_id", "band"], "left").select("project_id", "band", "low", zero("accepted"), zero("decided")).withColumn("rate", F.try_divide("accepted", "decided"))


def suggested_bar(bands: DataFrame) -> DataFrame:
    """Lowest edge of a project's bands that are reliable, else the default."""
    good = (F.col("decided") >= lex.BAR_LEAST) & (F.col("accepted") / F.col("decided") >= lex.BAR_RATE)
    return bands.groupBy("project_id").agg(F.coalesce(F.min(F.when(good, F.col("low"))), F.lit(lex.BAR_DEFAULT)).alias("bar"))


def spot_check(ids: DataFrame, rate: float) -> DataFrame:
    """Every k-th id of a project (project_id, id) in order, k = max(1, round(1 / rate)) with Python's rounding."""
    step = max(1, round(1 / rate)) if rate and rate > 0 else 1
    return numbered(ids.select("project_id", "id"), "project_id", ["id"]).filter((F.col("n") - 1) % step == 0).drop("n")


def latest(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row per key: what a keyed upsert of the log leaves."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, *[f"x.{c}" for c in rest])


def validated(log: DataFrame, reqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log rows for known requirements and actions, and the others (quarantine)."""
    marked = log.join(reqs.select("requirement_id").distinct().withColumn("known", F.lit(True)), "requirement_id", "left")
    good = F.coalesce(F.col("known"), F.lit(False)) & F.col("action").isin("accept", "edit", "reject")
    return marked.filter(good).drop("known"), marked.filter(~good).drop("known")
