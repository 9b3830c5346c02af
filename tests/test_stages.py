"""Stages recompute exactly what depends on a change; a run pauses before review and goes on with edits."""

import pytest
from pyspark.sql import functions as F

from lodestar.plans.run import deliver
from lodestar.plans.stages import Paused, Stages, fingerprint
from lodestar.sources.store import Store
from lodestar.streaming import reviews


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None)], "i int, s string, m map<string,int>")
    same = spark.createDataFrame([("a", {"k": 1}, 1), (None, None, 2)], "s string, m map<string,int>, i int")
    assert fingerprint(df) == fingerprint(same.repartition(3)) and fingerprint(None) == "none"
    others = [df.limit(1), df.union(df), df.withColumn("s", F.lit("b")), df.withColumn("i", F.col("i").cast("long")), df.drop("m"), df.limit(0)]
    assert len({fingerprint(x) for x in [df, *others]}) == 7


def chain(store, a, b, pause=(), settings=None):
    stages = Stages(store, settings or {}, set(pause))
    stages.source("a", a)
    stages.source("b", b)
    evens = stages.run("evens", lambda: a.filter("x % 2 = 0"), ["a"])
    doubled = stages.run("doubled", lambda: b.selectExpr("x * 2 AS x"), ["b"])
    both = stages.run("both", lambda: evens.union(doubled), ["evens", "doubled"])
    return stages, sorted(r.x for r in stages.run("last", lambda: both.distinct(), ["both"]).collect())


def test_only_what_depends_on_a_change_is_computed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    nums = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    first, out = chain(store, nums(1, 2, 4), nums(5))
    assert first.done == ["evens", "doubled", "both", "last"] and out == [2, 4, 10]
    assert chain(store, nums(4, 2, 1), nums(5))[0].done == []  # the same rows in another order
    assert chain(store, nums(1, 2, 4, 7), nums(5))[0].done == ["evens"]  # it comes out as before, so the rest stands
    changed, out = chain(store, nums(1, 2, 4, 7), nums(6))
    assert changed.done == ["doubled", "both", "last"] and out == [2, 4, 12]
    assert chain(store, nums(1, 2, 4, 7), nums(6), settings={"t": 1})[0].done == ["evens", "doubled", "both", "last"]
    with pytest.raises(Paused):
        chain(store, nums(8), nums(6), pause=["both"])
    resumed, out = chain(store, nums(8), nums(6))
    assert resumed.done == ["both", "last"] and out == [8, 12]  # the stages before the pause stand


def test_pause_review_and_conditional_end(spark, tmp_path):
    rows = [("p", f"R{i}", f"The system shall do {i}.", "functional", "Cart", None, "must", "d", "1") for i in range(3)] + [("q", "R9", "It shall wait.", "business", None, None, "must", "d", "1")]
    reqs = spark.createDataFrame(rows, "project_id string, id string, statement string, rtype string, feature string, nfr_category string, priority string, doc_id string, location string")
    store = Store(spark, str(tmp_path))
    with pytest.raises(Paused):
        deliver(reqs, None, Stages(store, pause={"review"}))
    early = deliver(reqs, None, Stages(store))
    assert "matrix" not in early and early["gate"].filter("ok").count() == 0  # nobody has reviewed: the run ends
    said = [("R0", 1, "accept", None), ("R1", 2, "edit", '{"statement": "The system shall do one."}'), ("R2", 3, "reject", None)]
    events = spark.createDataFrame([(r, n, a, e, "x", None) for r, n, a, e in said], reviews.EVENT)
    stages = Stages(store)
    out = deliver(reqs, events, stages)
    assert stages.done == ["review", "reviewed", "gate", "matrix"]
    assert [(r.id, r.statement) for r in out["matrix"].orderBy("id").collect()] == [("R0", rows[0][2]), ("R1", "The system shall do one.")]
    assert {r.project_id: r.ok for r in out["gate"].collect()} == {"p": True, "q": False}
    again = Stages(store)
    deliver(reqs, events, again)
    assert again.done == []
