"""The review of requirements as a state machine: accept, edit and reject, with a snapshot before and after each decision.

One rule in two forms. ``decide`` takes a whole log and is windows only; ``stream_decisions`` takes events as they arrive, with a state store
that keeps each requirement's fields and the last event applied (``transformWithState``), so a batch touches only the requirements it
has events for, and a restart goes on from the checkpoint. Requirements are dealt to ``BUCKETS`` buckets, which are the groups that Python is
called with: a call costs milliseconds, a requirement in it only its state's reading and writing.

An event (requirement_id, seq, action, edits, actor, ts) applies in the order of seq. ``edits`` is a JSON object of fields to change;
null values change nothing. Accept and edit approve, reject rejects; ids, sources and provenance cannot be edited. Set aside with a
reason, without effect, are events on unknown requirements, unknown actions, edits that are no object, of other fields, to an unknown
type or to a blank statement, and events whose seq is not above the last one applied or set aside (repeats, latecomers). In a batch the log is
sorted, so only repeats are late there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar import lexicons as lex

FIELDS = ("statement", "rtype", "nfr_category", "feature", "priority", "rationale")
SNAPSHOT = ", ".join(f"{f}: string" for f in (*FIELDS, "status"))
EVENT = "requirement_id string, seq long, action string, edits string, actor string, ts timestamp"
DECISION = f"requirement_id string, seq long, action string, actor string, ts timestamp, refusal string, before struct<{SNAPSHOT}>, after struct<{SNAPSHOT}>"
#: Groups of requirements in a stream's state. A stream's state was dealt with this number, so it must stay.
BUCKETS = 1024
STATUS = {"accept": "approved", "edit": "approved", "reject": "rejected"}
LATE, UNKNOWN, ACTION, OBJECT, FIELD, TYPE, BLANK = "late or repeated", "unknown requirement", "unknown action", "edits are not an object", "field is not editable", "unknown type", "statement cannot be empty"


def decide(reqs: DataFrame, events: DataFrame) -> DataFrame:
    """``DECISION`` rows of a log over requirements (requirement_id, the six fields, status)."""
    start = reqs.select("requirement_id", F.struct(*FIELDS, "status").alias("start"))
    rows = events.join(start, "requirement_id", "left").withColumn("map", F.from_json("edits", "map<string,string>"))
    keys = F.map_keys("map")
    refusal = (
        F.when(F.col("start").isNull(), UNKNOWN).when(~F.coalesce(F.col("action").isin(*STATUS), F.lit(False)), ACTION)
        .when((F.col("action") == "edit") & F.col("edits").isNotNull() & F.col("map").isNull(), OBJECT)
        .when((F.col("action") == "edit") & F.exists(keys, lambda k: ~k.isin(*FIELDS)), FIELD)
        .when((F.col("action") == "edit") & ~F.try_element_at("map", F.lit("rtype")).isin(*lex.RTYPES), TYPE)
    )
    key = W.partitionBy("requirement_id")
    order = key.orderBy("seq", "place")
    rows = rows.withColumn("place", F.xxhash64("action", "edits", "actor", "ts")).withColumn("nth", F.row_number().over(W.partitionBy("requirement_id", "seq").orderBy("place")))
    rows = rows.withColumn("refusal", F.when((F.col("nth") > 1) & F.col("start").isNotNull(), LATE).otherwise(refusal))
    new = lambda f: F.when(F.col("refusal").isNull() & (F.col("action") == "edit"), F.try_element_at("map", F.lit(f)))
    text = lambda c: F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
    had = F.coalesce(F.max(text(new("statement"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)) | text(F.col("start.statement"))
    blank = F.col("refusal").isNull() & (F.col("action") == "edit") & ~F.when(new("statement").isNotNull(), text(new("statement"))).otherwise(had)
    rows = rows.withColumn("refusal", F.when(blank, BLANK).otherwise(F.col("refusal")))
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    fresh = {**{f: new(f) for f in FIELDS}, "status": F.when(F.col("refusal").isNull(), F.try_element_at(status, F.col("action")))}

    def snapshot(last: int):
        now = order.rowsBetween(W.unboundedPreceding, last)
        return F.when(F.col("start").isNotNull(), F.struct(*[F.coalesce(F.last(c, ignorenulls=True).over(now), F.col(f"start.{f}")).alias(f) for f, c in fresh.items()]))

    return rows.withColumn("before", snapshot(-1)).withColumn("after", snapshot(0)).select("requirement_id", "seq", "action", "actor", "ts", "refusal", "before", "after")


class ReviewMachine(StatefulProcessor):
    """The requirements of a bucket: for each known one its fields, and the last seq seen. What is unknown when the stream starts stays so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("requirements", "requirement_id string", f"{SNAPSHOT.replace(':', '')}, seq long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803  Spark's names
        for row in initialState.to_dict("records"):
            if row["requirement_id"] is not None:
                self.state.updateValue((row["requirement_id"],), (*[None if pd.isna(row[f]) else row[f] for f in (*FIELDS, "status")], None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        mine: dict[str, list[dict]] = {}
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").to_dict("records"):
            mine.setdefault(r["requirement_id"], []).append(r)
        out = []
        for name, events in mine.items():
            held = None if name is None else self.state.getValue((name,))
            fields = None if held is None else dict(zip((*FIELDS, "status"), held, strict=False))
            seen = None if held is None else held[-1]
            for r in events:
                before = None if fields is None else dict(fields)
                refusal, edits = _refused(fields, r, seen)
                seen = r["seq"] if seen is None else max(seen, r["seq"])
                if refusal is None:
                    fields.update({k: v for k, v in edits.items() if v is not None}, status=STATUS[r["action"]])
                out.append({**{c: r[c] for c in ("requirement_id", "seq", "action", "actor", "ts")}, "refusal": refusal, "before": before, "after": None if fields is None else dict(fields)})
            if fields is not None:
                self.state.updateValue((name,), (*(fields[f] for f in (*FIELDS, "status")), int(seen)))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _refused(fields: dict | None, event: dict, seen: int | None) -> tuple[str | None, dict]:
    """Why an event has no effect (None: it has), and its edits."""
    if fields is None:
        return UNKNOWN, {}
    if seen is not None and event["seq"] <= seen:
        return LATE, {}
    if event["action"] not in STATUS:
        return ACTION, {}
    if event["action"] != "edit":
        return None, {}
    try:
        edits = json.loads(event["edits"]) if event["edits"] is not None else {}
    except ValueError:
        edits = None
    if not isinstance(edits, dict):
        return OBJECT, {}
    if set(edits) - set(FIELDS):
        return FIELD, {}
    if edits.get("rtype") is not None and edits["rtype"] not in lex.RTYPES:
        return TYPE, {}
    text = edits.get("statement")
    if not ((fields["statement"] if text is None else text) or "").strip():
        return BLANK, {}
    return None, edits


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that this kind of state needs, and no more partitions of it than keep all cores busy, while a stream starts."""
    partitions = "spark.sql.shuffle.partitions"
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        partitions: str(min(int(spark.conf.get(partitions)), 3 * spark.sparkContext.defaultParallelism)),
    }
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream_decisions(reqs: DataFrame, events: DataFrame, folder: str) -> DataFrame:
    """``DECISION`` rows of a stream of events so far, written to ``folder`` (exactly once a batch) with offsets and state beside them.

    ``reqs`` is read when the stream first starts; later calls go on where the last one ended.
    """
    spark = reqs.sparkSession
    out = T.StructType.fromDDL(DECISION)
    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("requirement_id"), F.lit(BUCKETS))).groupBy("bucket")
    with _rocksdb(spark):
        decided = dealt(events).transformWithStateInPandas(ReviewMachine(), out, "append", "none", initialState=dealt(reqs.select("requirement_id", *FIELDS, "status")))
        writer = decided.writeStream.format("parquet").option("path", f"{folder}/decisions").option("checkpointLocation", f"{folder}/offsets")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(f"{folder}/decisions")


def current(reqs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``reqs`` after all decisions, with the numbers of decisions taken and set aside."""
    good = F.col("refusal").isNull()
    last = decisions.groupBy("requirement_id").agg(F.max_by(F.when(good, F.col("after")), F.when(good, F.col("seq"))).alias("x"), F.count_if(good).alias("decisions"), F.count_if(~good).alias("refused"))
    field = lambda f: F.when(F.col("x").isNotNull(), F.col(f"x.{f}")).otherwise(F.col(f)).alias(f)
    return reqs.join(last, "requirement_id", "left").select("requirement_id", *[field(f) for f in (*FIELDS, "status")], F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("refused", F.lit(0)).alias("refused"))
