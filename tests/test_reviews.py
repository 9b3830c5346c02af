"""Review state machine: the batch form and the stream against plain Python."""

import json
import random

from pyspark.sql import functions as F

from lodestar.streaming import reviews

REQ = "requirement_id string, statement string, rtype string, nfr_category string, feature string, priority string, rationale string, status string"


def data():
    rnd = random.Random(3)
    reqs = [(f"r{i}", rnd.choice([f"Text {i}", f"Text {i}", " "]), "functional", None, "Cart", None, None, "candidate") for i in range(25)]
    edits = [{"statement": "New text"}, {"statement": " "}, {"priority": "must", "feature": None}, {"rtype": "business"}, {"rtype": "odd"}, {"id": "x"}, {}, None, {"rationale": "é", "nfr_category": "security"}]
    out = []
    for seq in range(400):
        e = rnd.choice(edits)
        out.append((f"r{rnd.randrange(28)}", seq, rnd.choice(["accept", "edit", "edit", "edit", "reject", "shelve"]), rnd.choice(["[1]", "{"]) if rnd.random() < 0.1 else None if e is None else json.dumps(e), f"a{seq % 3}", None))
    return reqs, out


def plain(reqs, events):
    state, seen, out = {r[0]: dict(zip((*reviews.FIELDS, "status"), r[1:])) for r in reqs}, {}, []
    for rid, seq, action, edits, actor, _ in events:
        before = dict(state[rid]) if rid in state else None
        reason = None
        if rid not in state:
            reason = reviews.UNKNOWN
        elif seq <= seen.get(rid, -1):
            reason = reviews.LATE
        elif action == "shelve":
            reason = reviews.ACTION
        elif action == "edit":
            try:
                e = json.loads(edits) if edits is not None else {}
            except ValueError:
                e = []
            if not isinstance(e, dict):
                reason = reviews.OBJECT
            elif "id" in e:
                reason = reviews.FIELD
            elif e.get("rtype") == "odd":
                reason = reviews.TYPE
            elif not (e.get("statement") or before["statement"]).strip() or e.get("statement") == " ":
                reason = reviews.BLANK
            else:
                state[rid].update({k: v for k, v in e.items() if v is not None})
        seen[rid] = max(seq, seen.get(rid, -1))
        if reason is None:
            state[rid]["status"] = "rejected" if action == "reject" else "approved"
        out.append((rid, seq, reason, before, dict(state[rid]) if rid in state else None))
    return out, state


def rows(df):
    return sorted(((r.requirement_id, r.seq, r.refusal, r.before and r.before.asDict(), r.after and r.after.asDict()) for r in df.collect()), key=lambda r: (r[1], r[2] or ""))


def test_batch_form_against_plain_python(spark):
    reqs, events = data()
    want, state = plain(reqs, events)
    rdf, edf = spark.createDataFrame(reqs, REQ), spark.createDataFrame(events, reviews.EVENT)
    got = reviews.decide(rdf, edf)
    assert rows(got) == sorted(want, key=lambda r: r[1])
    assert {w[2] for w in want} == {None, reviews.UNKNOWN, reviews.ACTION, reviews.OBJECT, reviews.FIELD, reviews.TYPE, reviews.BLANK}
    now = {r.requirement_id: r for r in reviews.current(rdf, got).collect()}
    assert {i: tuple(now[i][f] for f in (*reviews.FIELDS, "status")) for i in now} == {i: tuple(s.values()) for i, s in state.items()}
    again = rows(reviews.decide(rdf, edf.union(edf.filter("seq = 7"))).filter("seq = 7"))
    assert len(again) == 2 and {r[2] for r in again} & {reviews.LATE, reviews.UNKNOWN}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    reqs, events = data()
    rdf = spark.createDataFrame(reqs, REQ)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda part: spark.createDataFrame(part, reviews.EVENT).coalesce(1).write.mode("append").parquet(source)
    run = lambda: reviews.stream_decisions(rdf, spark.readStream.schema(reviews.EVENT).option("maxFilesPerTrigger", 1).parquet(source), folder)
    for part in (events[:90], events[90:91], events[91:200]):
        add(part)
    first = rows(run())
    assert first == sorted(plain(reqs, events[:200])[0], key=lambda r: r[1])
    late = [events[5], events[199], *events[200:]]  # a repeat, and one that was seen last
    add(late)
    got = rows(run())
    want = plain(reqs, events[:200] + sorted(late, key=lambda e: e[1]))[0]
    assert got == sorted(want, key=lambda r: (r[1], r[2] or "")) and any(r[2] == reviews.LATE for r in got)
    assert rows(run()) == got  # nothing new, nothing twice
    settled = reviews.current(rdf, reviews.decide(rdf, spark.createDataFrame(events, reviews.EVENT))).drop("refused")
    assert sorted(map(tuple, reviews.current(rdf, run()).drop("refused").collect()), key=str) == sorted(map(tuple, settled.collect()), key=str)


def test_no_events_and_null_edits(spark):
    reqs, _ = data()
    rdf, none = spark.createDataFrame(reqs, REQ), spark.createDataFrame([], reviews.EVENT)
    assert reviews.decide(rdf, none).count() == 0
    assert reviews.current(rdf, reviews.decide(rdf, none)).filter("decisions = 0 and refused = 0").count() == len(reqs)
    one = spark.createDataFrame([("r0", 1, None, None, None, None), ("r0", 2, "edit", '{"priority": null}', None, None)], reviews.EVENT)
    assert [r.refusal for r in reviews.decide(rdf.filter("requirement_id = 'r0'").withColumn("statement", F.lit("x")), one).orderBy("seq").collect()] == [reviews.ACTION, None]


def test_stream_of_parts_in_several_files_and_requirements_that_share_a_bucket(spark, monkeypatch):
    from lodestar.plans import data_queries as dq

    monkeypatch.setattr(dq, "FILE_EVENTS", 40)
    monkeypatch.setattr(reviews, "BUCKETS", 3)
    asked = []
    stream = reviews.stream_decisions
    monkeypatch.setattr(reviews, "stream_decisions", lambda reqs, events, folder: asked.append(folder) or stream(reqs, events, folder))
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, dq.streaming_review_machine(spark, sf).collect()), key=str)
    assert got == sorted(map(tuple, dq.review_machine(spark, sf).collect()), key=str) and len(asked) == 2
    parts = spark.read.parquet(asked[0].removesuffix("out") + "in").select("requirement_id", "seq", F.input_file_name().alias("file"))
    assert parts.agg(F.count_distinct("file")).first()[0] > 4
    early = parts.groupBy("requirement_id").agg(F.count_distinct("file").alias("n"))
    assert early.filter("n > 4").count() == 0  # one file a part
