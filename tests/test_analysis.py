import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import classify as cl
from lodestar.functions import text as tx
from lodestar.operators import document
from lodestar.plans import analysis
from lodestar.plans.data_queries import open_rows
from lodestar.plans.req_view import req_view
from lodestar.sources.store import Store

SF = "/root/testdata/sf0.001"


def as_chunks(rows):
    """Every row of the view as a chunk of its document, with the requirement inside it."""
    at = F.col("idx") * 200
    spot = rows.withColumn("start", at.cast("long")).withColumn("end", (at + F.length("statement")).cast("long"))
    return spot, spot.select("project_id", "doc_id", F.col("idx").cast("int").alias("idx"), "location", F.col("statement").alias("text"), at.cast("long").alias("start"), (at + 200).cast("long").alias("end"))


def test_chain_against_plain_python(spark, tmp_path):
    """Stage by stage: every stage from what the one before left, in plain Python."""
    rows = req_view(spark, SF)
    reqs, chunks = as_chunks(rows)
    given = open_rows(spark, SF)
    v = analysis.Verdicts(
        verify=rows.select("project_id", "id", (F.col("idx") % 3 > 0).alias("holds"), F.lit(False).alias("open_decision")),
        reconcile=rows.select("project_id", F.col("idx").cast("long").alias("idx")),
        gaps=spark.createDataFrame([("Brand#11", " Offline use "), ("Brand#11", "offline  USE"), ("Brand#11", "No requirements address Security."), ("Brand#11", " ")], "project_id string, statement string"),
    )
    stages = analysis.Stages(Store(spark, str(tmp_path)))
    out = analysis.analyze(reqs, given, chunks, stages, v)
    stage = lambda name: stages.store.read(name).collect()
    folded = out["folded"].collect()
    assert sum(1 + len(r.duplicate_of) for r in folded) == 200
    pointers = {r.idx for r in out["folded"].filter(cl.is_pointer(F.col("statement"))).collect()}
    kept = {r.idx: r for r in folded if r.idx not in pointers}
    assert {r.idx for r in stage("consolidated")} == set(kept) and pointers
    cautions = [r for r in given.collect() if r.kind in lex.SCOPE_KINDS]
    best = {}
    for i, r in kept.items():
        near = [(-tx.similarity(r.statement, c.statement), c.idx) for c in cautions if c.project_id == r.project_id]
        if near and -min(near)[0] >= 0.5:
            best[i] = min(near)[1]
    assert {r.idx: r.match for r in out["withdrawn"].collect()} == best and best
    rated = stage("rated")
    assert {r.idx for r in rated} == set(kept) - set(best)
    outcome = {r.id: r.outcome for r in stage("opinions")}
    final = out["requirements"].collect()
    assert {r.id for r in final} == {r.id for r in rated} - {i for i, o in outcome.items() if o == "critic_rejected"} and len(final) < len(rated)
    want = Counter((r.project_id, r.kind) for r in given.collect())
    want.update((kept_or.project_id, "non_requirement") for kept_or in folded if kept_or.idx in pointers)
    want.update((r.project_id, outcome[r.id]) for r in rated if outcome.get(r.id, "holds") != "holds")
    text = {}
    for r in final:
        text[r.project_id] = text.get(r.project_id, "") + f" \n {r.statement} {r.nfr_category or ''}".lower()
    missing = {(p, a) for p, t in text.items() for a, _, pattern in lex.ASPECTS if not re.search(pattern, t)}
    want.update((p, "gap") for p, _ in missing)
    want["Brand#11", "gap"] += 1 + (("Brand#11", "Security") not in missing)
    raised = stage("open_items_raised")
    assert Counter((r.project_id, r.kind) for r in raised) == want
    inside, places = {(r.project_id, r.doc_id, r.start, r.end) for r in final}, {(r.project_id, r.doc_id, r.where) for r in raised}
    classes = {(r.project_id, r.doc_id, r.idx): r["class"] for r in out["coverage"].collect()}
    for c in chunks.collect():
        by_req = any(p == c.project_id and d == c.doc_id and c.start <= s and e <= c.end for p, d, s, e in inside)
        by_item = (c.project_id, c.doc_id, c.location) in places
        got = classes[c.project_id, c.doc_id, c.idx]
        assert (got == "covered_by_req") == by_req and (got == "covered_by_openq") == (by_item and not by_req)
    n = Counter(classes.values())
    assert n["covered_by_openq"] and n["covered_by_req"]
    items = stage("open_items_all")
    assert len(items) == len(raised) + n["possible_miss"] and len({r.idx for r in items}) == len(items)
    assert Counter(x for r in items for x in r.reconciled_from) == Counter(kept[i].id for i in best)
    left = out["open_items"].collect()
    assert {r.idx for r in left} <= {r.idx for r in items} and 0 < len(left) < len(items) and all(r.merged_count == 1 for r in left)
    again = analysis.Stages(Store(spark, str(tmp_path)))
    assert analysis.analyze(reqs, given, chunks, again, v)["requirements"].count() == len(final) and again.done == []


def test_possible_misses_and_merged_items(spark, tmp_path):
    reqs = spark.createDataFrame([("p", 1, "R1", "The system shall store every order within five seconds.", "functional", "Cart", None, False, 0.9, "brd", "d", "1", 0, 40)], "project_id string, idx int, id string, statement string, rtype string, feature string, nfr_category string, inferred boolean, confidence double, source_type string, doc_id string, location string, start int, end int")
    items = spark.createDataFrame([("p", 1, "inferred", "The wishlist is open", "d", "2", "r"), ("p", 2, "disputed", "The wishlist is still open now", "d", "9", "r")], "project_id string, idx int, kind string, statement string, doc_id string, where string, reason string")
    chunks = spark.createDataFrame([("p", "d", i, str(i), t, i * 50, i * 50 + 50) for i, t in enumerate(["It shall hold.", "It shall walk.", "It shall fly.", "# Title", "It shall sing to every customer."])], "project_id string, doc_id string, idx int, location string, text string, start int, end int")
    first = analysis.analyze(reqs, items, chunks, analysis.Stages(Store(spark, str(tmp_path / "a"))))
    assert [r["class"] for r in first["coverage"].orderBy("idx").collect()] == ["covered_by_req", "possible_miss", "covered_by_openq", "expected_nonrequirement", "possible_miss"]
    misses = {r.where: r.statement for r in first["open_items"].filter("kind = 'possible_miss'").collect()}
    assert misses == {"1": "It shall walk.", "4": "It shall sing to every customer."}
    from lodestar.operators.folds import windows_of

    two = windows_of(first["open_items"].select("project_id", "idx", "statement"), 0.5, by_text=True).filter("statement like '%wishlist%'").select("project_id", "comp", "window", F.lit(1).alias("group_id"), "pos")
    merged = analysis.analyze(reqs, items, chunks, analysis.Stages(Store(spark, str(tmp_path / "b"))), analysis.Verdicts(open_items=two))["open_items"]
    assert [(r.kind, r.merged_count) for r in merged.filter("statement like '%wishlist%'").collect()] == [("disputed", 2)]
    assert merged.count() == first["open_items"].count() - 1


def test_confirmed_duplicates_keep_the_longest_wording(spark):
    from lodestar.operators import folds

    rows = [("p", i, f"id{i}", s, 1, [f"d{i}"]) for i, s in enumerate(["Users pay by card.", "Users pay by card or by bank card.", "Users may pay by card at once now", "Nothing alike at all"])]
    df = spark.createDataFrame(rows, "project_id string, idx long, id string, statement string, authority int, refs array<string>")
    said = folds.windows_of(df, 0.45).filter("pos < 3 and idx < 3").select("project_id", "comp", "window", F.lit(1).alias("group_id"), "pos")
    got = {r.id: (list(r.duplicate_of), list(r.refs), r.statement) for r in folds.confirmed_dedup(df, said).collect()}
    assert got == {"id1": (["id0", "id2"], ["d1", "d0", "d2"], rows[1][3]), "id3": ([], ["d3"], rows[3][3])}


def test_converge(spark):
    data = [[1, 2, 2], [2, 3], [1, 3], [9]]
    out = analysis.converge(lambda i: spark.createDataFrame([(x,) for x in data[i]], "k int"), "k", 4)
    assert sorted((r.k, r["pass"]) for r in out.collect()) == [(1, 0), (2, 0), (3, 1)]
    with pytest.raises(ValueError):
        analysis.converge(lambda i: None, "k", 0)


def test_requirements_and_json(spark):
    rows = [("p", 0, "A", "odd", "f", "x", False, 1.7, 100, [(1, 5)]), ("p", 1, "B", "non_functional", "f", "", False, -1.0, 0, [])]
    df = spark.createDataFrame(rows, "project_id string, idx int, statement string, rtype string, feature string, nfr_category string, inferred boolean, confidence double, chunk_start int, spans array<struct<start:int,end:int>>")
    a, b = analysis.requirements(df).orderBy("idx").collect()
    assert (a.rtype, a.feature, a.nfr_category, a.confidence, tuple(a.spans[0])) == ("functional", "f", None, 1.0, (101, 105))
    assert (b.feature, b.nfr_category, b.confidence) == (None, None, 0.0) and a.id.startswith("EX-")
    assert [analysis.first_object(x) for x in ('{"a": 1}', "[1]", 'so: {"b": {"c": 2}} and {"d": 3}', "none", None, '[{"a": 1}]')] == ['{"a": 1}', None, '{"b": {"c": 2}}', None, None, None]


def test_open_item_merge_keeps_counts(spark):
    rows = [("p", i, k, s, 1) for i, (k, s) in enumerate([("inferred", "The wishlist is open"), ("conflict", "The wishlist is open now"), ("gap", "Other topic altogether")])]
    df = spark.createDataFrame(rows, "project_id string, idx long, kind string, statement string, merged_count long")
    from lodestar.operators.folds import windows_of

    verdicts = windows_of(df, 0.5, by_text=True).filter("pos < 2").select("project_id", "comp", "window", F.lit(1).alias("group_id"), "pos")
    got = sorted((r.kind, r.merged_count) for r in analysis.merge_open_items(df, verdicts).collect())
    assert got == [("conflict", 2), ("gap", 1)]


def test_structure_and_violations(spark):
    md = "# Title\n\n## 2. Overall\n### 2.3 User Class list\n| User Class | Description |\n|---|---|\n| a | b |\n| | |\n\n- **REQ-1:** x\n* NFR-2 y\n## Appendix B: Models\nThe principal entities (a) are here\n|x|\n"
    docs = spark.createDataFrame([("d", md)], "doc_id string, text string")
    rows = document.structure(docs).orderBy("line_no").collect()
    assert [r.kind for r in rows][:10] == ["heading", "blank", "heading", "heading", "table_head", "table_rule", "table_row", "table_row", "blank", "text"]
    assert (rows[6].sec_num, rows[6].sec_title, rows[6].cells) == ("2.3", "User Class list", ["a", "b"])
    assert {r.tag: r.n for r in document.tags(document.structure(docs)).collect()} == {"REQ": 1, "NFR": 1}
    bad = [(r.rule, r.detail) for r in document.violations(docs).collect()]
    assert ("section", "missing required section: 1") in bad and not any("user_classes" in d or "2.3" in d for _, d in bad)
    assert ("table", "missing required table 'glossary' in §appendix a") in bad and not any(r == "pattern" for r, _ in bad)
    assert ("section", "§2 title should contain 'overall description' — found 'Overall'") in bad


def test_every_doubted_requirement_of_a_project_gets_its_opinion(spark, tmp_path):
    """More targets than the 120 that once were asked: a verdict on a later one counts as well."""
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = [("p", i, f"R{i}", f"{word()} {word()} {word()} {word()} quickly", "constraint", None, None, False, 0.3, "brd", "d", "1", i * 50, i * 50 + 40) for i in range(130)]
    reqs = spark.createDataFrame(rows, "project_id string, idx int, id string, statement string, rtype string, feature string, nfr_category string, inferred boolean, confidence double, source_type string, doc_id string, location string, start int, end int")
    items = spark.createDataFrame([], "project_id string, idx int, kind string, statement string, doc_id string, where string, reason string")
    chunks = spark.createDataFrame([("p", "d", 0, "1", "# Title", 0, 50)], "project_id string, doc_id string, idx int, location string, text string, start int, end int")
    doubted = reqs.select("project_id", "id", F.lit(False).alias("holds"), F.lit(False).alias("open_decision"))
    out = analysis.analyze(reqs, items, chunks, analysis.Stages(Store(spark, str(tmp_path))), analysis.Verdicts(verify=doubted))
    assert out["folded"].count() == 130 and out["requirements"].count() == 0
