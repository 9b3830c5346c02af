"""Span joins against all pairs: ties, touching ends, empty spans, and a long document without its product."""

import random

from pyspark.sql import functions as F

from lodestar.operators import grounding

A, B = "doc_id string, s int, e int, a int", "doc_id string, start int, end int, b int"


def spans(rnd, n, width):
    out = []
    for i in range(n):
        s = rnd.randrange(6000)
        out.append((rnd.choice(["x", "y"]), s, s + rnd.choice([0, 1, 5, 40, 1024, width]), i))
    return [*out, ("x", 1024, 2048, n), ("x", 2048, 3072, n + 1), ("x", 2048, 2048, n + 2), ("x", 1024, 2048, n + 3), ("z", 0, 9, n + 4)]


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(1)
    left, right = spans(rnd, 150, 3000), spans(rnd, 150, 2500)
    got = grounding.overlapping(spark.createDataFrame(left, A), spark.createDataFrame(right, B), ["doc_id"])
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert sorted((r.a, r.b) for r in got.collect()) == want and len(want) > 500


def test_containment_against_all_pairs(spark):
    rnd = random.Random(2)
    outer, inner = spans(rnd, 150, 3000), spans(rnd, 60, 300)
    got = grounding.containing(spark.createDataFrame(outer, B), spark.createDataFrame(inner, B).drop("b"), ["doc_id"])
    want = sorted(x[3] for x in outer if any(x[0] == y[0] and x[1] <= y[1] and y[2] <= x[2] for y in inner))
    assert sorted(r.b for r in got.collect()) == want and 20 < len(want) < len(outer)
    unplaced = spark.createDataFrame([("x", None, None)], "doc_id string, start int, end int")
    assert grounding.containing(spark.createDataFrame(outer, B), unplaced, ["doc_id"]).count() == 0


def test_a_document_of_many_lines_and_spans(spark):
    n = 100_000
    lines = spark.range(n).select(F.lit("d").alias("doc_id"), (F.col("id") * 60).alias("start"), (F.col("id") * 60 + 60).alias("end"), F.col("id").alias("b"))
    marks = spark.range(n).select(F.lit("d").alias("doc_id"), (F.col("id") * 60 + 50).alias("s"), (F.col("id") * 60 + 70).alias("e"), F.col("id").alias("a"))
    pairs = grounding.overlapping(marks, lines, ["doc_id"])
    assert pairs.agg(F.count("*"), F.count_if(F.expr("b = a or b = a + 1"))).first() == (2 * n - 1, 2 * n - 1)
    gold = marks.select(F.col("a").alias("item_id"), "doc_id", F.col("s").alias("start"), F.col("e").alias("end"))
    best = grounding.best_coverage(gold, lines)
    assert best.filter("best = 0.5 and status = 'partial'").count() == n
    assert grounding.containing(lines, gold, ["doc_id"]).count() == 0


def test_class_of_a_chunk_at_an_open_items_place(spark):
    chunks = [("p", "d", 0, "1", "It shall work.", 0, 20), ("p", "d", 1, "2", "It shall fly.", 20, 40), ("p", "d", 2, "3", "It shall sing.", 40, 60), ("q", "d", 1, "2", "It shall fly.", 20, 40)]
    df = spark.createDataFrame(chunks, "project_id string, doc_id string, idx int, location string, text string, start int, end int")
    refs = spark.createDataFrame([("p", "d", 3, 9)], "project_id string, doc_id string, start int, end int")
    items = spark.createDataFrame([("p", "d", "2"), ("p", None, "3")], "project_id string, doc_id string, location string")
    got = grounding.chunk_classes(df, refs, items, ("project_id", "doc_id")).orderBy("project_id", "idx").collect()
    assert [r["class"] for r in got] == ["covered_by_req", "covered_by_openq", "possible_miss", "possible_miss"]
