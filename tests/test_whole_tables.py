"""Queries over the requirement view, documents and pages take all rows that the job names."""

import re

from pyspark.sql import functions as F

from lodestar.operators import similarity
from lodestar.plans import classify_queries, data_queries
from lodestar.plans.req_view import req_view

SF = "/root/testdata/sf0.001"


def test_stated_stack_has_every_requirement(spark):
    out = {r.id: r for r in classify_queries.stated_stack(spark, SF).collect()}
    reqs = req_view(spark, SF).collect()
    assert sorted(out) == sorted(r.id for r in reqs)
    assert all(out[r.id].tokens == "django|postgresql|redis" for r in reqs if r.idx % 30 == 29)


def test_affected_requirements_decides_by_markers(spark, tmp_path):
    # a marked row at an ordinary place is a decision; the row that shares its rare term is none
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.withColumn("p_name", F.when(F.col("p_partkey") == 12, "zeppelin out of scope").when(F.col("p_partkey") == 42, "zeppelin").otherwise(F.col("p_name"))).withColumn("p_brand", F.lit("Brand#1")).write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.decision_id, r.id) for r in data_queries.affected_requirements(spark, str(tmp_path)).collect()}
    assert ("R-000000012", "R-000000042") in got and not [g for g in got if g[0] == "R-000000042"]


def test_best_caution_takes_every_firm_requirement(spark):
    got = {(r.idx, r.match) for r in data_queries.best_caution(spark, SF).collect()}
    reqs = req_view(spark, SF)
    cautions = data_queries.open_rows(spark, SF).filter(F.col("kind").isin("out_of_scope", "disputed", "undecided", "deferred"))
    marked = {r.idx for r in cautions.collect()}
    want = similarity.best_match(reqs.filter("status = 'approved'"), cautions, 0.5).collect()
    assert got == {(r.idx, r.match) for r in want if r.idx not in marked}
    assert got and not [i for i, _ in got if i in marked]


def test_heading_blocks_renders_whole_pages(spark, tmp_path):
    html = (
        "<html><script>var t='<p>no</p>';</script><body><!-- <p>no</p> --><h1>A</h1><p><b>one</b> more\n text<br><p class='x'>two</p>"
        "<h2>B</h2><p>three</p><pre>no</pre><p># four</p><H3>C</H3><div><p>five</div><h2>D</h2><p> </p><p>six"
    )
    spark.createDataFrame([(1, "u", html), (2, "u", "<p>lone</p>"), (3, "u", "<h1>no text</h1>"), (4, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = sorted(data_queries.heading_blocks(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start))
    text = "# A\n\none more text\n\ntwo\n\n## B\n\nthree\n\n\\# four\n\n### C\n\nfive\n\n## D\n\nsix\n"
    want = [("A", "one more text"), ("A", "two"), ("A › B", "three"), ("A › B", "\\# four"), ("A › B › C", "five"), ("A › D", "six")]
    assert [(r.location, text[r.start : r.end].strip()) for r in rows if r.doc_id == 1] == want
    assert [(r.doc_id, r.location) for r in rows[6:]] == [(2, "(top)")]


def test_heading_blocks_has_every_paragraph(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    n = 0
    for r in pages:
        shown = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", " ", r.html)
        n += sum(re.sub(r"<[^>]*>", "", re.split(r"</?(?:p|div|article|footer|h1|ul)\b", t)[0]).strip() != "" for t in re.split(r"<p>", shown)[1:])
    assert data_queries.heading_blocks(spark, SF).count() == n > len(pages)


def test_coverage_counts_every_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = sum(len([x for x in (r.text or "").splitlines(True)]) for r in docs.collect())
    (got,) = data_queries.chunk_coverage_counts(spark, SF).collect()
    assert got.total == n and docs.filter("lang <> 'en'").count() > 0
    assert got.total == got.covered_by_req + got.covered_by_openq + got.expected_nonrequirement + got.possible_miss


def test_verify_targets_cap_holds_for_a_project(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey % 30 = 18").limit(1).drop("p_partkey", "p_brand")
    keys = spark.range(1, 20001).withColumnRenamed("id", "p_partkey").withColumn("p_brand", F.concat(F.lit("Brand#"), F.pmod("p_partkey", F.lit(2)).cast("string")))
    part.crossJoin(keys).write.parquet(f"{tmp_path}/part.parquet")
    got = classify_queries.verify_targets(spark, str(tmp_path))
    risky = classify_queries.assessed(req_view(spark, str(tmp_path))).filter("triage.level = 'attention' and not inferred and twin is null")
    by: dict[str, list[tuple[int, str]]] = {}
    for r in risky.select("project_id", "idx", "id").collect():
        by.setdefault(r.project_id, []).append((r.idx, r.id))
    assert min(len(v) for v in by.values()) > 120 and len(by) == 2
    assert sorted(r.id for r in got.collect()) == sorted(i for v in by.values() for _, i in sorted(v)[:120])
