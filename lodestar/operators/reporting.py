"""Numbering, traceability and open-item projections over approved requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import classify as cl
from lodestar.functions import text as tx
from lodestar.operators.similarity import cross_overlap, cross_similarity


def approved(reqs: DataFrame) -> DataFrame:
    return reqs.filter("status = 'approved'")


def _number(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("n").cast("string"))


def srs_ids(reqs: DataFrame) -> DataFrame:
    """Approved rows with srs_id: REQ by (first id of the feature, id), NFR by (section, id), BR by id; others null."""
    rows = approved(reqs).withColumn("bucket", cl.canonical_feature(F.col("feature")))
    functional = F.col("rtype") == "functional"
    rank = F.min(F.when(functional, F.col("id"))).over(W.partitionBy("project_id", "rtype", "bucket"))
    rows = rows.withColumn("key", F.when(functional, rank).when(F.col("rtype") == "non_functional", cl.nfr_section(F.col("nfr_category"))))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("project_id", "rtype").orderBy("key", "id")))
    srs = F.when(functional, _number("REQ-")).when(F.col("rtype") == "non_functional", _number("NFR-")).when(F.col("rtype") == "business", _number("BR-"))
    return rows.withColumn("srs_id", srs).drop("key", "n", "bucket")


def rtm_rows(reqs: DataFrame) -> DataFrame:
    """Traceability rows with their order ``pos`` in the project: REQ, NFR, BR, then untagged by id."""
    rows = srs_ids(reqs).withColumn("section", cl.section(F.col("rtype"), F.col("feature"), F.col("nfr_category")))
    rows = rows.withColumn("sources", F.when(F.col("location") == "", F.col("doc_id")).otherwise(F.concat_ws(" §", "doc_id", "location")))
    rows = rows.withColumn("evidence", F.concat(F.lit('"'), "statement", F.lit('"')))
    prefix = F.substring_index("srs_id", "-", 1)
    rank = F.when(prefix == "REQ", 0).when(prefix == "NFR", 1).when(prefix == "BR", 2).otherwise(3)
    order = W.partitionBy("project_id").orderBy(rank, F.coalesce(F.substring_index("srs_id", "-", -1).cast("int"), F.lit(0)), "id")
    return rows.withColumn("pos", F.row_number().over(order))


def _matrix(reqs: DataFrame, glossary: DataFrame | None, design: DataFrame | None) -> DataFrame:
    """The matrix's rows with ``part`` (requirements, design tokens, glossary) and ``pos`` in it."""
    rows = rtm_rows(reqs)
    n = F.row_number().over(W.partitionBy("project_id", "rtype").orderBy("pos")).cast("string")
    label = F.coalesce("srs_id", F.when(F.col("rtype") == "constraint", F.concat(F.lit("CON-"), n)).when(F.col("rtype") == "assumption", F.concat(F.lit("ASM-"), n)), F.col("id"))
    names = F.create_map(*[F.lit(x) for kv in lex.CATEGORY_LABELS.items() for x in kv])
    out = rows.select("project_id", F.lit(0).alias("part"), "pos", label.alias("row_id"), names[F.col("rtype")].alias("category"), "section", F.col("statement").alias("requirement"))
    if design is not None:
        at = F.concat("section", F.lpad(F.col("pos").cast("string"), 6, "0"))
        place = F.row_number().over(W.partitionBy("project_id").orderBy(at, "row_id"))  # a few dozen tokens a project
        out = out.unionByName(design.select("project_id", F.lit(1).alias("part"), place.alias("pos"), "row_id", F.lit("Design & UI").alias("category"), "section", "requirement"))
    if glossary is None:
        return out
    terms = glossary.select("project_id", F.lit(2).alias("part"), F.substring_index("id", "-", -1).cast("int").alias("pos"), F.col("id").alias("row_id"), F.lit("Glossary").alias("category"), F.lit("Appendix A").alias("section"), F.concat_ws(" — ", "term", "definition").alias("requirement"))
    return out.unionByName(terms)


def rtm_matrix(reqs: DataFrame, glossary: DataFrame | None = None, design: DataFrame | None = None) -> DataFrame:
    """(project_id, row_id, category, section, requirement): untagged rows become CON-n, ASM-n; design tokens and glossary terms follow."""
    return _matrix(reqs, glossary, design).drop("part", "pos")


def rtm_delivered(reqs: DataFrame, glossary: DataFrame | None = None, design: DataFrame | None = None) -> DataFrame:
    """The delivered matrix: project_id, part and pos to sort by, and the eight columns of its CSV, the last four blank for later phases."""
    id_, category, section, requirement, *blank = lex.RTM_CSV_HEADER
    rows = _matrix(reqs, glossary, design)
    return rows.select("project_id", "part", "pos", F.col("row_id").alias(id_), F.col("category").alias(category), F.col("section").alias(section), F.col("requirement").alias(requirement), *[F.lit("").alias(c) for c in blank])


def rtm_markdown(rows: DataFrame) -> DataFrame:
    """(project_id, pos, line): the table of ``rtm_rows`` (with priority) as Markdown lines, the two header lines at -1 and 0."""
    dash = lambda c: F.coalesce(c, F.lit("—"))
    cells = [dash("srs_id"), F.col("id"), tx.md_cell(F.col("statement")), F.col("rtype"), dash("priority"), *[tx.md_cell(F.col(c)) for c in ("section", "sources", "evidence")]]
    body = rows.select("project_id", "pos", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = [(-1, "| " + " | ".join(lex.RTM_HEADER) + " |"), (0, "|" + "---|" * len(lex.RTM_HEADER))]
    top = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(t).alias("line")) for p, t in head]))
    return body.unionByName(rows.select("project_id").distinct().select("project_id", top.alias("x")).select("project_id", "x.*"))


def traceability_gaps(reqs: DataFrame, delivered: DataFrame) -> DataFrame:
    """Approved requirements that a delivered matrix (id, section) does not hold or places nowhere."""
    good = delivered.filter("section is not null and section <> ''").select("id")
    return approved(reqs).select("project_id", "id").join(good, "id", "left_anti")


def manifest_counts(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("project_id").agg(*[F.count_if(F.col("row_id").startswith(f"{p}-")).alias(p.lower()) for p in ("REQ", "NFR", "BR", "CON", "ASM")], F.count("*").alias("total"))


def feature_priority(reqs: DataFrame) -> DataFrame:
    """Highest priority of each feature's requirements, as High, Medium or Low."""
    rank = F.create_map(*[F.lit(x) for kv in lex.PRIORITY_RANK.items() for x in kv])
    best = reqs.filter("rtype = 'functional'").groupBy("project_id", cl.canonical_feature(F.col("feature")).alias("bucket")).agg(F.min(rank[F.col("priority")]).alias("r"))
    return best.select("project_id", "bucket", F.when(F.col("r") == 0, "High").when(F.col("r") == 1, "Medium").otherwise("Low").alias("priority"))


def kinds(spark) -> DataFrame:
    return spark.createDataFrame([(k, t, o, p, label) for k, t, o, p, label in lex.OPEN_KINDS], "kind string, tier string, kind_order int, merge_rank int, label string")


def open_items(items: DataFrame) -> DataFrame:
    """Distinct open items (project_id, kind, statement, where, reason, idx) with tier and TBD-n or NOTE-n ids."""
    norm = tx.normalize(F.col("statement"))
    first = items.filter(F.trim("statement") != "").withColumn("norm", norm).withColumn("k", F.row_number().over(W.partitionBy("project_id", "kind", "norm").orderBy("idx"))).filter("k = 1").drop("k")
    rows = first.join(F.broadcast(kinds(items.sparkSession)), "kind", "left")
    tier = F.coalesce("tier", F.lit("B"))
    order = [tier, F.coalesce("kind_order", F.lit(99)), "norm", "idx"]
    note = tier == "C"
    n = F.row_number().over(W.partitionBy("project_id", note).orderBy(*order))
    where = F.when(F.coalesce("where", F.lit("")) != "", F.concat(F.lit(" (from "), "where", F.lit(")"))).otherwise("")
    text = F.concat(F.coalesce("label", "kind"), F.lit(': "'), F.trim("statement"), F.lit('"'), where, F.lit(" — "), F.coalesce("reason", "label", F.lit("Open item")))
    return rows.select("project_id", F.concat(F.when(note, "NOTE-").otherwise("TBD-"), n.cast("string")).alias("id"), "kind", tier.alias("tier"), n.alias("n"), text.alias("description"))


def appendix(numbered: DataFrame, cap: int = 5) -> DataFrame:
    """The first ``cap`` actionable items of a project (the cap is the feature) and how many more there are."""
    open_ = numbered.filter("tier in ('A', 'B')")
    more = F.greatest(F.lit(0), F.count("*").over(W.partitionBy("project_id")) - cap)
    return open_.withColumn("overflow", more).filter(F.col("n") <= cap).drop("n")


def uncovered_items(items: DataFrame, approved_reqs: DataFrame) -> DataFrame:
    """Open items less pointer demotions and noise that restates an approved requirement (by topic or wording)."""
    pointer = (F.col("kind") == "non_requirement") & cl.contains_any(F.lower(F.coalesce("reason", F.lit(""))), lex.POINTER_MARKERS)
    kept = items.filter(~pointer)
    noise = kept.filter(F.col("kind").isin(*lex.SUPPRESSIBLE) & (F.col("statement") != "")).select("project_id", "idx", "statement")
    firm = approved_reqs.select("project_id", "statement").distinct().withColumn("idx", F.xxhash64("project_id", "statement"))
    topics = lambda df: df.select("project_id", "idx", tx.topic_terms(F.col("statement")).alias("terms"))
    topical = cross_overlap(topics(noise), topics(firm), 0.85).filter(F.col("common") / (F.col("nl") + F.col("nr") - F.col("common")) >= 0.85)
    worded = cross_similarity(noise, firm, 0.6)
    gone = topical.select("project_id", F.col("idx").cast("long").alias("idx")).union(worded.select("project_id", "idx")).distinct()
    return kept.join(gone, ["project_id", "idx"], "left_anti")


def adopted_stack(aspects: DataFrame, selections: DataFrame) -> DataFrame:
    """Chosen candidate per aspect (project_id, key, name, recommended, pos): the selection by name in any case, else a custom name, else the recommended, else the first."""
    on = ["project_id", "key"]
    first = aspects.groupBy(*on).agg(F.min_by("name", F.struct((~F.col("recommended")).cast("int"), "pos")).alias("default"))
    named = aspects.join(selections, on).filter(F.lower("name") == F.lower("choice")).groupBy(*on).agg(F.min_by("name", "pos").alias("known"))
    return first.join(selections, on, "left").join(named, on, "left").select(*on, F.coalesce("known", F.nullif(F.trim("choice"), F.lit("")), "default").alias("name"))


def normalized_aspects(aspects: DataFrame, cap: int = 3) -> DataFrame:
    """At most ``cap`` candidates an aspect (project_id, key) and exactly one recommended: the first that was, else the first."""
    w = W.partitionBy("project_id", "key").orderBy("pos")
    rows = aspects.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)
    lead = F.coalesce(F.min(F.when(F.col("recommended"), F.col("n"))).over(W.partitionBy("project_id", "key")), F.lit(1))
    return rows.withColumn("recommended", F.col("n") == lead).drop("n")
