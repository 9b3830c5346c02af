"""Grounding, chunks, reports, review logs and similarity queries, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import classify as cl
from lodestar.functions import numeric as nu
from lodestar.functions import text as tx
from lodestar.operators import decisions as de
from lodestar.operators import design, document, folds, grounding, location, reporting, review, similarity
from lodestar.operators.graph import connected_components
from lodestar.operators.similarity import overlap_pairs
from lodestar.plans import duck
from lodestar.plans.classify_queries import GLOSSARY_SQL, assessed, glossary
from lodestar.plans.req_view import req_view, with_view
from lodestar.runtime import Scratch
from lodestar.sources import chunkers, corpus
from lodestar.streaming import reviews

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, view: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_view(sql) if view else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- grounding ---


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return grounding.contains_join(docs, table(spark, sf_dir, "benchmark"))


_FOUND = "found AS (SELECT b.item_id, d.doc_id, d.source, strpos(d.text, b.text) - 1 AS s, strpos(d.text, b.text) - 1 + length(b.text) AS e FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {_FOUND} SELECT b.item_id, count(f.doc_id) AS n_docs, min(f.doc_id) AS first_doc, arg_min(f.s, f.doc_id) AS first_start, CASE WHEN count(f.doc_id) > 0 THEN 'captured' ELSE 'missed' END AS status FROM benchmark b LEFT JOIN found f USING (item_id) GROUP BY 1")
def ground_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold each benchmark passage verbatim, and where first."""
    hits = found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min_by("start", "doc_id").alias("first_start"))
    out = table(spark, sf_dir, "benchmark").select("item_id").join(hits, "item_id", "left")
    return out.select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"), "first_doc", "first_start", F.when(F.col("n") > 0, "captured").otherwise("missed").alias("status"))


@query(f"WITH {_FOUND} SELECT source, count(DISTINCT item_id) AS captured, count(DISTINCT item_id) / CAST((SELECT count(*) FROM benchmark) AS DOUBLE) AS recall FROM found GROUP BY 1")
def grounding_recall_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").count()
    return found(spark, sf_dir).groupBy("source").agg(F.count_distinct("item_id").alias("captured")).withColumn("recall", F.col("captured") / F.lit(float(n)))


@query(f"WITH {_FOUND} SELECT item_id, doc_id, s AS start, e AS \"end\", e - s >= 12 AND len(regexp_split_to_array(trim(b.text), '\\s+')) >= 3 AS substantive FROM found JOIN benchmark b USING (item_id)")
def substantive_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).join(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "doc_id", "start", "end", tx.is_substantive(F.col("text")).alias("substantive"))


_PLAIN = "lower(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"SELECT b.item_id, d.doc_id, contains(d.text, b.text) AND b.item_id % 3 = 0 AS verbatim FROM benchmark b JOIN documents d ON contains({_PLAIN.format('d.text')}, {_PLAIN.format('b.text')})")
def tolerant_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold each passage, of which two in three are asked for in capitals and with other white space."""
    altered = F.replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "), F.lit(" \n\t"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(altered).alias("text"))
    return location.locate_join(table(spark, sf_dir, "documents").select("doc_id", "text"), asked).select("item_id", "doc_id", "verbatim")


_LINES = (
    "cut AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n, len(string_split(text, chr(10))) AS m FROM documents), "
    "ends AS (SELECT doc_id, n - 1 AS line_no, CASE WHEN n < m THEN line || chr(10) ELSE line END AS line FROM cut), "
    'lines AS (SELECT doc_id, line_no, line, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) - length(line) AS "start", CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS "end" FROM ends WHERE length(line) > 0)'
)


@query(f'WITH {_LINES} SELECT doc_id, line_no, "start", "end", md5(line) AS digest FROM lines')
def line_chunks_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "start", "end", F.md5(F.encode("line", "UTF-8")).alias("digest"))


@query(
    f'WITH {_FOUND}, {_LINES}, c AS (SELECT f.item_id, greatest(0, least(f.e, l."end") - greatest(f.s, l."start")) / CAST(greatest(1, f.e - f.s) AS DOUBLE) AS c FROM found f JOIN lines l ON f.doc_id = l.doc_id), '
    "best AS (SELECT item_id, max(c) AS best FROM c GROUP BY 1) SELECT item_id, best, CASE WHEN best >= 0.6 THEN 'captured' WHEN best >= 0.2 THEN 'partial' ELSE 'missed' END AS status FROM best"
)
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each located passage its best single line covers."""
    gold = found(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").join(gold.select("doc_id"), "doc_id", "left_semi")
    return grounding.best_coverage(gold, chunkers.lines(docs))


@query(
    f'WITH {_FOUND}, {_LINES}, c AS (SELECT l.doc_id, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.doc_id = l.doc_id AND l."start" <= f.s AND f.e <= l."end") THEN 1 '
    f"WHEN l.line_no = 2 THEN 2 WHEN trim(l.line, chr(10) || ' ') = '' OR starts_with(l.line, '#') OR NOT {duck.m('l.line', lex.COVERAGE_CUE)} THEN 3 ELSE 4 END AS k FROM lines l) "
    "SELECT count(*) AS total, count(*) FILTER (WHERE k = 1) AS covered_by_req, count(*) FILTER (WHERE k = 2) AS covered_by_openq, count(*) FILTER (WHERE k = 3) AS expected_nonrequirement, count(*) FILTER (WHERE k = 4) AS possible_miss, "
    "100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE k = 4)) / count(*) AS accounted_pct FROM c"
)
def chunk_coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents by class: holding a passage, at an open item's place (line 2), expectedly empty, missed."""
    docs = table(spark, sf_dir, "documents")
    chunks = chunkers.lines(docs).select("doc_id", F.col("line_no").alias("idx"), F.col("line").alias("text"), F.col("line_no").cast("string").alias("location"), "start", "end")
    items = docs.select("doc_id", F.lit("2").alias("location"))
    return grounding.coverage_counts(grounding.chunk_classes(chunks, found(spark, sf_dir), items))


@query(f'WITH {_FOUND}, {_LINES} SELECT f.item_id, f.doc_id, l.line_no, greatest(0, least(f.e, l."end") - greatest(f.s, l."start")) / CAST(greatest(f.e, l."end") - least(f.s, l."start") AS DOUBLE) AS iou FROM found f JOIN lines l ON f.doc_id = l.doc_id AND l."start" < f.e AND f.s < l."end"')
def span_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = found(spark, sf_dir).select("item_id", "doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    lines = chunkers.lines(table(spark, sf_dir, "documents").join(gold.select("doc_id"), "doc_id", "left_semi"))
    pairs = grounding.overlapping(gold, lines, ["doc_id"])
    return pairs.select("item_id", "doc_id", "line_no", nu.iou(F.col("s"), F.col("e"), F.col("start"), F.col("end")).alias("iou"))


@query("SELECT conv_id AS doc_id, turn - min(turn) OVER (PARTITION BY conv_id) AS idx, upper(substr(role, 1, 1)) || substr(role, 2) AS location, "
       "CAST(coalesce(sum(length(role) + length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"start\" FROM conversations")  # fmt: skip
def transcript_turn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered as transcripts and cut back into speaker turns."""
    said = F.concat(F.initcap("role"), F.lit(": "), "text", F.lit("\n"))
    docs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))), lambda x: x["said"]), "").alias("text"))
    return chunkers.chunk(docs.withColumn("source_type", F.lit("transcript"))).select("doc_id", F.col("idx").cast("long").alias("idx"), "location", F.col("start").cast("long").alias("start"))


@query()
def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headings and paragraphs of pages, in order, as Markdown; paragraphs with their heading trail."""
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("brd").alias("source_type"), corpus.html_markdown(F.col("html")).alias("text"))
    return chunkers.chunk(docs).filter("not startswith(text, '#')").select("doc_id", "location", "start", "end")


_ITEM = "'{\"id\": ' || CAST(event_id AS STRING) || ', \"type\": \"' || event_type || '\", \"props\": ' || coalesce(props, 'null') || '}'"


@query(
    "WITH i AS (SELECT user_id AS doc_id, event_id, length(" + _ITEM + ") AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, sum(length(" + _ITEM + ") + 2) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM events) "
    "SELECT doc_id, k - 1 AS idx, CASE WHEN event_id <> 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS location, CAST(upto - n - 1 AS BIGINT) AS \"start\", CAST(upto - 1 AS BIGINT) AS \"end\" FROM i"
)
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as one JSON array, cut back into its objects, named by their id (0 says nothing)."""
    item = F.struct("event_id", F.expr(_ITEM).alias("text"))
    docs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), ", ").alias("text"))
    docs = docs.select("doc_id", F.lit("jira").alias("source_type"), F.concat(F.lit("["), "text", F.lit("]")).alias("text"))
    return chunkers.chunk(docs).select("doc_id", F.col("idx").cast("long").alias("idx"), "location", "start", "end")


@query("SELECT doc_id, 0 AS idx, 0 AS \"start\", length(text) AS \"end\" FROM documents WHERE regexp_matches(text, '\\S')")
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("note").alias("source_type"), "text")
    return chunkers.chunk(docs).select("doc_id", "idx", "start", "end")


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'form' WHEN 1 THEN 'jira' WHEN 2 THEN 'email' WHEN 3 THEN 'brd' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown' ELSE 'legacy' END AS ingest, CASE p_partkey % 7 WHEN 0 THEN 'form' WHEN 1 THEN 'jira' WHEN 2 THEN 'email' ELSE 'brd' END AS upload FROM part")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared type, else by extension, else the entry point's default."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("a.csv", "b.JSON", "c.eml", "d.docx", "e.md", "f", "g.csv")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    declared = F.when(F.col("p_partkey") % 7 == 6, "legacy")
    upload = F.when(F.col("p_partkey") % 7 == 6, "brd").otherwise(corpus.upload_type(ext))
    return table(spark, sf_dir, "part").select("p_partkey", corpus.ingest_type(declared, ext).alias("ingest"), upload.alias("upload"))


# --- numbering and reports ---

_IDS = (
    f"WITH a AS (SELECT *, {duck.feature('feature')} AS bucket FROM rv WHERE status = 'approved'), "
    f"k AS (SELECT *, CASE WHEN rtype = 'functional' THEN min(id) OVER (PARTITION BY project_id, rtype, bucket) WHEN rtype = 'non_functional' THEN {duck.nfr_section('nfr_category')} END AS key FROM a), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY project_id, rtype ORDER BY key, id) AS n FROM k), "
    "ids AS (SELECT *, CASE rtype WHEN 'functional' THEN 'REQ-' || CAST(n AS VARCHAR) WHEN 'non_functional' THEN 'NFR-' || CAST(n AS VARCHAR) WHEN 'business' THEN 'BR-' || CAST(n AS VARCHAR) END AS srs_id FROM n), "
    f"rtm AS (SELECT *, {duck.section('rtype', 'feature', 'nfr_category')} AS section, row_number() OVER (PARTITION BY project_id ORDER BY CASE rtype WHEN 'functional' THEN 0 WHEN 'non_functional' THEN 1 WHEN 'business' THEN 2 ELSE 3 END, CASE WHEN srs_id IS NULL THEN 0 ELSE n END, id) AS pos FROM ids) "
)


@query(_IDS + "SELECT project_id, id, srs_id FROM ids", view=True)
def srs_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.srs_ids(req_view(spark, sf_dir)).select("project_id", "id", "srs_id")


@query(_IDS + "SELECT project_id, pos, id, srs_id, section, CASE WHEN location = '' THEN doc_id ELSE doc_id || ' §' || location END AS sources, '\"' || statement || '\"' AS evidence FROM rtm", view=True)
def rtm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.rtm_rows(req_view(spark, sf_dir)).select("project_id", "pos", "id", "srs_id", "section", "sources", "evidence")


_MATRIX = (
    _IDS + ", m AS (SELECT project_id, coalesce(srs_id, CASE rtype WHEN 'constraint' THEN 'CON-' ELSE 'ASM-' END || CAST(row_number() OVER (PARTITION BY project_id, rtype ORDER BY pos) AS VARCHAR)) AS row_id, "
    "CASE rtype " + " ".join(f"WHEN {duck.q(k)} THEN {duck.q(v)}" for k, v in lex.CATEGORY_LABELS.items()) + " END AS category, section, statement AS requirement FROM rtm), "
    + GLOSSARY_SQL + ", "
    "x AS (SELECT * FROM m UNION ALL SELECT project_id, id, 'Glossary', 'Appendix A', term || ' — ' || definition FROM g) "
)


@query(_MATRIX + "SELECT * FROM x", view=True)
def rtm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = req_view(spark, sf_dir)
    return reporting.rtm_matrix(reqs, glossary(reporting.approved(reqs)))


@query(_MATRIX + "SELECT project_id, " + ", ".join(f"count(*) FILTER (WHERE starts_with(row_id, '{p}-')) AS {p.lower()}" for p in ("REQ", "NFR", "BR", "CON", "ASM")) + ", count(*) AS total FROM x GROUP BY 1", view=True)
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.manifest_counts(rtm_matrix(spark, sf_dir))


@query("SELECT project_id, id FROM rv WHERE status = 'approved' AND idx % 10 = 3", view=True)
def traceability_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved requirements that a matrix with every tenth row lost does not hold."""
    reqs = req_view(spark, sf_dir)
    return reporting.traceability_gaps(reqs, reporting.rtm_rows(reqs).filter("idx % 10 <> 3"))


def open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items of the view: scope-marked rows, inferred rows and pointers."""
    s = F.col("statement")
    kind = F.coalesce(F.col("scope.flag"), F.when(cl.is_pointer(s), "non_requirement"), F.when(F.col("inferred"), "inferred"))
    rows = req_view(spark, sf_dir).withColumn("scope", cl.scope_flag(s)).withColumn("kind", kind)
    rows = rows.select("project_id", "idx", "kind", "statement", "doc_id", F.col("location").alias("where"), F.col("scope.reason").alias("reason"))
    # written before it is filtered, or the filter's patterns would be matched below the view's shuffle, in the few tasks that read its file
    return Scratch(spark, "open").write(rows, "rows").filter("kind is not null")


def _is_caution():
    """Whether a row of the view carries a scope marker."""
    return F.coalesce(cl.scope_flag(F.col("statement"))["flag"].isin(*lex.SCOPE_KINDS), F.lit(False))


_OPEN = (
    f"WITH o AS (SELECT project_id, idx, coalesce({duck.scope('statement', 'flag')}, CASE WHEN {duck.pointer('statement')} THEN 'non_requirement' END, CASE WHEN inferred THEN 'inferred' END) AS kind, statement, location, {duck.scope('statement', 'reason')} AS reason, {duck.norm('statement')} AS norm FROM rv), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, kind, norm ORDER BY idx) AS k FROM o WHERE kind IS NOT NULL) t WHERE k = 1), "
    "t AS (SELECT f.*, k2.tier, k2.ord, k2.label FROM f JOIN (VALUES " + ", ".join(f"({duck.q(k)}, '{t}', {o}, {duck.q(label)})" for k, t, o, _, label in lex.OPEN_KINDS) + ") k2(kind, tier, ord, label) ON f.kind = k2.kind), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY project_id, tier = 'C' ORDER BY tier, ord, norm, idx) AS n FROM t), "
    "items AS (SELECT project_id, CASE WHEN tier = 'C' THEN 'NOTE-' ELSE 'TBD-' END || CAST(n AS VARCHAR) AS id, kind, tier, n, label || ': \"' || trim(statement) || '\"' || CASE WHEN location <> '' THEN ' (from ' || location || ')' ELSE '' END || ' — ' || coalesce(reason, label) AS description FROM n) "
)


@query(_OPEN + "SELECT project_id, id, kind, tier, description FROM items", view=True)
def open_items_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.open_items(open_rows(spark, sf_dir)).drop("n")


@query(_OPEN + "SELECT project_id, id, kind, tier, description, overflow FROM (SELECT *, greatest(0, count(*) OVER (PARTITION BY project_id) - 5) AS overflow FROM items WHERE tier IN ('A', 'B')) z WHERE n <= 5", view=True)
def open_items_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.appendix(reporting.open_items(open_rows(spark, sf_dir)))


@query(f"SELECT project_id, bucket, CASE min(CASE p WHEN 'must' THEN 0 WHEN 'should' THEN 1 ELSE 2 END) WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS priority FROM (SELECT project_id, {duck.feature('feature')} AS bucket, {duck.priority('statement', 'rtype', 'inferred')} AS p FROM rv WHERE rtype = 'functional') t GROUP BY 1, 2", view=True)
def feature_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.feature_priority(assessed(req_view(spark, sf_dir)))


# --- overlaps, decisions ---

def _overlapping(rows: DataFrame, terms, threshold: float) -> DataFrame:
    """(project_id, a, b, overlap) of pairs of a project whose term sets' Jaccard reaches the threshold."""
    return overlap_pairs(rows.select("project_id", "idx", terms.alias("terms")), threshold)


def _overlap_sql(expr: str, threshold: float) -> str:
    return (
        f"SELECT project_id, a, b, c / CAST(na + nb - c AS DOUBLE) AS overlap FROM (SELECT a.project_id, a.idx AS a, b.idx AS b, len(a.t) AS na, len(b.t) AS nb, len(list_intersect(a.t, b.t)) AS c "
        f"FROM (SELECT project_id, idx, {expr} AS t FROM rv) a JOIN (SELECT project_id, idx, {expr} AS t FROM rv) b ON a.project_id = b.project_id AND a.idx < b.idx) z WHERE c > 0 AND c / CAST(na + nb - c AS DOUBLE) >= {threshold}"
    )


@query(_overlap_sql(duck.kept("regexp_extract_all(lower(statement), '[a-z0-9]+')", 2, lex.TOPIC_STOP), 0.5), view=True)
def topic_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlapping(req_view(spark, sf_dir), tx.topic_terms(F.col("statement")), 0.5)


@query(_overlap_sql(f"list_distinct(string_split({duck.norm('statement')}, ' '))", 0.5), view=True)
def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlapping(req_view(spark, sf_dir), tx.word_set(F.col("statement")), 0.5)


@query(
    f"WITH p AS (SELECT project_id, idx, {duck.m('statement', lex.NEGATION)} AS neg, {duck.toks('statement')} AS tok, {duck.kept(duck.toks('statement'), 2, lex.TOPIC_STOP)} AS t FROM rv) "
    f"SELECT a.project_id, a.idx AS a, b.idx AS b FROM p a JOIN p b ON a.project_id = b.project_id AND a.idx < b.idx WHERE len(list_intersect(a.t, b.t)) / CAST(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS DOUBLE) >= 0.5 AND {duck.opposite('a.neg', 'a.tok', 'b.neg', 'b.tok')}",
    view=True,
)
def polarity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opposite pairs among statements of the same topic."""
    return similarity.opposite_pairs(req_view(spark, sf_dir), 0.5)


_TERMS = duck.kept(duck.toks("statement"), 4, lex.DECISION_STOP)


@query(
    f"WITH e AS (SELECT project_id, id, idx, unnest({_TERMS}) AS term FROM rv), n AS (SELECT project_id, count(*) AS n FROM rv GROUP BY 1), "
    "r AS (SELECT e.project_id, term FROM e JOIN n USING (project_id) GROUP BY 1, 2, n.n HAVING count(*) <= greatest(3, n.n // 12)) "
    "SELECT DISTINCT a.project_id, a.id AS decision_id, b.id FROM e a JOIN r USING (project_id, term) JOIN e b USING (project_id, term) WHERE a.id IN (SELECT id FROM rv WHERE " + duck.scope("statement", "flag") + " IN (" + ", ".join(duck.q(k) for k in lex.SCOPE_KINDS) + "))",
    view=True,
)
def affected_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that each scope decision reaches through a rare distinctive term."""
    reqs = req_view(spark, sf_dir)
    return de.affected(reqs.filter(_is_caution()).withColumnRenamed("id", "decision_id"), reqs)


@query(
    "SELECT DISTINCT p.project_id, p.a, p.b, CASE WHEN length(x.statement) >= length(y.statement) THEN 'Keep A' ELSE 'Keep B' END AS recommended "
    "FROM (SELECT project_id, least(id, twin) AS a, greatest(id, twin) AS b FROM rv WHERE twin IS NOT NULL) p JOIN rv x ON x.project_id = p.project_id AND x.id = p.a JOIN rv y ON y.project_id = p.project_id AND y.id = p.b",
    view=True,
)
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.conflict_pairs(req_view(spark, sf_dir))


_DEC = (
    f"WITH o AS (SELECT project_id, {duck.scope('statement', 'flag')} AS kind, statement FROM rv), d AS (SELECT o.project_id, o.kind, CASE WHEN {duck.m('statement', lex.ALTERNATIVES)} THEN 'Value/approach: ' ELSE 'Scope: ' END || trim(statement) AS question, v.rec AS recommended, "
    f"{duck.rules('lower(statement)', lex.OWNERS, duck.q(lex.OWNER_DEFAULT))} AS owner, 'attention' AS tier FROM o JOIN (VALUES " + ", ".join(f"({duck.q(k)}, {duck.q(v)})" for k, v, _ in lex.VERDICTS) + ") v(kind, rec) ON o.kind = v.kind) "
)


def _scope_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.scope_decisions(open_rows(spark, sf_dir).filter(F.col("kind").isin(*lex.SCOPE_KINDS)))


@query(_DEC + f"SELECT project_id, kind, question, recommended, owner, tier, 'DEC-' || substr(sha1({duck.norm('question')}), 1, 8) AS decision_id FROM d", view=True)
def scope_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scope_decisions(spark, sf_dir).drop("options")


@query(_DEC + "SELECT 'owner' AS facet, owner AS value, count(*) AS n FROM d GROUP BY owner UNION ALL SELECT 'tier', tier, count(*) FROM d GROUP BY tier", view=True)
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.summary(_scope_decisions(spark, sf_dir))


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The view with its twins as conflicts, and the decisions on it and on its open items, gaps among them."""
    reqs = req_view(spark, sf_dir).withColumn("conflicts_with", F.when(F.col("twin").isNull(), F.array().cast("array<string>")).otherwise(F.array("twin")))
    gaps = grounding.coverage_gaps(reqs).select("project_id", F.xxhash64("aspect").alias("idx"), F.lit("gap").alias("kind"), "statement", "reason")
    items = open_rows(spark, sf_dir).select("project_id", F.col("idx").cast("long").alias("idx"), "kind", "statement", "reason")
    return reqs, de.decision_list(reqs, items.unionByName(gaps))


@query(_DEC + f"SELECT project_id, kind, question, decision_id FROM (SELECT *, 'DEC-' || substr(sha1({duck.norm('question')}), 1, 8) AS decision_id FROM d) t WHERE owner = 'CX / Operations' AND substr(decision_id, 5, 1) >= '8'", view=True)
def open_decisions_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of one owner that are still open, where those with a low first digit were resolved."""
    every = _scope_decisions(spark, sf_dir)
    done = every.filter(F.substring("decision_id", 5, 1) < "8").select("project_id", "decision_id", F.lit(1).alias("seq"), F.lit("accept").alias("action"))
    return de.with_resolution(every, done).filter(~F.col("resolved") & (F.col("owner") == "CX / Operations")).select("project_id", "kind", "question", "decision_id")


def offered_rewrites(reqs: DataFrame) -> DataFrame:
    """A rewrite for every row: another modal, close wording, another subject, a negation, in turn."""
    text = "CASE idx % 4 WHEN 0 THEN replace(replace(statement, 'shall', 'should'), 'must', 'may') WHEN 1 THEN replace(statement, 'the ', 'each ') WHEN 2 THEN 'Something else entirely shall hold.' ELSE replace(statement, ' shall ', ' shall not ') END AS rewrite"
    return reqs.selectExpr("project_id", "idx", text)


@query()
def adopted_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements after cosmetic fixes and those rewrites that keep the meaning."""
    reqs = req_view(spark, sf_dir)
    return de.adopt_rewrites(reqs.select("project_id", "idx", "id", "statement"), offered_rewrites(reqs))


@query()
def decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions of every project in their order, with evidence and what they affect."""
    return _decided(spark, sf_dir)[1]


@query()
def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying every open recommendation does to requirements, where decisions by Compliance / Legal were resolved before."""
    reqs, decisions = _decided(spark, sf_dir)
    return de.apply_recommended(decisions, reqs, decisions.filter(F.startswith("owner", F.lit("Compliance"))))[0]


# --- review log ---

_LOG = (
    "WITH log AS (SELECT * FROM (SELECT event_id AS seq, user_id AS requirement_id, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' END AS action, "
    "CASE WHEN value < 10 THEN 'auto-approve' ELSE 'reviewer' END AS actor, ts, props FROM events) e WHERE action IS NOT NULL) "
)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_log(table(spark, sf_dir, "events"))


@query(_LOG + "SELECT requirement_id, CASE WHEN arg_max(action, seq) = 'reject' THEN 'rejected' ELSE 'approved' END AS status, count(*) AS n FROM log GROUP BY 1")
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fold_status(_log(spark, sf_dir))


@query(_LOG + "SELECT requirement_id, action, actor, seq FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY seq DESC) AS n FROM log) t WHERE n = 1")
def last_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest(_log(spark, sf_dir), ["requirement_id"]).select("requirement_id", "action", "actor", "seq")


@query(_LOG + "SELECT a AS accepts, e AS edits, r AS rejects, a + e + r AS decisions, a / CAST(a + e + r AS DOUBLE) AS accept_rate, e / CAST(a + e + r AS DOUBLE) AS edit_rate, r / CAST(a + e + r AS DOUBLE) AS reject_rate FROM (SELECT count(*) FILTER (WHERE action = 'accept') AS a, count(*) FILTER (WHERE action = 'edit') AS e, count(*) FILTER (WHERE action = 'reject') AS r FROM log) t")
def decision_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_rates(_log(spark, sf_dir))


_CAL = (
    _LOG + ", last AS (SELECT requirement_id, arg_max(action, seq) AS action FROM log WHERE actor <> 'auto-approve' GROUP BY 1), r AS (SELECT DISTINCT user_id AS requirement_id, user_id % 7 AS project_id, (user_id % 21) / CAST(20 AS DOUBLE) AS confidence FROM events), "
    "bands AS (SELECT p.project_id, b.band, b.low, count(action) FILTER (WHERE action = 'accept') AS accepted, count(action) AS decided FROM (SELECT DISTINCT project_id FROM r) p CROSS JOIN (VALUES " + ", ".join(f"({duck.q(n)}, {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in lex.BANDS) + ") b(band, low, high) "
    "LEFT JOIN (SELECT * FROM r JOIN last USING (requirement_id)) x ON x.project_id = p.project_id AND x.confidence >= b.low AND x.confidence < b.high GROUP BY 1, 2, 3) "
)


def _confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as requirements of seven projects, with a confidence each."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(user.alias("requirement_id"), (user % 7).alias("project_id"), ((user % 21) / F.lit(20.0)).alias("confidence")).distinct()


@query(_CAL + "SELECT project_id, band, low, accepted, decided, CASE WHEN decided > 0 THEN accepted / CAST(decided AS DOUBLE) END AS rate FROM bands")
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.calibration(_confidences(spark, sf_dir), _log(spark, sf_dir))


@query(_CAL + "SELECT project_id, coalesce(min(low) FILTER (WHERE decided >= 10 AND accepted / CAST(decided AS DOUBLE) >= 0.97), CAST(0.9 AS DOUBLE)) AS bar FROM bands GROUP BY 1")
def suggested_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.suggested_bar(review.calibration(_confidences(spark, sf_dir), _log(spark, sf_dir)))


@query("SELECT project_id, id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS n FROM rv WHERE status = 'approved') t WHERE (n - 1) % 20 = 0", view=True)
def spot_check_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth approved requirement of each project, for a second look."""
    return review.spot_check(req_view(spark, sf_dir).filter("status = 'approved'").select("project_id", "id"), 0.05)


@query("SELECT user_id AS project_id, CAST(json_extract_string(arg_max(props, event_id), '$.k') AS BIGINT) AS k, max(event_id) AS seq FROM events GROUP BY 1")
def latest_run_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of each project's last run of any agent."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), "props")
    last = runs.groupBy("project_id").agg(F.max_by("props", "seq").alias("props"), F.max("seq").alias("seq"))
    return last.select("project_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "seq")


@query("SELECT project_id, decision_id, action, seq FROM (SELECT user_id % 50 AS project_id, event_type AS decision_id, props AS action, event_id AS seq, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY event_id DESC) AS n FROM events) t WHERE n = 1")
def resolution_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions keyed by (project, decision): a later one replaces."""
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("project_id"), F.col("event_type").alias("decision_id"), F.col("props").alias("action"), F.col("event_id").alias("seq"))
    return review.latest(log, ["project_id", "decision_id"])


@query("SELECT sum(CASE WHEN s = 'captured' THEN 1.0::DOUBLE WHEN s = 'partial' THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS recall, count(*) AS n, source FROM (SELECT source, CASE WHEN n_chars >= 1000 THEN 'captured' WHEN n_chars >= 300 THEN 'partial' ELSE 'missed' END AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 1) t GROUP BY source")
def label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with partial credit by group, on labelled documents."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")
    return grounding.recall(rows.withColumn("status", F.when(F.col("n_chars") >= 1000, "captured").when(F.col("n_chars") >= 300, "partial").otherwise("missed")), "source")


@query("SELECT count(*) FILTER (WHERE p AND quality = 1) / CAST(count(*) FILTER (WHERE p) AS DOUBLE) AS \"precision\", count(*) FILTER (WHERE p AND quality = 1) / CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS recall, count(*) AS n FROM (SELECT quality, n_chars >= 1000 AS p FROM documents JOIN labels USING (doc_id)) t")
def label_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("quality", (F.col("n_chars") >= 1000).alias("p"))
    hit = F.count_if(F.col("p") & (F.col("quality") == 1))
    return rows.agg(F.try_divide(hit, F.count_if("p")).alias("precision"), F.try_divide(hit, F.count_if(F.col("quality") == 1)).alias("recall"), F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'pending_human_baseline' WHEN t >= 0.9 * h AND m <= 30 THEN 'pass' WHEN t >= 0.75 * (0.9 * h) THEN 'marginal' ELSE 'fail' END AS verdict FROM (SELECT p_partkey, p_size, (p_partkey % 100) / CAST(100 AS DOUBLE) AS t, (p_size % 50) / CAST(50 AS DOUBLE) AS h, p_size AS m FROM part) x")
def go_no_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    verdict = nu.go_no_go((F.col("p_partkey") % 100) / F.lit(100.0), (F.col("p_size") % 50) / F.lit(50.0), F.col("p_size"), F.lit(30), F.col("p_size") % 5 == 0)
    return p.select("p_partkey", verdict.alias("verdict"))


_RAMP = [(h, i, c) for h, cs in lex.RAMPS.items() for i, c in enumerate(cs)]


def _lum(c: str) -> str:
    ch = lambda i: f"(CASE WHEN v{i} <= 0.03928 THEN v{i} / 12.92 ELSE pow((v{i} + 0.055) / 1.055, 2.4) END)"
    return f"0.2126 * {ch(1)} + 0.7152 * {ch(2)} + 0.0722 * {ch(3)}"


_CONTRAST = (
    "WITH r AS (SELECT hue, step, hex, " + ", ".join(f"CAST(CAST('0x' || substr(hex, {2 * i - 1}, 2) AS BIGINT) AS DOUBLE) / 255.0 AS v{i}" for i in (1, 2, 3)) + " FROM (VALUES " + ", ".join(f"('{h}', {i}, '{c}')" for h, i, c in _RAMP) + ") v(hue, step, hex)), "
    "person AS (SELECT project_id, split_part(CASE " + " ".join(f"WHEN bool_or({duck.has_any('s', keys)}) THEN {duck.q(a + '/' + b)}" for keys, a, b, _ in lex.DOMAIN_HUES)
    + f" ELSE '{'/'.join(lex.HUE_DEFAULT)}' END, '/', 1) AS hue FROM (SELECT project_id, lower(project_id || ' ' || statement) AS s FROM rv WHERE status = 'approved') t GROUP BY 1), "
    f"c AS (SELECT project_id, hue, step, hex, 1.05::DOUBLE / ({_lum('hex')} + 0.05) AS ratio FROM person JOIN r USING (hue)) "
)


def _ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each project's primary hue with their contrast on white."""
    steps = F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(i).alias("step"), F.lit(c).alias("hex")) for h, i, c in _RAMP]))
    person = design.personality(reporting.approved(req_view(spark, sf_dir)))
    rows = person.select("project_id", F.col("primary").alias("hue"), steps).filter("h = hue").drop("h")
    return rows.withColumn("ratio", nu.contrast(F.col("hex"), F.lit("ffffff")))


@query(_CONTRAST + "SELECT project_id, hue, step, hex, round(ratio, 6) AS ratio, ratio >= 4.5 AS aa FROM c", view=True)
def contrast_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ramp(spark, sf_dir).withColumn("aa", F.col("ratio") >= 4.5).withColumn("ratio", F.round("ratio", 6))


@query(_CONTRAST + "SELECT project_id, hue, coalesce(arg_min(hex, step) FILTER (WHERE ratio >= 3.0), arg_max(hex, step)) AS hex FROM c GROUP BY 1, 2", view=True)
def first_passing_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First step of a project's hue that passes on white, else the last."""
    passes = F.col("ratio") >= 3.0
    return _ramp(spark, sf_dir).groupBy("project_id", "hue").agg(F.coalesce(F.min_by(F.when(passes, F.col("hex")), F.when(passes, F.col("step"))), F.max_by("hex", "step")).alias("hex"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS component FROM (SELECT *, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) t WHERE n > 1")
def exact_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph that links each document to the first of equal text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    edges = docs.join(first, "h").filter("doc_id <> first").select("doc_id", "first")
    return connected_components(edges, "doc_id", "first").select(F.col("node").alias("doc_id"), "component")


@query("SELECT DISTINCT missing FROM (SELECT twin AS missing FROM rv WHERE twin IS NOT NULL) t WHERE missing NOT IN (SELECT id FROM rv WHERE status = 'approved')", view=True)
def referential_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict partners that are not among the approved requirements."""
    from lodestar.sources.store import orphans

    reqs = req_view(spark, sf_dir)
    return orphans(reqs.filter("twin is not null").select(F.col("twin").alias("missing")).distinct(), reporting.approved(reqs), "missing", "id")


@query("SELECT source_type, rtype, count(*) AS n, count(DISTINCT project_id) AS projects FROM rv GROUP BY 1, 2", view=True)
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req_view(spark, sf_dir).groupBy("source_type", "rtype").agg(F.count("*").alias("n"), F.count_distinct("project_id").alias("projects"))


@query("SELECT project_id, rtype, n, features FROM (SELECT project_id, rtype, count(*) AS n, count(DISTINCT feature) AS features, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, min(idx)) AS k FROM rv GROUP BY 1, 2) t WHERE k <= 3", view=True)
def type_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent types of each project, the first seen among equals (the cap is the feature)."""
    n = req_view(spark, sf_dir).groupBy("project_id", "rtype").agg(F.count("*").alias("n"), F.count_distinct("feature").alias("features"), F.min("idx").alias("first"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("n"), "first"))).filter("k <= 3").drop("k", "first")


@query("SELECT CAST(sum(CAST(round(confidence * 10) AS BIGINT)) AS BIGINT) / CAST(10 * count(*) AS DOUBLE) AS mean_confidence, count(*) FILTER (WHERE confidence < 0.5) AS low, count(DISTINCT doc_id) AS documents, project_id FROM rv GROUP BY project_id", view=True)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenths = F.sum(F.round(F.col("confidence") * 10).cast("long"))  # summed as integers, so that the order of rows does not show
    return req_view(spark, sf_dir).groupBy("project_id").agg((tenths / (F.count("*") * 10)).alias("mean_confidence"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_distinct("doc_id").alias("documents"))


@query("SELECT count(*) FILTER (WHERE n > 1) / CAST(count(*) AS DOUBLE) AS hit_ratio, count(*) AS calls FROM (SELECT row_number() OVER (PARTITION BY sha256(event_type || chr(0) || props) ORDER BY event_id) AS n FROM events) t")
def cache_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of judgements that an earlier one with the same key answers."""
    keyed = table(spark, sf_dir, "events").select(tx.cache_key(F.col("event_type"), F.col("props")).alias("k"))
    n = keyed.groupBy("k").agg(F.count("*").alias("n"))
    return n.agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("hit_ratio"), F.sum("n").alias("calls"))


@query(ORACLES["review_state"])
def streaming_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state, folded from the events as a stream of files."""
    from lodestar.runtime import Scratch
    from lodestar.streaming.ingest import fold_reviews

    path = f"{sf_dir}/events.parquet"
    return fold_reviews(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema, Scratch(spark, "reviews").root)


_EDITS = "CASE k % 5 WHEN 0 THEN to_json(struct(concat('Text ', seq) AS statement)) WHEN 1 THEN '{\"priority\": \"must\", \"feature\": null}' WHEN 2 THEN '{\"rtype\": \"odd\"}' WHEN 3 THEN '{\"statement\": \" \"}' WHEN 4 THEN to_json(struct(concat('F', k) AS feature, 'r' AS rationale)) END"
_ACTION = "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' ELSE event_type END"


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as requirements, nine in ten of them known, and every event as a review event, clicks with edits of five kinds."""
    events = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    user = F.col("user_id")
    reqs = events.select("user_id").distinct().filter(user % 10 != 9).select(
        user.cast("string").alias("requirement_id"), F.concat(F.lit("Requirement "), user.cast("string")).alias("statement"), F.lit("functional").alias("rtype"),
        none.alias("nfr_category"), none.alias("feature"), none.alias("priority"), none.alias("rationale"), F.lit("candidate").alias("status"),
    )
    log = events.selectExpr("CAST(user_id AS STRING) AS requirement_id", "event_id AS seq", f"{_ACTION} AS action", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "ts")
    return reqs, log.selectExpr("requirement_id", "seq", "action", f"CASE WHEN action = 'edit' THEN {_EDITS} END AS edits", "'reviewer' AS actor", "CAST(ts AS TIMESTAMP) AS ts")


_MACHINE = (
    f"WITH e AS (SELECT user_id, event_id AS seq, {_ACTION} AS action, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), "
    "g AS (SELECT *, action IN ('accept', 'reject') OR (action = 'edit' AND coalesce(k % 5, 0) NOT IN (2, 3)) AS ok FROM e WHERE user_id % 10 <> 9) "
    "SELECT CAST(user_id AS VARCHAR) AS requirement_id, coalesce(arg_max('Text ' || CAST(seq AS VARCHAR), seq) FILTER (WHERE ok AND action = 'edit' AND k % 5 = 0), 'Requirement ' || CAST(user_id AS VARCHAR)) AS statement, "
    "CASE WHEN count(*) FILTER (WHERE ok AND action = 'edit' AND k % 5 = 1) > 0 THEN 'must' END AS priority, arg_max('F' || CAST(k AS VARCHAR), seq) FILTER (WHERE ok AND action = 'edit' AND k % 5 = 4) AS feature, "
    "coalesce(arg_max(CASE action WHEN 'reject' THEN 'rejected' ELSE 'approved' END, seq) FILTER (WHERE ok), 'candidate') AS status, count(*) FILTER (WHERE ok) AS decisions, count(*) FILTER (WHERE NOT ok) AS refused FROM g GROUP BY user_id"
)
_STATE = ("requirement_id", "statement", "priority", "feature", "status", "decisions", "refused")


@query(_MACHINE)
def review_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements after all review events, edits included; events without effect are counted apart."""
    reqs, log = _reviewed(spark, sf_dir)
    return reviews.current(reqs, reviews.decide(reqs, log)).select(*_STATE)


#: Events in a file of a stream's part, about.
FILE_EVENTS = 250_000


@query(_MACHINE)
def streaming_review_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in four parts, a batch each, with a stop and a restart half way; a requirement's events of a part are in one of its files."""
    reqs, log = _reviewed(spark, sf_dir)
    scratch = Scratch(spark, "machine")
    low, high, n = log.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    low, files = low or 0, 1 + n // (4 * FILE_EVENTS)
    step = ((high or 0) - low) // 4 + 1
    done = None
    for k in range(4):
        part = log.filter((F.col("seq") >= low + k * step) & (F.col("seq") < low + (k + 1) * step))
        part.repartition(files, "requirement_id").write.mode("append").parquet(scratch.path("in"))
        if k % 2:
            arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(scratch.path("in"))
            done = reviews.stream_decisions(reqs, arriving, scratch.path("out"))
    return reviews.current(reqs, done).select(*_STATE)


@query(_LOG + "SELECT date_trunc('hour', ts) AS \"start\", action, count(*) AS n FROM log GROUP BY 1, 2")
def decisions_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.streaming.ingest import windowed_decisions

    return windowed_decisions(table(spark, sf_dir, "events"))


@query(
    f"SELECT id, project_id, statement, status, {duck.owner('statement', 'feature', 'rtype', 'nfr_category')} AS owner, {duck.level(duck.triage_score('statement'))} AS level, {duck.priority('statement', 'rtype', 'inferred')} AS priority, "
    "CASE WHEN location = '' THEN doc_id ELSE doc_id || ' §' || location END AS sources FROM rv WHERE status IN ('candidate', 'needs_review')",
    view=True,
)
def pending_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review list: pending rows with owner, triage, priority and sources."""
    rows = assessed(req_view(spark, sf_dir)).filter(F.col("status").isin(*lex.PENDING))
    owner = cl.owner(F.col("statement"), F.col("feature"), F.col("rtype"), F.col("nfr_category"))
    sources = F.when(F.col("location") == "", F.col("doc_id")).otherwise(F.concat_ws(" §", "doc_id", "location"))
    return rows.select("id", "project_id", "statement", "status", owner.alias("owner"), F.col("triage.level").alias("level"), "priority", sources.alias("sources"))


_LAYER_SQL = "CASE " + " ".join(f"WHEN k = {duck.q(k)} THEN '{name}'" for k, name in lex.LAYER_OF.items()) + " " + " ".join(f"WHEN contains(k, '{w}') THEN '{n}'" for w, n in lex.LAYER_KEYWORDS) + f" ELSE '{lex.LAYER_DEFAULT}' END"
_ASPECT_KEYS = ["frontend", "my-api", "database", "payments", "OAuth", "devices", "cms", "hosting", "webhooks"]


_KEYS = ", ".join(f"'{k}'" for k in _ASPECT_KEYS)


@query(f"SELECT p_partkey, key, {_LAYER_SQL} AS layer FROM (SELECT *, lower(key) AS k FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 9 THEN p_type ELSE ([{_KEYS}])[p_size % 10 + 1] END AS key FROM part) u) t")
def technology_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of an aspect for every part; its size names the aspect, or its type where that is none."""
    n = F.col("p_size") % 10
    key = F.when(n == 9, F.col("p_type")).otherwise(F.get(F.array(*[F.lit(k) for k in _ASPECT_KEYS]), n.cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).withColumn("layer", document.layer(F.col("key")))


_ASPECT_SQL = "a AS (SELECT project_id, source_type AS key, 'Tool ' || CAST(idx % 7 AS VARCHAR) AS name, inferred AS recommended, idx AS pos FROM rv)"


def _aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view read as candidates: by project and kind of source, a tool a row."""
    return req_view(spark, sf_dir).select("project_id", F.col("source_type").alias("key"), F.concat(F.lit("Tool "), (F.col("idx") % 7).cast("string")).alias("name"), F.col("inferred").alias("recommended"), F.col("idx").alias("pos"))


@query(
    f"WITH {_ASPECT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY pos) AS n FROM a), "
    "k AS (SELECT *, coalesce(min(n) FILTER (WHERE recommended) OVER (PARTITION BY project_id, key), 1) AS lead FROM n WHERE n <= 3) SELECT project_id, key, name, n = lead AS recommended, pos FROM k",
    view=True,
)
def normalized_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.normalized_aspects(_aspects(spark, sf_dir))


@query(
    f"WITH {_ASPECT_SQL}, s AS (SELECT DISTINCT project_id, 'brd' AS key, 'TOOL 3' AS choice FROM rv UNION ALL SELECT DISTINCT project_id, 'form', ' HTMX ' FROM rv), "
    "d AS (SELECT project_id, key, first(name ORDER BY recommended DESC, pos) AS name FROM a GROUP BY 1, 2) "
    "SELECT d.project_id, d.key, coalesce((SELECT first(a.name ORDER BY pos) FROM a WHERE a.project_id = d.project_id AND a.key = d.key AND lower(a.name) = lower(s.choice)), trim(s.choice), d.name) AS name FROM d LEFT JOIN s USING (project_id, key)",
    view=True,
)
def adopted_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections by name in any case, custom names, and the recommended default, of every project."""
    chosen = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(c).alias("choice")) for k, c in (("brd", "TOOL 3"), ("form", " HTMX "))]))
    return reporting.adopted_stack(_aspects(spark, sf_dir), req_view(spark, sf_dir).select("project_id").distinct().select("project_id", chosen))


@query(
    _LOG.replace("WITH log", "WITH rq AS (SELECT *, idx % 150 AS rid FROM rv), log") + f"SELECT b.*, coalesce(d.decisions, 0) AS decisions, d.acceptance_rate FROM (SELECT project_id, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in lex.STATUSES)
    + f", count(*) FILTER (WHERE len({duck.flags('statement')}) > 0) AS flagged FROM rq GROUP BY 1) b LEFT JOIN (SELECT project_id, count(*) AS decisions, count(*) FILTER (WHERE action = 'accept') / CAST(count(*) AS DOUBLE) AS acceptance_rate FROM rq JOIN log ON rid = requirement_id GROUP BY 1) d ON b.project_id = d.project_id",
    view=True,
)
def exit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.plans.analysis import exit_metrics as metrics

    return metrics(assessed(req_view(spark, sf_dir)).withColumn("requirement_id", F.col("idx") % 150), _log(spark, sf_dir))


def specification_of(reqs: DataFrame, numbered_items: DataFrame) -> DataFrame:
    """(doc_id, text): the specification of every project of ``reqs`` with something approved."""
    from lodestar.plans.classify_queries import lexicon_hits

    described = lambda entries: F.create_map(*[F.lit(x) for name, _, d in entries for x in (name, d)])[F.col("name")].alias("description")
    roles = lexicon_hits(reqs, [r[:2] for r in lex.ROLES]).select("project_id", "rank", "name", described(lex.ROLES))
    faces = lexicon_hits(reqs, [r[:2] for r in lex.INTERFACES]).select("project_id", "rank", "name", described(lex.INTERFACES))
    blocks = document.sections(reqs, numbered_items, glossary(reporting.approved(reqs)), roles, faces, lexicon_hits(reqs, lex.ENTITIES))
    return document.assemble(blocks)


def _specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specification_of(req_view(spark, sf_dir), reporting.open_items(open_rows(spark, sf_dir)))


@query()
def specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One specification document per project, assembled from relations."""
    return _specification(spark, sf_dir)


@query("SELECT project_id AS doc_id, CASE WHEN count(*) FILTER (WHERE rtype = 'functional') = 0 THEN 1 ELSE 0 END AS violations FROM rv WHERE status = 'approved' GROUP BY 1", view=True)
def format_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken format checks of every generated document: only a project without a functional requirement has one."""
    docs = Scratch(spark, "specification").write(_specification(spark, sf_dir), "docs")
    n = document.violations(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("violations"))


@query()
def analysis_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over the view: (project_id, relation, kind, n) of what it leaves.

    Every row is a chunk of its document with its statement inside. Verdicts: every third requirement is doubted, all that resemble a
    caution are withdrawn, and one gap is suggested.
    """
    from lodestar.plans import analysis
    from lodestar.runtime import shared_dir
    from lodestar.sources.store import Store

    rows, at = req_view(spark, sf_dir), F.col("idx").cast("long") * 200
    reqs = rows.withColumn("start", at).withColumn("end", at + F.length("statement"))
    chunks = rows.select("project_id", "doc_id", F.col("idx").cast("int").alias("idx"), "location", F.col("statement").alias("text"), at.alias("start"), (at + 200).alias("end"))
    asked = analysis.Verdicts(
        verify=rows.select("project_id", "id", (F.col("idx") % 3 > 0).alias("holds"), F.lit(False).alias("open_decision")), reconcile=rows.select("project_id", F.col("idx").cast("long").alias("idx")),
        gaps=rows.select("project_id", F.lit("Offline use").alias("statement")).distinct(),
    )
    out = analysis.analyze(reqs, open_rows(spark, sf_dir), chunks, analysis.Stages(Store(spark, f"{shared_dir(spark)}/chain-{uuid.uuid4().hex[:12]}")), asked)
    count = lambda name, kind: out[name].groupBy("project_id", F.lit(name).alias("relation"), kind.alias("kind")).agg(F.count("*").alias("n"))
    return count("requirements", F.col("rtype")).unionByName(count("open_items", F.col("kind"))).unionByName(count("coverage", F.col("class")))


# --- folds (no SQL twin: checked against brute force in tests) ---


def _small_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req_view(spark, sf_dir).withColumn("idx", F.col("idx").cast("long"))


@query()
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different wordings whose score reaches 0.72 in one direction, by the first row of each; copies count with their wording."""
    forms = similarity.forms_of(similarity.with_form(_small_view(spark, sf_dir).select("project_id", "idx", "statement")))
    counted = lambda k: forms.select("project_id", F.col("form").alias(k), F.col("copies").alias(f"{k}_copies"))
    return similarity.form_links(forms, 0.72).join(counted("a"), ["project_id", "a"]).join(counted("b"), ["project_id", "b"])


def _foldable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _small_view(spark, sf_dir).withColumn("authority", tx.source_authority(F.array("source_type")))
    return rows.select("project_id", "idx", "id", "statement", "rtype", "authority", F.array(F.concat_ws("|", "doc_id", "location")).alias("refs"))


@query()
def dedup_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.dedup_fold(_foldable(spark, sf_dir))


@query()
def recall_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals that the fold lost, with a count of all originals so that an empty loss shows as a row."""
    rows = _foldable(spark, sf_dir)
    lost = folds.unaccounted(rows, folds.dedup_fold(rows))
    return rows.agg(F.count("*").alias("n")).crossJoin(lost.agg(F.count("*").alias("lost")))  # one row each


@query()
def near_dup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _small_view(spark, sf_dir).select("project_id", "idx", "statement", "doc_id", (F.col("idx") % 40).alias("start"), (F.col("idx") % 40 + 60).alias("end"))
    return folds.near_dup_merge(rows)


@query()
def openq_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = open_rows(spark, sf_dir).withColumn("idx", F.col("idx").cast("long"))
    return folds.openq_collapse(rows.select("project_id", "idx", "kind", "statement", "reason"))


@query()
def echo_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = open_rows(spark, sf_dir)
    return similarity.echo_free(items, req_view(spark, sf_dir).filter("not inferred and status = 'approved'")).select("project_id", "idx", "kind", "statement")


@query()
def uncovered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.uncovered_items(open_rows(spark, sf_dir), reporting.approved(req_view(spark, sf_dir))).select("project_id", "idx", "kind", "statement")


@query()
def scope_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = open_rows(spark, sf_dir).filter(F.col("kind").isin(*lex.SCOPE_KINDS)).withColumn("idx", F.col("idx").cast("long"))
    return folds.scope_clusters(rows.select("project_id", "idx", "statement"))


@query()
def best_caution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each firm requirement's most similar cautionary item; a cautionary row is no firm requirement."""
    cautions = open_rows(spark, sf_dir).filter(F.col("kind").isin(*lex.SCOPE_KINDS))
    return similarity.best_match(req_view(spark, sf_dir).filter((F.col("status") == "approved") & ~_is_caution()), cautions, 0.5)


@query()
def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidation with a verdict relation that merges the first two members of every window."""
    rows = _foldable(spark, sf_dir).select("project_id", "idx", "id", "statement", "authority")
    placed = Scratch(spark, "consolidated").write(folds.windows_of(rows, 0.5, by_text=True), "placed")
    verdicts = placed.filter("pos < 2").select("project_id", "comp", "window", F.lit(1).alias("group_id"), "pos")
    return folds.consolidated(rows, verdicts, placed).drop("refs")
