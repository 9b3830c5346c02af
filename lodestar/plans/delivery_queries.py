"""What is delivered and how runs are kept: design tokens, matrices, the pack's manifest, gold checks, jobs; with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import classify as cl
from lodestar.functions import text as tx
from lodestar.operators import decisions as de
from lodestar.operators import design, diagrams, document, jobs, reporting, stack
from lodestar.plans import duck
from lodestar.plans.classify_queries import assessed, glossary, lexicon_hits
from lodestar.plans.data_queries import _IDS, _MATRIX, _lum, open_rows, specification_of, table
from lodestar.plans.data_queries import _OPEN as _OPEN_ITEMS
from lodestar.plans.req_view import req_view, with_view
from lodestar.runtime import Scratch
from lodestar.sources import gold, pack

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_view(sql)
        return f

    return add


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else duck.q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


_SCALES = [(lex.DESIGN_SECTIONS[num], i, t, " · ".join(cells)) for num, rows in (("3.1.3", lex.TYPE_TOKENS), ("3.1.4", lex.SPACE_TOKENS)) for i, (t, *cells) in enumerate(rows)]
_DESIGN = (
    "ramp AS (SELECT hue, step, hex, " + _lum("hex") + " + 0.05 AS l FROM (SELECT *, " + ", ".join(f"CAST(CAST('0x' || substr(hex, {2 * i - 1}, 2) AS BIGINT) AS DOUBLE) / 255.0 AS v{i}" for i in (1, 2, 3))
    + " FROM " + _values((h, i, c) for h, cs in lex.RAMPS.items() for i, c in enumerate(cs)) + " v(hue, step, hex)) x), "
    "person AS (SELECT project_id, CASE " + " ".join(f"WHEN bool_or({duck.has_any('s', keys)}) THEN {duck.q(a + '/' + b)}" for keys, a, b, _ in lex.DOMAIN_HUES)
    + f" ELSE '{'/'.join(lex.HUE_DEFAULT)}' END AS hues FROM (SELECT project_id, lower(project_id || ' ' || statement) AS s FROM rv WHERE status = 'approved') t GROUP BY 1), "
    "roles AS (SELECT * FROM " + _values((i, *r) for i, r in enumerate(lex.COLOUR_ROLES)) + " o(pos, token, hue, step, least, w, k, usage)), "
    "fit AS (SELECT p.project_id, o.pos, o.token, o.usage, o.hue, c.step, c.hex, (NOT o.w OR 1.05::DOUBLE / c.l >= o.least) AND (NOT o.k OR greatest(c.l, g.l) / least(c.l, g.l) >= o.least) AS ok "
    "FROM person p CROSS JOIN roles o CROSS JOIN (SELECT l FROM ramp WHERE hue = 'gray' AND step = 0) g "
    "JOIN ramp c ON c.step >= o.step AND c.hue = CASE o.hue WHEN 'primary' THEN split_part(p.hues, '/', 1) WHEN 'secondary' THEN split_part(p.hues, '/', 2) ELSE coalesce(o.hue, 'gray') END), "
    f"design AS (SELECT project_id, {duck.q(lex.DESIGN_SECTIONS['3.1.2'])} AS section, pos, token AS row_id, "
    f"'#' || CASE WHEN hue IS NULL THEN '{lex.SURFACE}' ELSE coalesce(arg_min(hex, step) FILTER (WHERE ok), arg_max(hex, step)) END || ' · ' || usage AS requirement FROM fit GROUP BY project_id, pos, token, usage, hue "
    "UNION ALL SELECT p.project_id, v.* FROM person p CROSS JOIN " + _values(_SCALES) + " v(section, pos, row_id, requirement)) "
)


def _design(reqs: DataFrame) -> DataFrame:
    return design.elements(design.tokens(design.personality(reporting.approved(reqs))))


@query("WITH " + _DESIGN + "SELECT * FROM design")
def design_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour, type and spacing tokens of every project, colours by its domain and held to their contrast."""
    return _design(req_view(spark, sf_dir))


_BLANK = ", ".join(f"'' AS {c.lower()}" for c in lex.RTM_CSV_HEADER[4:])


@query(_MATRIX + ", " + _DESIGN + f"SELECT *, {_BLANK} FROM (SELECT project_id, row_id, category, section, requirement FROM x UNION ALL SELECT project_id, row_id, 'Design & UI', section, requirement FROM design) t")
def rtm_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered matrix: requirements, design tokens and glossary terms, with blank columns for later phases."""
    reqs = req_view(spark, sf_dir)
    rows = reporting.rtm_delivered(reqs, glossary(reporting.approved(reqs)), _design(reqs))
    names = ("row_id", "category", "section", "requirement", *(c.lower() for c in lex.RTM_CSV_HEADER[4:]))
    return rows.select("project_id", *[F.col(f"`{c}`").alias(n) for c, n in zip(lex.RTM_CSV_HEADER, names, strict=True)])


_CELL = lambda c: f"replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '|', '\\|')"


@query(
    _IDS + f"SELECT project_id, CAST(pos AS BIGINT) AS pos, '| ' || concat_ws(' | ', coalesce(srs_id, '—'), id, {_CELL('statement')}, rtype, {duck.priority('statement', 'rtype', 'inferred')}, {_CELL('section')}, "
    + _CELL("CASE WHEN location = '' THEN doc_id ELSE doc_id || ' §' || location END") + ", " + _CELL("'\"' || statement || '\"'") + ") || ' |' AS line FROM rtm "
    f"UNION ALL SELECT DISTINCT project_id, h.pos, h.line FROM rtm CROSS JOIN {_values([(-1, '| ' + ' | '.join(lex.RTM_HEADER) + ' |'), (0, '|' + '---|' * len(lex.RTM_HEADER))])} h(pos, line)"
)
def rtm_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as lines of a Markdown table."""
    return reporting.rtm_markdown(reporting.rtm_rows(assessed(req_view(spark, sf_dir)))).withColumn("pos", F.col("pos").cast("long"))


_OPEN = "CASE WHEN status IN ('candidate', 'needs_review') THEN 'rejected' ELSE status END"


_BROKEN = (
    "SELECT project_id, count(*) FILTER (WHERE rtype = 'functional') AS nf, count(*) FILTER (WHERE rtype = 'non_functional') AS nn, count(*) FILTER (WHERE rtype = 'business') AS nb FROM q WHERE status = 'approved' GROUP BY 1"
)


@query(
    _OPEN_ITEMS + f", q AS (SELECT project_id, rtype, {_OPEN} AS status FROM rv WHERE NOT (project_id = 'Brand#12' AND status = 'approved')), t1 AS ({_BROKEN}) "
    "SELECT t1.project_id, nf + nn + nb + (SELECT count(*) FROM q WHERE q.project_id = t1.project_id AND status = 'approved' AND rtype NOT IN ('functional', 'non_functional', 'business')) AS approved, nf AS functional, nn AS non_functional, nb AS business, "
    "(SELECT count(*) FROM q WHERE q.project_id = t1.project_id AND status = 'approved') AS matrix_rows, (SELECT count(*) FROM items i WHERE i.project_id = t1.project_id) AS open_items, "
    + " + ".join(f"CAST({n} < {least} AS BIGINT)" for (tag, least), n in zip(lex.REQUIRED_TAGS, [{"REQ": "nf", "NFR": "nn", "BR": "nb"}[t] for t, _ in lex.REQUIRED_TAGS], strict=True)) + " AS violations FROM t1"
)
def handoff_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of every project that may be handed over: pending rows are taken as rejected here, and one project has nothing approved.

    Open items are those of the view; violations are the broken checks of the document that is assembled for the project.
    """
    reqs = req_view(spark, sf_dir).withColumn("status", F.expr(_OPEN)).filter("not (project_id = 'Brand#12' and status = 'approved')")
    items = reporting.open_items(open_rows(spark, sf_dir))
    docs = Scratch(spark, "manifest").write(specification_of(reqs, items), "docs")
    broken = document.violations(docs).groupBy(F.col("doc_id").alias("project_id")).agg(F.count("*").alias("violations"))
    every = docs.select(F.col("doc_id").alias("project_id")).join(broken, "project_id", "left").select("project_id", F.coalesce("violations", F.lit(0)).alias("violations"))
    return pack.manifest(reqs, reporting.rtm_delivered(reqs), items, every)


@query()
def technology_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 7 of every project: the technologies its requirements state, by layer."""
    reqs = reporting.approved(req_view(spark, sf_dir))
    found = reqs.select("project_id", F.explode(cl.stated_tokens(F.lower("statement"))).alias("name")).distinct()
    group = F.create_map(*[F.lit(x) for g, names in lex.TECH_TOKENS.items() for n in names for x in (n, g)])
    known = found.withColumn("key", F.try_element_at(group, F.col("name"))).filter("key is not null")
    candidates = known.select("project_id", "key", "name", F.lit("Stated in the inputs.").alias("reason"), F.lit(False).alias("recommended"), F.col("name").alias("pos"))
    aspects = known.select("project_id", "key", F.initcap("key").alias("title"), F.lit("").alias("rationale"), F.col("key").alias("pos")).distinct()
    stated = reqs.select("project_id").distinct().select("project_id", F.lit(True).alias("stated"), F.lit("requirements").alias("basis"))
    # a reviewer's wishes: one known name in capitals, one of their own
    wish = known.groupBy("project_id", "key").agg(F.max("name").alias("choice")).withColumn("choice", F.when(F.crc32(F.concat("project_id", "key")) % 2 == 0, F.upper("choice")).otherwise(F.concat(F.lit("Own "), F.col("key"))))
    return document.technology_section(aspects, candidates, wish, stated)


_SEED = (
    f"f AS (SELECT project_id, {duck.feature('feature')} AS f, min(id) AS first FROM rv WHERE status = 'approved' AND rtype = 'functional' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY first) AS k FROM f), "
    "p AS (SELECT DISTINCT project_id FROM rv WHERE status = 'approved')"
)
_NL = " || chr(10) || "


@query(
    f"WITH {_SEED}, e AS (SELECT project_id, substr(upper(CASE WHEN len(regexp_extract_all(f, '[A-Za-z0-9]+')) = 0 THEN 'Entity' ELSE array_to_string(regexp_extract_all(f, '[A-Za-z0-9]+'), '') END), 1, {diagrams.NAME}) AS e, min(k) AS k FROM n WHERE k <= {diagrams.ENTITIES} GROUP BY 1, 2), "
    f"g AS (SELECT project_id, list(e ORDER BY k) AS es FROM e GROUP BY 1) SELECT project_id, 'erDiagram'{_NL}'  {diagrams.NOTE}'{_NL}CASE WHEN es IS NULL THEN '  USER {{'{_NL}'    string id'{_NL}'  }}' "
    f"ELSE array_to_string(list_transform(es, lambda x: '  USER ||--o{{ ' || x || ' : manages'), chr(10)){_NL}'  USER {{'{_NL}'    string id'{_NL}'    string name'{_NL}'  }}'{_NL}"
    f"array_to_string(list_transform(es, lambda x: '  ' || x || ' {{'{_NL}'    string id'{_NL}'    string status'{_NL}'  }}'), chr(10)) END AS text FROM p LEFT JOIN g USING (project_id)"
)
def entity_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed entity diagram of every project."""
    return diagrams.entity_diagram(req_view(spark, sf_dir))


_ACTOR_ROWS = " UNION ALL ".join(f"SELECT DISTINCT project_id, {i} AS rank, {duck.q(name)} AS name FROM rv WHERE status = 'approved' AND {duck.has_any('lower(statement)', keys)}" for i, (name, keys, _) in enumerate(lex.ROLES))
_LABEL = "CASE WHEN trim(regexp_replace(f, '\\s+', ' ', 'g')) = '' THEN 'Unnamed' ELSE translate(trim(regexp_replace(f, '\\s+', ' ', 'g')), '\"[]{}', '''()()') END"


@query(
    f"WITH {_SEED}, w AS (SELECT project_id, list(name ORDER BY rank) AS a FROM ({_ACTOR_ROWS}) r GROUP BY 1), c AS (SELECT project_id, list({_LABEL} ORDER BY k) AS u FROM n WHERE k <= {diagrams.USE_CASES} GROUP BY 1), "
    "x AS (SELECT p.project_id, coalesce(a, ['User']) AS a, coalesce(u, ['No functional requirements approved yet']) AS u FROM p LEFT JOIN w USING (project_id) LEFT JOIN c USING (project_id)) "
    f"SELECT project_id, 'flowchart LR'{_NL}'  {diagrams.NOTE}'{_NL}array_to_string(list_transform(a, lambda y, i: '  actor' || CAST(i - 1 AS VARCHAR) || '([\"' || y || '\"])'), chr(10)){_NL}"
    f"array_to_string(list_transform(u, lambda y, i: '  UC' || CAST(i - 1 AS VARCHAR) || '[\"' || y || '\"]'), chr(10)){_NL}"
    "array_to_string(flatten(list_transform(range(len(a)), lambda i: list_transform(range(len(u)), lambda j: '  actor' || CAST(i AS VARCHAR) || ' --> UC' || CAST(j AS VARCHAR)))), chr(10)) AS text FROM x"
)
def use_case_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed use-case diagram of every project."""
    reqs = req_view(spark, sf_dir)
    return diagrams.use_case_diagram(reqs, lexicon_hits(reporting.approved(reqs), [r[:2] for r in lex.ROLES]))


_TOKEN_HITS = " UNION ALL ".join(
    [f"SELECT DISTINCT project_id, {i} AS k, {duck.q(g)} AS g, {duck.q(t)} AS t FROM s WHERE regexp_matches(low, {duck.q('(^|[^a-z0-9])' + t.replace('.', chr(92) + '.') + '([^a-z0-9]|$)')})" for i, (g, t) in enumerate((g, t) for g, ts in lex.TECH_TOKENS.items() for t in ts)]
    + [f"SELECT DISTINCT project_id, {1000 + i}, 'name', {duck.q(n)} FROM s WHERE contains(low, {duck.q(n + ' stack')})" for i, n in enumerate(lex.STACK_NAMES)]
)
_COUNTS = lambda signals: " + ".join(f"(length(low) - length(replace(low, {duck.q(x)}, ''))) // {len(x)}" for x in signals)
_PROPOSED = _values((key, pos, name, pos == 1, when or "always") for key, names, when in lex.STACK_PROPOSALS for pos, name in enumerate(names, 1))


@query(
    f"WITH s AS (SELECT project_id, lower(statement) AS low FROM rv WHERE status = 'approved'), h AS ({_TOKEN_HITS}), "
    f"p AS (SELECT project_id, bool_or({duck.has_any('low', lex.STACK_CUES)}) AS cue, sum({_COUNTS(lex.PYTHON_SIGNALS)}) AS py, sum({_COUNTS(lex.SCRIPT_SIGNALS)}) AS js, bool_or({duck.has_any('low', lex.SEARCH_SIGNALS)}) AS search, bool_or({duck.has_any('low', lex.NOTIFY_SIGNALS)}) AS notify FROM s GROUP BY 1), "
    "n AS (SELECT p.project_id, py, js, search, notify, coalesce(bool_or(h.g = 'name'), false) OR (count(h.t) > 0 AND cue) AS stated, bool_and(coalesce(h.g, 'name') = 'name') AS bare, arg_min(h.t, h.k) AS first FROM p LEFT JOIN h USING (project_id) GROUP BY p.project_id, cue, py, js, search, notify) "
    "SELECT n.project_id, true AS stated, CASE h.g WHEN 'data' THEN 'database' ELSE h.g END AS key, 1 AS pos, string_agg(h.t, ', ' ORDER BY h.k) AS name, true AS recommended FROM n JOIN h USING (project_id) WHERE stated AND h.g IN ('frontend', 'backend', 'data') GROUP BY 1, 3 "
    f"UNION ALL SELECT project_id, true, 'stack', 1, upper(coalesce(first, {duck.q(lex.STACK_UNNAMED)})), true FROM n WHERE stated AND bare "
    f"UNION ALL SELECT n.project_id, false, v.key, v.pos, v.name, CASE WHEN v.key = 'backend' THEN v.pos = CASE WHEN py >= js THEN 2 ELSE 1 END ELSE v.lead END FROM n CROSS JOIN {_PROPOSED} v(key, pos, name, lead, w) "
    "WHERE NOT stated AND (w = 'always' OR (w = 'search' AND search) OR (w = 'notify' AND notify))"
)
def stack_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stack of every project: what its approved requirements state, or what they suggest."""
    return stack.proposal(reporting.approved(req_view(spark, sf_dir)))


_KEY_OF = "CASE WHEN idx % 5 = 0 THEN ' ' WHEN idx % 5 = 1 THEN NULL ELSE upper(source_type) END AS key"


@query(
    f"WITH a AS (SELECT project_id, idx AS pos, {_KEY_OF} FROM rv), k AS (SELECT project_id, pos, coalesce(nullif(lower(trim(key)), ''), 'aspect-' || CAST(row_number() OVER (PARTITION BY project_id ORDER BY pos) AS VARCHAR)) AS key FROM a) "
    "SELECT project_id, pos, key || repeat('_', row_number() OVER (PARTITION BY project_id, key ORDER BY pos) - 1) AS key FROM k"
)
def aspect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view read as aspects named by their source: keys told apart in a project."""
    return stack.unique_keys(req_view(spark, sf_dir).selectExpr("project_id", "idx AS pos", _KEY_OF))


_GOLD = "g AS (SELECT id, idx FROM rv WHERE idx % 11 <> 0), s AS (SELECT CASE WHEN idx % 3 = 0 THEN 'test' ELSE 'dev' END AS split, id FROM rv WHERE idx % 7 <> 0 UNION ALL SELECT 'test', id FROM rv WHERE idx % 35 = 1) "


@query("WITH " + _GOLD + "SELECT coalesce(g.id, u.id) AS id, CASE WHEN g.id IS NULL THEN 'unknown' WHEN u.n IS NULL THEN 'missing' ELSE 'shared' END AS fault FROM g FULL JOIN (SELECT id, count(DISTINCT split) AS n FROM s GROUP BY id) u USING (id) WHERE g.id IS NULL OR u.n IS NULL OR u.n > 1")
def split_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold ids in both splits or in none, and split ids without a gold row."""
    rows = req_view(spark, sf_dir).select("id", "idx")
    split = rows.filter("idx % 7 <> 0").select(F.when(F.col("idx") % 3 == 0, "test").otherwise("dev").alias("split"), "id").union(rows.filter("idx % 35 = 1").select(F.lit("test"), "id"))
    return gold.split_faults(rows.filter("idx % 11 <> 0"), split)


@query(f"SELECT tag, array_to_string(list_sort(list(id)), '|') AS ids FROM (SELECT id, unnest({duck.flags('statement')}) AS tag FROM rv) t GROUP BY tag")
def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by quality flag."""
    tagged = req_view(spark, sf_dir).select("id", cl.quality_flags(F.col("statement")).alias("difficulty"))
    return gold.tag_index(tagged).select("tag", F.array_join("ids", "|").alias("ids"))


_STATE = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'running' END"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS project_id", "event_id AS seq", f"{_STATE} AS state", "event_type AS stage")


@query(f"SELECT CAST(user_id AS VARCHAR) AS project_id, arg_max({_STATE}, event_id) AS state, arg_max(event_type, event_id) AS stage, count(*) AS n FROM events GROUP BY 1")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_status(_jobs(spark, sf_dir))


@query(f"WITH st AS (SELECT user_id, arg_max({_STATE}, event_id) AS state FROM events GROUP BY 1) SELECT CAST(e.user_id AS VARCHAR) AS project_id, e.event_id AS seq, st.state <> 'running' AND e.event_id = min(e.event_id) OVER (PARTITION BY e.user_id) AS admitted FROM events e JOIN st USING (user_id) WHERE e.event_type = 'view'")
def admitted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view as a request to run: the first of each project without a running job is admitted."""
    return jobs.admit(_jobs(spark, sf_dir).filter("stage = 'view'").select("project_id", "seq"), _jobs(spark, sf_dir))


_KEY = "sha256(event_type || chr(0) || props)"


@query(f"SELECT DISTINCT {_KEY} AS key FROM events WHERE {_KEY} NOT IN (SELECT {_KEY} FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 AND props IS NOT NULL) AND props IS NOT NULL")
def unanswered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that must be asked where the requests of every third k have an answer."""
    keyed = table(spark, sf_dir, "events").filter("props is not null").select("props", tx.cache_key(F.col("event_type"), F.col("props")).alias("key"))
    return jobs.unanswered(keyed.drop("props"), keyed.filter(F.get_json_object("props", "$.k").cast("long") % 3 == 0).drop("props"))


@query(
    "WITH d AS (SELECT project_id, id AS decision_id FROM rv WHERE idx % 7 >= 4), s AS (SELECT project_id, id AS decision_id, idx, CASE WHEN idx % 2 = 0 THEN 'include' ELSE 'exclude' END AS action FROM rv WHERE idx % 3 = 0) "
    "SELECT d.project_id, d.decision_id, s.action, s.action IS NOT NULL AS resolved FROM d LEFT JOIN s USING (project_id, decision_id)"
)
def resolved_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = req_view(spark, sf_dir).withColumn("decision_id", F.col("id"))
    done = rows.filter("idx % 3 = 0").select("project_id", "decision_id", F.col("idx").alias("seq"), F.when(F.col("idx") % 2 == 0, "include").otherwise("exclude").alias("action"))
    return de.with_resolution(rows.filter("idx % 7 >= 4").select("project_id", "decision_id"), done)
