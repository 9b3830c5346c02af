"""Specification documents: Markdown structure, format checks, assembly as an ordered section relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import classify as cl
from lodestar.functions import text as tx
from lodestar.operators import design, reporting
from lodestar.runtime import Scratch


def structure(docs: DataFrame) -> DataFrame:
    """Lines of Markdown documents (doc_id, text) with their section and kind.

    (doc_id, line_no, line, kind, sec_num, sec_title, cells, table): kind is heading, table_head, table_rule,
    table_row, text or blank; table numbers the tables of a document.
    """
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("line_no", "line"))
    w = W.partitionBy("doc_id").orderBy("line_no")
    bare = F.trim("line")
    pipe = bare.startswith("|")
    rule = bare.rlike(r"^[|\-: ]+$") & F.contains(bare, F.lit("-"))
    rows = cut.withColumn("pipe", pipe).withColumn("rule", rule).withColumn("head", F.col("line").rlike(r"^#{1,6}\s+"))
    rows = rows.withColumn("starts", F.col("pipe") & F.coalesce(F.lead("rule").over(w), F.lit(False)) & ~F.col("rule"))
    # a table goes on while lines are pipe rows
    rows = rows.withColumn("run", F.sum((~F.col("pipe") & ~F.col("rule") | F.col("starts")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = F.max(F.col("starts").cast("int")).over(W.partitionBy("doc_id", "run")) == 1
    kind = (
        F.when(F.col("starts"), "table_head").when(inside & F.col("rule"), "table_rule").when(inside & F.col("pipe"), "table_row")
        .when(F.col("head"), "heading").when(F.trim("line") == "", "blank").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    title = F.regexp_replace(F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)), r"\s+", " ")
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)", 1)
    rest = F.when(number == "", title).otherwise(F.trim(F.regexp_replace(title, r"^\d+(?:\.\d+)*[ .\t:]*", "")))
    here = w.rowsBetween(W.unboundedPreceding, 0)
    at = lambda c: F.coalesce(F.last(F.when(F.col("kind") == "heading", c), ignorenulls=True).over(here), F.lit(""))
    cells = F.when(F.col("kind").startswith("table"), F.transform(F.split(F.regexp_replace(bare, r"^\|+|\|+$", ""), r"\|", -1), lambda x: F.trim(x)))
    table = F.when(F.col("kind").startswith("table"), F.col("run"))
    return rows.select("doc_id", "line_no", "line", "kind", at(number).alias("sec_num"), at(rest).alias("sec_title"), cells.alias("cells"), table.alias("table"))


def plain(c: Column) -> Column:
    """A line without list mark and bold marks."""
    return F.trim(F.replace(F.regexp_replace(F.trim(c), r"^[-*]\s+", ""), F.lit("**"), F.lit("")))


def tags(lines: DataFrame) -> DataFrame:
    """(doc_id, tag, n) of lines that open with REQ-n, NFR-n or BR-n."""
    tag = F.upper(F.regexp_extract(plain(F.col("line")), r"(?i)^(REQ|NFR|BR)-\d+", 1))
    return lines.filter("kind = 'text'").withColumn("tag", tag).filter("tag <> ''").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


def violations(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, detail) of every broken format check: sections, tables, tags and the entity line."""
    spark = docs.sparkSession
    lines = Scratch(spark, "structure").write(structure(docs), "lines")  # five checks read it
    ids = docs.select("doc_id").distinct()
    heads = lines.filter("kind = 'heading'").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "sec_num", "sec_title")).alias("heads"))
    want = spark.createDataFrame(lex.REQUIRED_SECTIONS, "num string, words string")
    every = ids.crossJoin(F.broadcast(want)).join(heads, "doc_id", "left")  # a fixed list of checks per document
    ordered = F.sort_array(F.coalesce("heads", F.array().cast("array<struct<line_no:int,sec_num:string,sec_title:string>>")))
    hit = F.get(F.filter(ordered, lambda h: F.when(F.col("num") != "", h["sec_num"] == F.col("num")).otherwise(F.contains(F.lower(h["sec_title"]), F.col("words")))), F.lit(0))
    every = every.withColumn("title", hit["sec_title"])
    label = F.when(F.col("num") == "", F.col("words")).otherwise(F.col("num"))
    missing = every.filter("title is null").select("doc_id", F.lit("section").alias("rule"), F.concat(F.lit("missing required section: "), label).alias("detail"))
    named = every.filter((F.col("num") != "") & ~F.contains(F.lower("title"), F.col("words")))
    wrong = named.select("doc_id", F.lit("section").alias("rule"), F.concat(F.lit("§"), "num", F.lit(" title should contain '"), "words", F.lit("' — found '"), "title", F.lit("'")).alias("detail"))

    cells = lines.filter("table is not null").groupBy("doc_id", "table").agg(
        F.min("line_no").alias("at"), F.first("sec_num").alias("sec_num"), F.first("sec_title").alias("sec_title"),
        F.max(F.when(F.col("kind") == "table_head", F.transform("cells", lambda x: F.lower(x)))).alias("header"),
        F.count_if((F.col("kind") == "table_row") & F.exists("cells", lambda x: x != "")).alias("n"),
    )
    specs = spark.createDataFrame([(a, b, c, list(d), e) for a, b, c, d, e in lex.REQUIRED_TABLES], "id string, num string, words string, want array<string>, lead boolean")
    placed = ids.crossJoin(F.broadcast(specs)).alias("s").join(
        cells.alias("t"), (F.col("s.doc_id") == F.col("t.doc_id")) & (((F.col("num") != "") & (F.col("sec_num") == F.col("num"))) | ((F.col("words") != "") & F.contains(F.lower("sec_title"), F.col("words")))), "left"
    )
    first = placed.groupBy("s.doc_id", "id").agg(F.first("num").alias("num"), F.first("words").alias("words"), F.first("want").alias("want"), F.first("lead").alias("lead"), F.min(F.struct("at", "header", "n")).alias("t"))
    loc = F.when(F.col("num") == "", F.col("words")).otherwise(F.col("num"))
    fits = F.when(F.col("lead"), F.get("t.header", F.lit(0)).startswith(F.get("want", F.lit(0)))).otherwise(F.slice("t.header", 1, 2) == F.col("want"))
    problem = (
        F.when(F.col("t.at").isNull(), F.concat(F.lit("missing required table '"), "id", F.lit("' in §"), loc))
        .when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("table '"), "id", F.lit("' (§"), loc, F.lit(") has another header")))
        .when(F.col("t.n") < 1, F.concat(F.lit("table '"), "id", F.lit("' (§"), loc, F.lit(") has no data row")))
    )
    tables = first.withColumn("detail", problem).filter("detail is not null").select("doc_id", F.lit("table").alias("rule"), "detail")

    least = spark.createDataFrame(lex.REQUIRED_TAGS, "tag string, least int")
    counted = ids.crossJoin(F.broadcast(least)).join(tags(lines), ["doc_id", "tag"], "left").filter(F.coalesce("n", F.lit(0)) < F.col("least"))
    tagged = counted.select("doc_id", F.lit("tagged").alias("rule"), F.concat("tag", F.lit("-tagged lines: found "), F.coalesce("n", F.lit(0)).cast("string")).alias("detail"))
    entity = lines.filter((F.col("kind") == "text") & F.contains(F.lower("sec_title"), F.lit("appendix b")) & F.col("line").rlike(r"(?i)principal entities \(")).select("doc_id").distinct()
    pattern = ids.join(entity, "doc_id", "left_anti").select("doc_id", F.lit("pattern").alias("rule"), F.lit("no line names the principal entities in appendix b").alias("detail"))
    return missing.unionByName(wrong).unionByName(tables).unionByName(tagged).unionByName(pattern)


NONE_ITEMS = "None identified for this release."
DEFERRED = "Deferred to the design phase."


def sections(reqs: DataFrame, open_numbered: DataFrame, glossary: DataFrame, roles: DataFrame, interfaces: DataFrame, entities: DataFrame, prose: DataFrame | None = None, brand: DataFrame | None = None, stack: DataFrame | None = None) -> DataFrame:
    """(project_id, pos, block): the ordered blocks of each project's specification, as relations.

    ``roles`` and ``interfaces`` are (project_id, name, description), ``entities`` (project_id, name), ``prose``
    (project_id, num, text), ``brand`` the tokens of ``design.brand_tokens``, ``stack`` (project_id, block) section 7. Nothing is gathered before the last step, which is one string per project.
    """
    spark: SparkSession = reqs.sparkSession
    # numbered once, for a dozen sections read it
    ids = Scratch(spark, "sections").write(reporting.srs_ids(reqs).select("project_id", "id", "srs_id", "statement", "feature", "rtype", "nfr_category"), "ids")
    projects = ids.select("project_id").distinct()
    outline = spark.createDataFrame([(i * 1000, n, t) for i, (n, t) in enumerate(lex.SECTION_TITLES)], "pos int, num string, title string")
    depth = F.when(F.col("num").rlike("^[A-C]$"), 0).otherwise(F.size(F.split("num", r"\.")) - 1)
    head = F.when(F.col("num").rlike("^[A-C]$"), F.concat(F.lit("## "), "title")).when(depth == 0, F.concat(F.lit("## "), "num", F.lit(". "), "title")).when(depth == 1, F.concat_ws(" ", F.lit("###"), "num", "title")).otherwise(F.concat_ws(" ", F.lit("####"), "num", "title"))
    every = projects.crossJoin(F.broadcast(outline))  # a fixed outline per project
    headings = every.select("project_id", "pos", head.alias("block"))
    start = lambda num: next(i for i, (n, _) in enumerate(lex.SECTION_TITLES) if n == num) * 1000

    item = lambda tagged: F.concat(F.lit("- "), F.when(F.lit(tagged), F.concat(F.lit("**"), "srs_id", F.lit(":** "))).otherwise(""), tx.collapse(F.col("statement")))
    listed = []
    for num, keep, tagged in (
        ("2.5", F.col("rtype") == "constraint", False), ("2.7", F.col("rtype") == "assumption", False), ("5.5", F.col("rtype") == "business", True),
        *[(n, (F.col("rtype") == "non_functional") & (F.substring_index(cl.nfr_section(F.col("nfr_category")), " ", 1) == n), True) for n in ("5.1", "5.2", "5.3", "5.4")],
    ):
        rows = ids.filter(keep).groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", item(tagged).alias("line")))), lambda x: x["line"]), "\n").alias("block"))
        listed.append((num, rows))
    feature = ids.filter("rtype = 'functional'").withColumn("bucket", cl.canonical_feature(F.col("feature")))
    line = F.concat(F.lit("- **"), "srs_id", F.lit(":** "), tx.collapse(tx.to_shall_voice(F.col("statement"))))
    feature = feature.groupBy("project_id", "bucket").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    feature = feature.withColumn("k", F.row_number().over(W.partitionBy("project_id").orderBy("first")).cast("string"))
    body = F.concat(
        F.lit("### 4."), "k", F.lit(" "), "bucket", F.lit("\n\n#### 4."), "k", F.lit(".1 Description and Priority\n\nRequirements of the capability \""), "bucket",
        F.lit("\".\n\n#### 4."), "k", F.lit(".2 Stimulus/Response Sequences\n\n"), F.lit(DEFERRED), F.lit("\n\n#### 4."), "k", F.lit(".3 Functional Requirements\n\n"), "lines",
    )
    features = feature.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), body.alias("b")))), lambda x: x["b"]), "\n\n").alias("block"))
    listed.append(("4", features))

    def grid(rows: DataFrame, header: tuple[str, str], left: str, right: str, order: str) -> DataFrame:
        row = F.concat(F.lit("| "), tx.md_cell(F.col(left)), F.lit(" | "), tx.md_cell(F.col(right)), F.lit(" |"))
        lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, row.alias("row")))), lambda x: x["row"]), "\n")
        return rows.groupBy("project_id").agg(F.concat(F.lit(f"| {header[0]} | {header[1]} |\n|---|---|\n"), lines).alias("block"))

    def or_else(rows: DataFrame, name: str, description: str) -> DataFrame:
        """Every project has at least one row, so that its table is well formed."""
        bare = projects.join(rows.select("project_id").distinct(), "project_id", "left_anti")
        return rows.select("project_id", "rank", "name", "description").unionByName(bare.select("project_id", F.lit(0).alias("rank"), F.lit(name).alias("name"), F.lit(description).alias("description")))

    roles = or_else(roles, "User", "General authenticated user of the system.")
    interfaces = or_else(interfaces, "None identified", "No external software interface is named by the approved requirements.")
    entities = or_else(entities.withColumn("description", F.lit("")), "User", "")
    bare = projects.join(glossary.select("project_id").distinct(), "project_id", "left_anti")
    glossary = glossary.select("project_id", "term", "definition").unionByName(bare.select("project_id", F.lit(NONE_ITEMS).alias("term"), F.lit("—").alias("definition")))
    listed.append(("2.3", grid(roles, ("User Class", "Description"), "name", "description", "rank")))
    listed.append(("3.3", grid(interfaces, ("Name", "Description"), "name", "description", "rank")))
    listed.append(("A", grid(glossary, ("Term", "Definition"), "term", "definition", "term")))
    listed.append(("C", grid(reporting.appendix(open_numbered).withColumn("rank", F.substring_index("id", "-", -1).cast("int")), ("ID", "Description"), "id", "description", "rank")))
    names = entities.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("names"))
    listed.append(("B", names.select("project_id", F.concat(F.lit("The principal entities ("), "names", F.lit(") are elaborated in the design phase.")).alias("block"))))
    person = design.personality(reporting.approved(reqs))
    drawn = design.blocks(person, design.tokens(person, brand), adopted=brand is not None)
    listed += [(num, drawn.filter(F.col("num") == num)) for num in ("3.1.1", "3.1.2", "3.1.3", "3.1.4", "3.1.5")]
    if stack is not None:
        listed.append(("7", stack))
    bodies = None
    for num, rows in listed:
        part = rows.select("project_id", F.lit(num).alias("num"), F.lit(start(num) + 1).alias("pos"), "block")
        bodies = part if bodies is None else bodies.unionByName(part)
    if prose is not None:
        bodies = bodies.unionByName(prose.join(F.broadcast(outline.select("num", "pos")), "num").select("project_id", "num", (F.col("pos") + 1).alias("pos"), F.col("text").alias("block")))
    leaf = [n for n, _ in lex.SECTION_TITLES if n not in ("1", "2", "3", "3.1", "5")]
    blank = every.filter(F.col("num").isin(*leaf)).join(bodies.select("project_id", "num").distinct(), ["project_id", "num"], "left_anti")
    fill = blank.select("project_id", (F.col("pos") + 1).alias("pos"), F.when(F.col("num").startswith("3.1"), DEFERRED).otherwise(NONE_ITEMS).alias("block"))
    return headings.unionByName(bodies.drop("num")).unionByName(fill)


def assemble(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): one Markdown document per project."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n")
    return blocks.groupBy(F.col("project_id").alias("doc_id")).agg(F.concat(text, F.lit("\n")).alias("text"))


def layer(key: Column) -> Column:
    """Technology layer of an aspect key: exact, then by keyword, else third-party."""
    k = F.lower(F.coalesce(key, F.lit("")))
    exact = F.create_map(*[F.lit(x) for kv in lex.LAYER_OF.items() for x in kv])
    out = F.when(F.map_contains_key(exact, k), F.element_at(exact, k))
    for word, name in lex.LAYER_KEYWORDS:
        out = out.when(F.contains(k, F.lit(word)), name)
    return out.otherwise(lex.LAYER_DEFAULT)


DEVICE_NONE = "The clients are responsive web applications; this release needs no device capability beyond the browser's."
LAYER_NONE = "Not specified by the requirements for this release; to be determined in Design."
CUSTOM = "Specified by the reviewer (custom entry)."


def technology_section(aspects: DataFrame, candidates: DataFrame, selections: DataFrame, stated: DataFrame) -> DataFrame:
    """(project_id, pos, block): a lead and the six layers of the technology section of every project in ``stated``.

    ``aspects`` (project_id, key, title, rationale, pos), ``candidates`` (project_id, key, name, reason, recommended, pos),
    ``selections`` (project_id, key, choice), ``stated`` (project_id, stated, basis). An aspect's choice is the candidate
    named in any case, else the reviewer's own entry, else the recommended candidate, else the first.
    """
    keys = ["project_id", "key"]
    wish = selections.select(*keys, F.nullif(F.trim("choice"), F.lit("")).alias("choice"))
    named, what = F.lower(F.trim("name")) == F.lower("choice"), F.struct("name", "reason")
    picked = candidates.join(wish, keys, "left").groupBy(*keys).agg(
        F.min_by(what, F.struct(~F.col("recommended"), "pos")).alias("default"), F.min_by(F.when(named, what), F.when(named, F.col("pos"))).alias("known"), F.first("choice").alias("choice"),
    )
    own = F.when(F.col("choice").isNotNull(), F.struct(F.col("choice").alias("name"), F.lit(CUSTOM).alias("reason")))
    chosen = aspects.filter(~cl.is_excluded_aspect(F.col("key"), F.col("title"))).join(picked, keys).withColumn("c", F.coalesce("known", own, "default"))
    detail = F.trim(F.concat_ws(" ", tx.collapse(F.coalesce("rationale", F.lit(""))), tx.collapse(F.coalesce("c.reason", F.lit("")))))
    line = F.concat(F.lit("**"), "c.name", F.lit("**"), F.when(detail != "", F.concat(F.lit(" — "), detail)).otherwise(""))
    rows = chosen.select("project_id", "pos", "key", F.col("c.name").alias("name"), layer(F.col("key")).alias("layer"), line.alias("line"))
    inorder = lambda c, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key", c))), lambda x: x[c]), sep)  # noqa: E731  an aspect each

    lead = F.when(F.col("names").isNull(), "The technology stack comes from the analysis of the requirements, which has not proposed one yet.").when(
        F.col("stated"), F.concat(F.lit("The technology stack below is taken from the project's inputs"), F.when(tx.collapse(F.coalesce("basis", F.lit(""))) != "", F.concat(F.lit(" ("), tx.collapse(F.col("basis")), F.lit(")"))).otherwise(""), F.lit(" and is not a recommendation."))
    ).otherwise(F.concat(F.lit("*Proposed technology stack, to be confirmed by Design and Engineering.* Each layer names the option that was selected, or else recommended.\n\n**Selected stack:** "), "names", F.lit(".")))
    names = stated.join(rows.groupBy("project_id").agg(inorder("name", " · ").alias("names")), "project_id", "left")
    top = names.select("project_id", F.lit(0).alias("pos"), lead.alias("block"))
    titles = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f"### {num} {title}").alias("head"), F.lit(name).alias("layer"), F.lit(DEVICE_NONE if name == "device" else LAYER_NONE).alias("none")) for i, (num, title, name) in enumerate(lex.LAYERS, 1)]))
    outline = names.filter("names is not null").select("project_id", titles.alias("t")).select("project_id", "t.*")
    filled = outline.join(rows.groupBy("project_id", "layer").agg(inorder("line", "  \n").alias("lines")), ["project_id", "layer"], "left")
    return top.unionByName(filled.select("project_id", "pos", F.concat_ws("\n\n", "head", F.coalesce("lines", "none")).alias("block")))
