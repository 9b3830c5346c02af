"""Review decisions: propagation to requirements, conflicts, summaries, resolution, recommended actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import classify as cl
from lodestar.functions import text as tx
from lodestar.operators.folds import scope_clusters
from lodestar.operators.similarity import cross_overlap, term_classes
from lodestar.runtime import Scratch, spread


def _each_term(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(tx.distinctive(tx.decision_terms(F.col("statement")))).alias("term"))


def rare_terms(reqs: DataFrame) -> DataFrame:
    """(project_id, term) in at most max(3, n // 12) of a project's requirements."""
    n = reqs.groupBy("project_id").agg(F.count("*").alias("n"))
    df = _each_term(reqs, "project_id", "id").groupBy("project_id", "term").agg(F.count("*").alias("df"))
    return df.join(n, "project_id").filter(F.col("df") <= F.greatest(F.lit(3), F.floor(F.col("n") / 12))).select("project_id", "term")


def affected(decisions: DataFrame, reqs: DataFrame) -> DataFrame:
    """(project_id, decision_id, id): requirements that share a rare distinctive term with a decision (its members' statements).

    Decisions, and requirements, of equal rare terms are one class; classes meet by their terms and are expanded at the end, so that no pair of rows is sorted.
    """
    rare = rare_terms(reqs)

    def classes(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        each = _each_term(spread(rows.select("project_id", name, "statement"), "project_id", name), "project_id", name).join(rare.hint("merge"), ["project_id", "term"])
        sets, chunks = term_classes(each.groupBy("project_id", F.col(name).alias("idx")).agg(F.collect_set("term").alias("terms")), "project_id")
        return sets.select("project_id", F.col("idx").alias(f"{name}_class"), F.explode("terms").alias("term")), chunks.select("project_id", F.col("cls").alias(f"{name}_class"), F.col("ids").alias(f"{name}s"))

    (asked, deciders), (told, members) = classes(decisions, "decision_id"), classes(reqs, "id")
    pairs = asked.join(told.hint("merge"), ["project_id", "term"]).select("project_id", "decision_id_class", "id_class").distinct()
    half = spread(pairs.join(deciders.hint("merge"), ["project_id", "decision_id_class"]), "project_id", "id_class")
    met = half.join(spread(members, "project_id", "id_class").hint("merge"), ["project_id", "id_class"])
    return met.select("project_id", F.explode("decision_ids").alias("decision_id"), "ids").select("project_id", "decision_id", F.explode("ids").alias("id"))


def conflict_pairs(reqs: DataFrame) -> DataFrame:
    """Distinct pairs (project_id, a, b, recommended) from one-sided ``twin`` links; missing partners are skipped."""
    pairs = reqs.filter("twin is not null").select("project_id", F.least("id", "twin").alias("a"), F.greatest("id", "twin").alias("b")).distinct()
    side = lambda s: reqs.select("project_id", F.col("id").alias(s), F.length("statement").alias(f"n{s}"))
    both = pairs.join(side("a"), ["project_id", "a"]).join(side("b"), ["project_id", "b"])
    return both.select("project_id", "a", "b", F.when(F.col("na") >= F.col("nb"), "Keep A").otherwise("Keep B").alias("recommended"))


def scope_decisions(items: DataFrame) -> DataFrame:
    """Decision rows of single open items (project_id, kind, statement, reason): question, verdict, options, owner, tier, id."""
    rows = [(k, v, list(o)) for k, v, o in lex.VERDICTS]
    verdicts = items.sparkSession.createDataFrame(rows, "kind string, recommended string, options array<string>")
    lead = (
        F.when(F.col("kind") == "possible_miss", "Possible missed requirement: ").when(F.col("kind") == "gap", "Coverage gap: ")
        .when(cl.has_alternatives(F.col("statement")), "Value/approach: ").otherwise("Scope: ")
    )
    out = items.join(F.broadcast(verdicts), "kind", "left").withColumn("question", F.concat(lead, F.trim("statement")))
    none = F.lit(None).cast("string")
    return out.select(
        "project_id", "kind", "question", F.coalesce("recommended", F.lit(lex.VERDICT_DEFAULT[0])).alias("recommended"),
        F.coalesce("options", F.array(*[F.lit(x) for x in lex.VERDICT_DEFAULT[1]])).alias("options"),
        cl.owner(F.col("statement"), none, none, none).alias("owner"), F.when(F.col("kind") == "gap", "review").otherwise("attention").alias("tier"),
        F.concat(F.lit("DEC-"), F.substring(F.sha1(tx.normalize(F.col("question"))), 1, 8)).alias("decision_id"),
    )


def summary(decisions: DataFrame) -> DataFrame:
    """Counts by owner and by tier in one pass."""
    both = decisions.groupingSets([["owner"], ["tier"]], "owner", "tier").agg(F.count("*").alias("n"))
    return both.select(F.when(F.col("owner").isNotNull(), "owner").otherwise("tier").alias("facet"), F.coalesce("owner", "tier").alias("value"), "n")


def with_resolution(decisions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``decisions`` with resolved, from the latest resolution of each (project_id, decision_id)."""
    done = resolutions.groupBy("project_id", "decision_id").agg(F.max_by("action", "seq").alias("action"))
    return decisions.join(done, ["project_id", "decision_id"], "left").withColumn("resolved", F.col("action").isNotNull())


def decision_list(reqs: DataFrame, items: DataFrame) -> DataFrame:
    """The decisions of every project, in order: conflicts, scope clusters, gaps and possible misses; what needs attention first.

    ``reqs`` (project_id, idx, id, statement, feature, rtype, nfr_category, conflicts_with), ``items`` (project_id, idx, kind, statement,
    reason). (project_id, n, decision_id, kind, question, recommended, options, evidence, affected, owner, tier, reason): a scope cluster is
    named by its longest item, shows the first five as evidence and affects the requirements that share a rare distinctive term with any of
    them; equal questions are asked once. A conflict's first side is the earlier requirement that names the other.
    """
    scratch = Scratch(reqs.sparkSession, "decisions")
    none, text = F.lit(None).cast("string"), F.trim("statement")
    known = F.create_map(*[F.lit(x) for k, v, _ in lex.VERDICTS for x in (k, v)])
    choices = F.create_map(*[x for k, _, o in lex.VERDICTS for x in (F.lit(k), F.array(*[F.lit(c) for c in o]))])
    verdict = lambda kind: F.coalesce(F.try_element_at(known, kind), F.lit(lex.VERDICT_DEFAULT[0]))
    options = lambda kind: F.coalesce(F.try_element_at(choices, kind), F.array(*[F.lit(c) for c in lex.VERDICT_DEFAULT[1]]))
    columns = ["project_id", "step", "place", "kind", "question", "recommended", "options", "evidence", "affected", "owner", "tier", "reason"]

    links = reqs.select("project_id", F.col("idx").alias("a_idx"), F.col("id").alias("a"), F.posexplode("conflicts_with").alias("k", "b"))
    side = lambda k: reqs.select("project_id", *[F.col(c).alias(f"{k}_{c}") for c in ("statement", "feature", "rtype", "nfr_category")], F.col("id").alias(k))
    pairs = links.join(side("b"), ["project_id", "b"]).withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))
    pairs = pairs.groupBy("project_id", "low", "high").agg(F.min(F.struct("a_idx", "k", "a", "b")).alias("x")).select("project_id", "x.*").join(side("a"), ["project_id", "a"]).join(side("b"), ["project_id", "b"])
    keep = F.when(F.length("a_statement") >= F.length("b_statement"), "Keep A").otherwise("Keep B")
    conflicts = pairs.select(
        "project_id", F.lit(0).alias("step"), F.struct(F.col("a_idx").cast("long").alias("i"), "k").alias("place"), F.lit("conflict").alias("kind"), F.format_string(lex.CONFLICT_QUESTION, "a_statement", "b_statement").alias("question"),
        F.concat(keep, F.lit(lex.CONFLICT_VERDICT)).alias("recommended"), F.array(*[F.lit(o) for o in lex.CONFLICT_OPTIONS]).alias("options"), F.array("a_statement", "b_statement").alias("evidence"), F.array("a", "b").alias("affected"),
        cl.owner(F.col("a_statement"), F.col("a_feature"), F.col("a_rtype"), F.col("a_nfr_category")).alias("owner"), F.lit("attention").alias("tier"), F.lit(lex.CONFLICT_REASON).alias("reason"),
    )

    scope = scratch.write(items.filter(F.col("kind").isin(*lex.SCOPE_KINDS) & (text != "")).select("project_id", F.col("idx").cast("long").alias("idx"), "kind", text.alias("statement"), "reason"), "scope")
    placed = scratch.write(scope_clusters(scope.select("project_id", "idx", "statement")).join(scope, ["project_id", "idx"]), "clusters")
    seen = placed.withColumn("nth", F.row_number().over(W.partitionBy("project_id", "cluster").orderBy("idx"))).filter("nth <= 5")  # the cap is the feature
    shown = seen.groupBy("project_id", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "statement"))), lambda x: x["statement"]).alias("evidence"))
    reach = affected(placed.select("project_id", F.col("cluster").alias("decision_id"), "statement"), reqs).join(reqs.select("project_id", "id", "idx"), ["project_id", "id"])
    reach = reach.groupBy("project_id", F.col("decision_id").alias("cluster")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"]).alias("affected"))
    named = placed.filter("representative").join(shown, ["project_id", "cluster"]).join(reach, ["project_id", "cluster"], "left")
    clusters = named.select(
        "project_id", F.lit(1).alias("step"), F.struct(F.col("cluster").alias("i"), F.lit(0).alias("k")).alias("place"), "kind", F.concat(F.when(cl.has_alternatives(F.col("statement")), "Value/approach: ").otherwise("Scope: "), "statement").alias("question"),
        verdict(F.col("kind")).alias("recommended"), options(F.col("kind")).alias("options"), "evidence", F.coalesce("affected", F.array().cast("array<string>")).alias("affected"),
        cl.owner(F.col("statement"), none, none, none).alias("owner"), F.lit("attention").alias("tier"), F.coalesce(F.nullif("reason", F.lit("")), "kind").alias("reason"),
    )

    added = items.filter(F.col("kind").isin(*lex.ADD_KINDS) & (text != ""))
    missing = added.select(
        "project_id", F.lit(2).alias("step"), F.struct(F.col("idx").cast("long").alias("i"), F.lit(0).alias("k")).alias("place"), "kind", F.concat(F.when(F.col("kind") == "gap", "Coverage gap: ").otherwise("Possible missed requirement: "), text).alias("question"),
        verdict(F.col("kind")).alias("recommended"), options(F.col("kind")).alias("options"), F.array(text).alias("evidence"), F.array().cast("array<string>").alias("affected"),
        cl.owner(text, none, none, none).alias("owner"), F.when(F.col("kind") == "gap", "review").otherwise("attention").alias("tier"), F.coalesce(F.nullif("reason", F.lit("")), "kind").alias("reason"),
    )
    every = conflicts.select(*columns).unionByName(clusters.select(*columns)).unionByName(missing.select(*columns))
    every = every.withColumn("decision_id", F.concat(F.lit("DEC-"), F.substring(F.sha1(tx.normalize_exact("question")), 1, 8)))
    first = every.groupBy("project_id", "decision_id").agg(F.min_by(F.struct(*columns[1:]), F.struct("step", "place")).alias("x")).select("project_id", "decision_id", "x.*")
    order = W.partitionBy("project_id").orderBy(F.col("tier") != "attention", "step", "place")
    return scratch.write(first, "first").withColumn("n", F.row_number().over(order)).select("project_id", "n", "decision_id", *columns[3:])


RESTATES = 0.62


def apply_recommended(decisions: DataFrame, reqs: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What applying the recommendation of every decision that is not in ``resolved`` (project_id, decision_id) does.

    * actions (project_id, id, action): the last one on a requirement, in the order of decisions. A conflict keeps its recommended side and rejects
      the other; disputed and undecided scope accepts what it affects; excluded and deferred scope rejects only requirements that restate
      an item (similarity 0.62, not opposite), never mere neighbours;
    * resolutions (project_id, decision_id, kind, recommended, action): one a decision; with them as ``resolved``, nothing is applied again;
    * counts by project: conflicts, excluded, included, to_author (gaps and misses, which a reviewer writes).
    """
    scratch = Scratch(decisions.sparkSession, "apply")
    todo = scratch.write(decisions.join(resolved.select("project_id", "decision_id").distinct(), ["project_id", "decision_id"], "left_anti"), "todo")
    out, take = F.col("kind").isin("out_of_scope", "deferred"), F.col("kind").isin("disputed", "undecided")
    each = todo.select("project_id", "n", "decision_id", "kind", "recommended", "evidence", F.posexplode("affected").alias("k", "id"))
    keeps = (F.col("k") == 0) == F.col("recommended").startswith("Keep A")
    told = each.filter((F.col("kind") == "conflict") | take).withColumn("action", F.when((F.col("kind") == "conflict") & ~keeps, "reject").otherwise("accept"))
    near = each.filter(out).withColumn("topic", F.explode("evidence")).join(reqs.select("project_id", "id", "statement"), ["project_id", "id"])
    neg, tok = ([f(F.col(c)) for c in ("statement", "topic")] for f in (tx.has_negation, tx.tokens))
    near = spread(near.filter(~tx.polarity_conflict(neg[0], tok[0], neg[1], tok[1])), "project_id", "id", "topic").filter(tx.statement_similarity("statement", "topic") >= RESTATES)
    gone = near.select("project_id", "n", "decision_id", "kind", "id").distinct().withColumn("action", F.lit("reject"))
    # within a conflict the kept side is taken first
    acts = told.select("project_id", "n", "decision_id", "kind", "id", "action").unionByName(gone)
    acts = scratch.write(acts.withColumn("at", F.struct("n", (F.col("action") == "reject").alias("late"))), "acts")
    per = acts.groupBy("project_id", "decision_id").agg(F.count("*").alias("hits"), F.min(F.when(F.col("action") == "accept", F.col("id"))).alias("kept"), F.min(F.when(F.col("action") == "reject", F.col("id"))).alias("dropped"))
    done = todo.join(per, ["project_id", "decision_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    label = (
        F.when(F.col("kind") == "conflict", F.concat(F.lit("keep "), F.coalesce("kept", F.lit("?")), F.lit(", reject "), F.coalesce("dropped", F.lit("?"))))
        .when(out, F.format_string("excluded %d restating requirement(s)", "hits")).when(take, F.format_string("included %d affected requirement(s)", "hits")).otherwise("left to a reviewer to write")
    )
    resolutions = done.select("project_id", "decision_id", "kind", "recommended", label.alias("action"))
    counts = done.groupBy("project_id").agg(
        F.count_if(F.col("kind") == "conflict").alias("conflicts"), F.sum(F.when(out, F.col("hits")).otherwise(0)).alias("excluded"),
        F.sum(F.when(take, F.col("hits")).otherwise(0)).alias("included"), F.count_if(~(F.col("kind") == "conflict") & ~out & ~take).alias("to_author"),
    )
    return acts.groupBy("project_id", "id").agg(F.max_by("action", "at").alias("action")), resolutions, counts


ADOPTS = 0.8


def adopt_rewrites(reqs: DataFrame, rewrites: DataFrame | None) -> DataFrame:
    """``reqs`` (project_id, idx, statement, ...) with the statement made plain, or replaced by its rewrite, and rewrite_adopted.

    A rewrite (project_id, idx, rewrite) is adopted if it keeps the meaning: similarity 0.8 with the plain statement, the same first modal, and
    not opposite. Where several are offered, the first by text counts; blank ones do not.
    """
    plain = reqs.withColumn("statement", cl.cosmetic(F.col("statement")))
    if rewrites is None:
        return plain.withColumn("rewrite_adopted", F.lit(False))
    asked = rewrites.withColumn("rewrite", F.trim("rewrite")).filter("rewrite <> ''").groupBy("project_id", "idx").agg(F.min("rewrite").alias("rewrite"))
    old, new = F.col("statement"), F.col("rewrite")
    read = {f"{k}_{name}": f(c) for k, c in (("old", old), ("new", new)) for name, f in (("modal", cl.first_modal), ("neg", tx.has_negation), ("tok", tx.tokens))}
    # dealt out first, and written, so that all tasks share the reading of texts and none is read again for every antonym
    pairs = spread(reqs.select("project_id", "idx", "statement"), "project_id", "idx").withColumn("statement", cl.cosmetic(old)).join(asked.hint("merge"), ["project_id", "idx"])
    pairs = Scratch(reqs.sparkSession, "rewrites").write(pairs.withColumns(read), "pairs")
    pairs = pairs.filter((F.col("old_modal") == F.col("new_modal")) & ~tx.polarity_conflict(F.col("new_neg"), F.col("new_tok"), F.col("old_neg"), F.col("old_tok")))
    good = pairs.filter(tx.statement_similarity("rewrite", "statement") >= ADOPTS).select("project_id", "idx", "rewrite")
    out = plain.join(good, ["project_id", "idx"], "left").withColumn("rewrite_adopted", new.isNotNull())
    return out.withColumn("statement", F.coalesce(new, old)).drop("rewrite")


def verify_outcome(targets: DataFrame, verdicts: DataFrame, open_topics: DataFrame) -> DataFrame:
    """(project_id, id, outcome) of second opinions: holds, critic_flag (kept: corroborated and not open) or critic_rejected.

    ``targets`` has doc_ids and locations arrays; a missing verdict holds.
    """
    terms = tx.topic_terms(F.col("statement")).alias("terms")
    shared = cross_overlap(targets.select("project_id", F.col("id").alias("idx"), terms), open_topics.select("project_id", F.xxhash64("statement").alias("idx"), terms).distinct(), 0.20)
    still_open = shared.filter(F.col("common") / (F.col("nl") + F.col("nr") - F.col("common")) >= 0.20).select("project_id", F.col("idx").alias("id")).distinct().withColumn("open", F.lit(True))
    strong = (F.size(F.array_distinct("doc_ids")) >= 2) | F.exists("locations", lambda x: cl.contains_any(F.lower(F.coalesce(x, F.lit(""))), lex.AUTHORITATIVE))
    rows = targets.join(verdicts, ["project_id", "id"], "left").join(still_open, ["project_id", "id"], "left")
    keep = strong & F.col("open").isNull() & ~F.coalesce("open_decision", F.lit(False))
    return rows.select("project_id", "id", F.when(F.coalesce("holds", F.lit(True)), "holds").when(keep, "critic_flag").otherwise("critic_rejected").alias("outcome"))


def critic_filter(candidates: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with accepted: grounded, not invented, a requirement. No verdict rejects."""
    good = F.col("grounded") & ~F.col("invented") & F.col("is_requirement")
    return candidates.join(verdicts, keys, "left").withColumn("accepted", F.coalesce(good, F.lit(False)))


def reconcile(firm: DataFrame, cautions: DataFrame, withdrawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Firm rows that stay, and (project_id, idx, match) of those withdrawn onto their most similar caution.

    Only rows that resemble a caution (0.5) can be withdrawn, whatever the verdicts (project_id, idx) say.
    """
    from lodestar.operators.similarity import best_match

    moved = best_match(firm, cautions, 0.5).join(withdrawn, ["project_id", "idx"]).select("project_id", "idx", "match")
    return firm.join(moved, ["project_id", "idx"], "left_anti"), moved
