"""The analysis of a project's requirements as a chain of stages, each a table that a resumed run reads again.

Order: fold duplicates, demote pointers, merge confirmed duplicates and consolidate, reconcile with cautions, conflicts,
clarity and priority, second opinions, cross-cutting gaps, chunk coverage with its possible misses, and the open items of all
of these: echoes dropped, near-verbatim ones collapsed, those of one meaning merged. External judgements enter as verdict relations;
without one, its stage has the defined no-judgement result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import lexicons as lex
from lodestar.functions import classify as cl
from lodestar.functions import text as tx
from lodestar.operators import decisions as de
from lodestar.operators import folds, grounding, similarity
from lodestar.operators.ranking import numbered
from lodestar.plans.stages import Stages


@dataclass
class Verdicts:
    """External judgements by step; None: not asked."""

    dedup: DataFrame | None = None  # project_id, comp, window, group_id, pos
    consolidate: DataFrame | None = None  # project_id, comp, window, group_id, pos
    reconcile: DataFrame | None = None  # project_id, idx
    conflicts: DataFrame | None = None  # project_id, comp, window, a, b, is_conflict, reason
    rewrites: DataFrame | None = None  # project_id, idx, rewrite
    verify: DataFrame | None = None  # project_id, id, holds, open_decision
    gaps: DataFrame | None = None  # project_id, statement
    open_items: DataFrame | None = None  # project_id, comp, window, group_id, pos


def requirements(candidates: DataFrame) -> DataFrame:
    """Accepted candidates (project_id, idx, statement, rtype, feature, nfr_category, inferred, confidence, chunk_start, spans ...) as requirements.

    Unknown types become functional, features stay with functional and categories with non-functional rows only,
    confidence is clamped, offsets are moved from the chunk to the document, ids are content hashes.
    """
    rtype = F.when(F.col("rtype").isin(*lex.RTYPES), F.col("rtype")).otherwise("functional")
    out = candidates.withColumn("rtype", rtype).withColumn("id", tx.content_id(F.col("project_id"), F.col("statement")))
    out = out.withColumn("feature", F.when(F.col("rtype") == "functional", F.nullif("feature", F.lit(""))))
    out = out.withColumn("nfr_category", F.when(F.col("rtype") == "non_functional", F.nullif("nfr_category", F.lit(""))))
    out = out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("chunk_start")).alias("start"), (s["end"] + F.col("chunk_start")).alias("end")))
    return out.withColumn("spans", moved).drop("chunk_start")


#: Columns of an open item while a project is analyzed.
ITEM = ["project_id", "idx", "kind", "statement", "doc_id", "where", "reason", "reconciled_from", "merged_refs"]


def _items(rows: DataFrame, kind: Column | str, **columns: Column) -> DataFrame:
    """Rows of a stage as open items; what a stage does not say of them is null or empty."""
    none = {"doc_id": F.lit(None).cast("string"), "where": F.lit(""), "reconciled_from": F.array().cast("array<string>"), "merged_refs": F.array().cast("array<string>")}
    named = {"project_id": F.col("project_id"), "idx": F.lit(None).cast("long"), "kind": F.lit(kind) if isinstance(kind, str) else kind, **none, **columns}
    return rows.select(*[named[c].alias(c) for c in ITEM])


def analyze(reqs: DataFrame, open_items: DataFrame, chunks: DataFrame, stages: Stages, verdicts: Verdicts | None = None) -> dict[str, DataFrame]:
    """Stages of ``reqs`` (project_id, idx, id, statement, rtype, feature, nfr_category, inferred, confidence, source_type, doc_id, location, start, end),
    ``open_items`` (project_id, idx, kind, statement, doc_id, where, reason) and ``chunks`` (project_id, doc_id, idx, location, text, start, end).

    Everything is keyed by project. Results: requirements, open_items, coverage (chunks with their class), conflicts,
    folded, and withdrawn, the trail of requirements that gave way to a caution.
    """
    v = verdicts or Verdicts()
    for name, df in {"reqs": reqs, "items": open_items, "chunks": chunks, **{f"said_{f.name}": getattr(v, f.name) for f in fields(v)}}.items():
        stages.source(name, df)
    spark = reqs.sparkSession
    s = F.col("statement")
    base = reqs.withColumn("idx", F.col("idx").cast("long")).withColumn("authority", tx.source_authority(F.array("source_type"))).withColumn("refs", F.array("doc_id"))
    folded = stages.run("folded", lambda: folds.dedup_fold(base).join(base.drop("statement", "rtype", "id", "refs"), ["project_id", "idx"]), ["reqs"])

    pointer = cl.is_pointer(s)
    demoted = folded.filter(pointer)
    kept = folded.filter(~pointer)
    if v.dedup is not None:
        kept = _merged_into(kept, folds.confirmed_dedup(kept.select("project_id", "idx", "id", "statement", "refs", "duplicate_of", "absorbed"), v.dedup))
    if v.consolidate is not None:
        kept = _merged_into(kept, folds.consolidated(kept.select("project_id", "idx", "id", "statement", "authority", "refs", "duplicate_of", "absorbed"), v.consolidate))
    kept = stages.run("consolidated", lambda: kept, ["folded", "said_dedup", "said_consolidate"])

    asked_items = open_items.withColumn("idx", F.col("idx").cast("long"))
    cautions = asked_items.filter(F.col("kind").isin(*lex.SCOPE_KINDS))
    firm, withdrawn = kept, None
    if v.reconcile is not None:
        withdrawn = stages.run("withdrawn", lambda: de.reconcile(kept, cautions, v.reconcile)[1].join(kept.select("project_id", "idx", "id", "statement", "refs"), ["project_id", "idx"]), ["consolidated", "items", "said_reconcile"])
        firm = kept.join(withdrawn.select("project_id", "idx"), ["project_id", "idx"], "left_anti")
    firm = stages.run("reconciled", lambda: firm, ["consolidated", "withdrawn", "said_reconcile"])

    none = spark.createDataFrame([], "project_id string, a_id string, b_id string, reason string")
    pairs = stages.run("conflicts", lambda: folds.conflicts(firm.select("project_id", "idx", "id", "statement"), v.conflicts) if v.conflicts is not None else none, ["reconciled", "said_conflicts"])
    rated = firm.join(folds.symmetric(pairs), ["project_id", "id"], "left").withColumn("conflicts_with", F.coalesce("conflicts_with", F.array().cast("array<string>")))
    rated = rated.withColumn("flags", cl.substantive_flags(cl.quality_flags(s))).withColumn("testable", cl.testable(s))
    rated = de.adopt_rewrites(rated, v.rewrites).withColumn("priority", cl.moscow(s, F.col("rtype"), F.col("inferred")))
    rated = rated.withColumn("triage", cl.triage(F.col("inferred"), F.col("confidence"), F.col("conflicts_with"), F.col("flags"), F.col("testable"), F.col("rtype"), F.col("priority"), F.array("location")))
    rated = stages.run("rated", lambda: rated.withColumn("owner", cl.owner(s, F.col("feature"), F.col("rtype"), F.col("nfr_category"))), ["reconciled", "conflicts", "said_rewrites"])

    final, opinions = rated, None
    if v.verify is not None:
        asked = rated.filter((F.col("triage.level") == "attention") & ~F.col("inferred") & (F.size("conflicts_with") == 0))
        opinions = stages.run("opinions", lambda: de.verify_outcome(asked.select("project_id", "id", "statement", F.col("refs").alias("doc_ids"), F.array("location").alias("locations")), v.verify, cautions), ["rated", "items", "said_verify"])
        final = rated.join(opinions.filter("outcome = 'critic_rejected'").select("project_id", "id"), ["project_id", "id"], "left_anti")
    final = stages.run("requirements", lambda: final, ["rated", "opinions", "said_verify"])

    # open items, in the order in which the stages raise them
    place = {"doc_id": F.col("doc_id"), "where": F.col("location")}
    given = asked_items
    if withdrawn is not None:  # a caution keeps the evidence of what it displaced
        trail = withdrawn.groupBy("project_id", F.col("match").alias("idx")).agg(F.sort_array(F.collect_list("id")).alias("reconciled_from"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("merged_refs"))
        given = asked_items.join(trail, ["project_id", "idx"], "left")
    keep = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("reconciled_from", "merged_refs")} if withdrawn is not None else {}
    raised = [_items(given, F.col("kind"), idx=F.col("idx"), statement=s, doc_id=F.col("doc_id"), where=F.col("where"), reason=F.col("reason"), **keep)]
    raised.append(_items(demoted, "non_requirement", statement=s, reason=F.lit(lex.POINTER_REASON), idx=F.col("idx"), **place))
    side = lambda k: rated.select("project_id", F.col("id").alias(f"{k}_id"), F.col("idx").alias(f"{k}_idx"), F.col("statement").alias(f"{k}_text"))
    both = pairs.join(side("a"), ["project_id", "a_id"]).join(side("b"), ["project_id", "b_id"])
    raised.append(_items(both, "conflict", idx=F.col("a_idx"), statement=F.concat_ws("  ⟷  ", "a_text", "b_text"), reason=F.col("reason")))
    if opinions is not None:
        said = opinions.filter("outcome <> 'holds'").join(rated.select("project_id", "id", "idx", "statement", "doc_id", "location"), ["project_id", "id"])
        raised.append(_items(said, F.col("outcome"), idx=F.col("idx"), statement=s, reason=F.lit("second-opinion review"), **place))
    gaps = grounding.coverage_gaps(final.select("project_id", "statement", "nfr_category")).select("project_id", "statement", "reason")
    if v.gaps is not None:
        more = v.gaps.filter(F.trim("statement") != "").select("project_id", F.trim("statement").alias("statement"), F.lit("suggested by a reviewer").alias("reason"))
        gaps = gaps.withColumn("k", F.lit(0)).unionByName(more.withColumn("k", F.lit(1)))
        gaps = gaps.groupBy("project_id", F.lower(tx.collapse(s)).alias("norm")).agg(F.min(F.struct("k", "statement", "reason")).alias("x")).select("project_id", "x.statement", "x.reason")
    raised.append(_items(gaps, "gap", statement=s, reason=F.col("reason")))

    so_far = raised[0].withColumn("step", F.lit(0))
    for k, more in enumerate(raised[1:], 1):
        so_far = so_far.unionByName(more.withColumn("step", F.lit(k)))
    so_far = stages.run("open_items_raised", lambda: so_far, ["items", "withdrawn", "folded", "conflicts", "rated", "opinions", "requirements", "said_reconcile", "said_verify", "said_gaps"])
    classes = stages.run("coverage", lambda: grounding.chunk_classes(chunks, final.select("project_id", "doc_id", "start", "end"), so_far.select("project_id", "doc_id", F.col("where").alias("location")), ("project_id", "doc_id")), ["chunks", "requirements", "open_items_raised"])
    missed = classes.filter(F.col("class") == "possible_miss")
    misses = _items(missed, "possible_miss", idx=F.col("idx").cast("long"), statement=F.substring(F.trim("text"), 1, 200), reason=F.lit(lex.MISS_REASON), **place)
    # one number for each over all projects, in the order of raising: what came first is folded first
    counted = so_far.unionByName(misses.withColumn("step", F.lit(len(raised)))).withColumn("_all", F.lit(0))
    items = stages.run("open_items_all", lambda: numbered(counted, "_all", ["project_id", "step", "idx", "doc_id", "where", "statement"]).withColumn("idx", F.col("n").cast("long")).drop("n", "_all", "step"), ["open_items_raised", "coverage"])

    quiet = similarity.echo_free(items, final.select("project_id", "statement"))
    out = stages.run("open_items_collapsed", lambda: folds.openq_collapse(quiet.select("project_id", "idx", "kind", "statement", "reason")).withColumn("merged_count", F.lit(1).cast("long")), ["open_items_all", "requirements"])
    merged = merge_open_items(out.drop("reason"), v.open_items) if v.open_items is not None else out.drop("reason")
    told = items.select("project_id", "idx", "doc_id", "where", "reconciled_from", "merged_refs")
    out = stages.run("open_items", lambda: merged.join(out.select("project_id", "idx", "reason"), ["project_id", "idx"]).join(told, ["project_id", "idx"]), ["open_items_collapsed", "open_items_all", "said_open_items"])
    return {"requirements": final, "open_items": out, "coverage": classes, "conflicts": pairs, "folded": folded, "withdrawn": withdrawn}


def _merged_into(kept: DataFrame, merged: DataFrame) -> DataFrame:
    """``kept`` less what a merge by verdicts absorbed, with the survivors' trails as it leaves them."""
    return kept.drop("absorbed", "duplicate_of", "refs").join(merged.select("project_id", "idx", "absorbed", "duplicate_of", "refs"), ["project_id", "idx"])


def converge(produce: Callable[[int], DataFrame], key: str, max_passes: int) -> DataFrame:
    """Union of passes, first seen per key, until a pass adds nothing new or the bound is reached; column pass tells which."""
    if max_passes < 1:
        raise ValueError("max_passes must be at least 1")
    from lodestar.runtime import Scratch

    scratch, out = None, None
    for i in range(max_passes):
        new = produce(i)
        scratch = scratch or Scratch(new.sparkSession, "passes")
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*new.columns))).filter("_n = 1").drop("_n").withColumn("pass", F.lit(i))
        if out is not None:
            new = new.join(out.select(key), key, "left_anti")
        new = scratch.write(new, f"pass{i}")
        if not new.limit(1).count():
            break
        out = new if out is None else out.unionByName(new)
    return out if out is not None else new


def merge_open_items(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Merge open items (project_id, idx, kind, statement, merged_count) by verdict groups over windows of similar ones.

    The most decisive kind, then the fullest statement, stands for a group; counts add up.
    """
    placed = folds.windows_of(items, 0.5, by_text=True)
    said = verdicts.groupBy("project_id", "comp", "window", "group_id").agg(F.sort_array(F.collect_set("pos")).alias("g")).groupBy("project_id", "comp", "window").agg(F.sort_array(F.collect_list(F.struct("group_id", "g"))).alias("groups"))
    rank = {k[0]: k[3] for k in lex.OPEN_KINDS if k[3] is not None}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos").to_dict("records")
        groups, gone = rows[0]["groups"], set()
        for g in groups if groups is not None else []:
            members = [p for p in g["g"] if p < len(rows) and p not in gone]
            if len(members) < 2:
                continue
            rep = min(members, key=lambda p: (rank.get(rows[p]["kind"], 99), -len(rows[p]["statement"] or "")))
            for p in members:
                if p != rep:
                    rows[rep]["merged_count"] += rows[p]["merged_count"]
                    gone.add(p)
        return pd.DataFrame([r for p, r in enumerate(rows) if p not in gone], columns=["project_id", "idx", "kind", "statement", "merged_count"])

    ready = placed.join(said, ["project_id", "comp", "window"], "left")
    return ready.groupBy("project_id", "comp", "window").applyInPandas(run, "project_id string, idx long, kind string, statement string, merged_count long")


def first_object(text: str | None) -> str | None:
    """The JSON object of a reply: the whole of it, else the first that starts at a brace; arrays and others give None."""
    t = (text or "").strip()
    try:
        whole = json.loads(t)
    except ValueError:
        at = t.find("{")
        if at < 0:
            return None
        try:
            whole, _ = json.JSONDecoder().raw_decode(t[at:])
        except ValueError:
            return None
    return json.dumps(whole, ensure_ascii=False) if isinstance(whole, dict) else None


@F.pandas_udf(T.StringType())
def json_object(s: pd.Series) -> pd.Series:
    return s.map(first_object)


def exit_metrics(reqs: DataFrame, log: DataFrame) -> DataFrame:
    """One row per project: status counts, approved, flagged, and the decisions on its requirements."""
    status = [F.count_if(F.col("status") == s).alias(s) for s in lex.STATUSES]
    base = reqs.groupBy("project_id").agg(*status, F.count_if(F.size("flags") > 0).alias("flagged"))
    done = reqs.select("project_id", "requirement_id").join(log, "requirement_id").groupBy("project_id").agg(F.count("*").alias("decisions"), F.try_divide(F.count_if(F.col("action") == "accept"), F.count("*")).alias("acceptance_rate"))
    return base.join(done, "project_id", "left").withColumn("decisions", F.coalesce("decisions", F.lit(0)))


def chunks_with_quotes(chunks: DataFrame, quotes: DataFrame) -> DataFrame:
    """Chunks that hold a target quote by normal form, each once."""
    c = chunks.withColumn("text", tx.normalize_exact("text"))
    q = quotes.select("item_id", tx.normalize_exact("text").alias("text"))
    hits = grounding.contains_join(c, q).select("doc_id", "idx").distinct()
    return chunks.join(hits, ["doc_id", "idx"], "left_semi")

