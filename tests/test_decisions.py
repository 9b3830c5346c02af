"""The decision list and its bulk application against plain Python over the small view."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import classify as cl
from lodestar.functions import text as tx
from lodestar.operators import decisions as de
from lodestar.plans.req_view import req_view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    rows = req_view(spark, SF).withColumn("project_id", F.concat(F.lit("p"), (F.col("idx") % 3).cast("string"))).withColumn("twin", F.concat(F.lit("R-"), F.lpad((F.col("idx") + 3).cast("string"), 9, "0")))
    rows = rows.withColumn("conflicts_with", F.when(F.col("idx") % 17 == 0, F.array("twin", F.lit("R-missing"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("statement", F.when(F.col("idx") == 6, "The zeppelin export is out of scope for now").when(F.col("idx") == 9, "The zeppelin export is out of scope for phase one").when(F.col("idx") == 12, "Every zeppelin shall have a captain on board at night").otherwise(F.col("statement")))
    s = F.col("statement")
    terms = tx.distinctive(tx.decision_terms(s))
    none = F.lit(None).cast("string")
    reqs = rows.withColumn("t", terms).withColumn("who", cl.owner(s, F.col("feature"), F.col("rtype"), F.col("nfr_category"))).withColumn("alone", cl.owner(s, none, none, none)).withColumn("alt", cl.has_alternatives(s))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("out_of_scope", "gap", "disputed", "possible_miss", "deferred", "inferred")]), (F.col("idx") % 6 + 1).cast("int"))
    items = reqs.filter("idx % 5 < 2").withColumn("kind", kind).withColumn("reason", F.when(F.col("idx") % 4 > 0, F.lit("why")).otherwise("")).withColumn("statement", F.concat(F.lit(" "), s))
    return reqs, items


def plain(reqs, items):
    out = []
    for p in sorted({r.project_id for r in reqs}):
        mine, found = sorted((r for r in reqs if r.project_id == p), key=lambda r: r.idx), []
        by = {r.id: r for r in mine}
        rare = {t for r in mine for t in r.t if sum(t in x.t for x in mine) <= max(3, len(mine) // 12)}
        seen = set()
        for r in mine:
            for o in r.conflicts_with:
                if o in by and frozenset((r.id, o)) not in seen:
                    seen.add(frozenset((r.id, o)))
                    a, b = r.statement, by[o].statement
                    keep = "Keep A" if len(a) >= len(b) else "Keep B"
                    found.append(("conflict", lex.CONFLICT_QUESTION % (a, b), keep + lex.CONFLICT_VERDICT, [a, b], [r.id, o], r.who, "attention", lex.CONFLICT_REASON))
        own = sorted((i for i in items if i.project_id == p), key=lambda i: i.idx)
        verdict = {k: v for k, v, _ in lex.VERDICTS}
        left = [i for i in own if i.kind in lex.SCOPE_KINDS]
        while left:
            group, terms, rest = [left[0]], set(left[0].t), []
            for i in left[1:]:
                if set(i.t) & terms:
                    group.append(i)
                    terms |= set(i.t)
                else:
                    rest.append(i)
            left = rest
            rep = max(group, key=lambda i: len(i.statement))
            found.append((rep.kind, ("Value/approach: " if rep.alt else "Scope: ") + rep.statement.strip(), verdict[rep.kind], [i.statement.strip() for i in group][:5], [r.id for r in mine if set(r.t) & terms & rare], rep.alone, "attention", rep.reason or rep.kind))
        for i in own:
            if i.kind in lex.ADD_KINDS:
                lead, tier = ("Coverage gap: ", "review") if i.kind == "gap" else ("Possible missed requirement: ", "attention")
                found.append((i.kind, lead + i.statement.strip(), verdict[i.kind], [i.statement.strip()], [], i.alone, tier, i.reason or i.kind))
        once = {}
        for d in found:
            once.setdefault("DEC-" + hashlib.sha1(tx.normal(d[1]).encode()).hexdigest()[:8], d)
        ordered = sorted(once.items(), key=lambda x: x[1][6] != "attention")
        out += [(p, n, i, *d) for n, (i, d) in enumerate(ordered, 1)]
    return out


def test_the_list_and_its_application(spark, world):
    reqs, items = world
    want = plain(reqs.collect(), items.collect())
    got = de.decision_list(reqs, items)
    shape = lambda r: (r.project_id, r.n, r.decision_id, r.kind, r.question, r.recommended, list(r.evidence), list(r.affected), r.owner, r.tier, r.reason)
    rows = [shape(r) for r in got.orderBy("project_id", "n").collect()]
    assert rows == want and {w[3] for w in want} >= {"conflict", "out_of_scope", "gap", "possible_miss"} and any(len(w[7]) > 2 for w in want)
    kept = spark.createDataFrame([(w[0], w[2]) for w in want[::4]], "project_id string, decision_id string")
    actions, resolutions, counts = de.apply_recommended(got, reqs, kept)
    text = {r.id: r.statement for r in reqs.collect()}
    last, n, skip = {}, {}, {(w[0], w[2]) for w in want[::4]}
    for p, _, i, kind, _, rec, evidence, affected, *_ in want:
        if (p, i) in skip:
            continue
        c = n.setdefault(p, {"conflicts": 0, "excluded": 0, "included": 0, "to_author": 0})
        if kind == "conflict":
            keep, drop = affected if rec.startswith("Keep A") else affected[::-1]
            last[keep], last[drop] = "accept", "reject"
            c["conflicts"] += 1
        elif kind in ("out_of_scope", "deferred"):
            for r in affected:
                if any(tx.similarity(text[r], e) >= 0.62 and not tx.opposite(text[r], e) for e in evidence):
                    last[r] = "reject"
                    c["excluded"] += 1
        elif kind in ("disputed", "undecided"):
            last.update(dict.fromkeys(affected, "accept"))
            c["included"] += len(affected)
        else:
            c["to_author"] += 1
    assert {r.id: r.action for r in actions.collect()} == last and last
    assert {r.project_id: {k: r[k] for k in ("conflicts", "excluded", "included", "to_author")} for r in counts.collect()} == n
    assert sum(c["excluded"] for c in n.values()) and sum(c["conflicts"] for c in n.values())
    every = resolutions.select("project_id", "decision_id").union(kept)
    assert every.count() == len(want) and de.apply_recommended(got, reqs, every)[0].count() == 0


def test_rewrites_are_adopted_if_they_keep_the_meaning(spark):
    from lodestar.plans.data_queries import adopted_rewrites, offered_rewrites

    reqs = req_view(spark, SF)
    said = {r.idx: r.rewrite.strip() for r in offered_rewrites(reqs).collect()}
    modal = lambda t: next((m for m in lex.MODALS if re.search(rf"\b{m}\b", t.lower())), "")
    want = {}
    for r in reqs.collect():
        plain = " ".join(r.statement.split())
        plain += "" if plain[-1] in ".!?" else "."
        new = said[r.idx]
        ok = tx.similarity(new, plain) >= 0.8 and modal(new) == modal(plain) and not tx.opposite(new, plain)
        want[r.idx] = (new if ok else plain, ok)
    got = {r.idx: (r.statement, r.rewrite_adopted) for r in adopted_rewrites(spark, SF).collect()}
    assert got == want and 20 < sum(ok for _, ok in want.values()) < 150
    assert de.adopt_rewrites(reqs, None).filter("rewrite_adopted").count() == 0
