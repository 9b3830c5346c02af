"""Work that grows with the different texts, and joins whose sizes on disk say nothing: what failed on larger tables."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from lodestar.operators import folds, similarity, waves
from lodestar.runtime import Scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_pairs_of_copies_are_expanded_from_sets(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(similarity, "COPIES", 3)
    rnd = random.Random(3)
    rows = [(f"p{i % 2}", i, rnd.sample("abcdef", rnd.choice([0, 1, 2, 3]))) for i in range(120)]
    spark.createDataFrame(rows, "project_id string, idx long, terms array<string>").write.parquet(f"{tmp_path}/rows")
    got = similarity.overlap_pairs(spark.read.parquet(f"{tmp_path}/rows"), 0.5)
    assert "Broadcast" not in plan(got)  # a table of repeated values is small on disk only
    want = {}
    for (p, a, x), (q, b, y) in itertools.combinations(rows, 2):
        if p == q and set(x) & set(y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5:
            want[p, a, b] = len(set(x) & set(y)) / len(set(x) | set(y))
    found = got.collect()
    assert {(r.project_id, r.a, r.b): r.overlap for r in found} == want and len(found) == len(want)


def test_opposite_pairs_of_copies(spark):
    texts = ["The list shall sort ring prices from low to high.", "The list shall sort ring prices from high to low.", "The list shall not sort ring prices from high to low."]
    df = spark.createDataFrame([("p", i, texts[i % 3]) for i in range(12)], "project_id string, idx long, statement string")
    got = similarity.opposite_pairs(df, 0.5)
    assert "Broadcast" not in plan(got)
    assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a in range(12) for b in range(a + 1, 12) if a % 3 != b % 3]


def test_rendered_units_end_with_mb_as_in_the_sql(spark, tmp_path):
    from lodestar.plans import classify_queries

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(1)
    part.crossJoin(spark.range(1).select(F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 1000, 1_048_576, 2_000_000)])).alias("k"))).withColumn("p_partkey", F.col("k")).drop("k").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["bytes"]: r.unit for r in classify_queries.rendered_text(spark, str(tmp_path)).collect()}
    assert got == {1000: "1000 B", 1_000_000: "KB", 1_048_576_000: "MB", 2_000_000_000: "MB"}


def test_affected_by_classes_equals_pairs_of_rows(spark):
    from lodestar.operators import decisions as de

    rnd = random.Random(4)
    words = ["wishlist", "catalogue", "loyalty", "shipping", "invoices", "reviews", "moderation", "vouchers"]
    rows = [(f"p{i % 2}", f"r{i}", " ".join(rnd.sample(words, rnd.choice([0, 1, 2])))) for i in range(80)]
    reqs = spark.createDataFrame(rows, "project_id string, id string, statement string")
    decided = reqs.filter("id like '%3'").withColumnRenamed("id", "decision_id")
    term = {}
    for p, i, s in rows:
        for w in s.split():
            term.setdefault((p, w), set()).add(i)
    rare = {k: v for k, v in term.items() if len(v) <= max(3, 40 // 12)}
    want = {(p, d, i) for (p, w), ids in rare.items() for d in ids if d.endswith("3") for i in ids}
    got = de.affected(decided, reqs)
    assert not re.search(r"keys=\[project_id#\d+L?, decision_id#\d+L?, id#\d+L?\]", plan(got))  # no distinct over pairs of rows
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_rewrites_are_read_once_and_not_for_every_antonym(spark):
    from lodestar.operators import decisions as de

    reqs = spark.createDataFrame([("p", 1, "The system shall store the record."), ("p", 2, "The list shall sort prices from low to high.")], "project_id string, idx long, statement string")
    offered = spark.createDataFrame([("p", 1, "The system shall store each record."), ("p", 2, "The list shall sort prices from high to low.")], "project_id string, idx long, rewrite string")
    got = de.adopt_rewrites(reqs, offered)
    assert "regexp_extract_all" not in plan(got)
    assert {r.idx: r.rewrite_adopted for r in got.collect()} == {1: True, 2: False}


def test_open_items_match_patterns_in_all_tasks_and_once(spark):
    from lodestar.plans import data_queries as dq
    from lodestar.plans.req_view import req_view

    sf = "/root/testdata/sf0.001"
    got = dq.open_rows(spark, sf)
    assert "part.parquet" not in plan(got) and "RLIKE" not in plan(got)  # a filter of patterns would go below the view's shuffle
    assert "REPARTITION" in plan(req_view(spark, sf)) and got.count() > 0


def test_blocks_of_a_fold_never_exceed_their_rows(spark, monkeypatch):
    monkeypatch.setattr(waves, "BLOCK", 10)
    sizes = [1] * 30 + [3] * 20 + [4] * 9 + [9] * 6 + [10] * 3 + [23]
    rows = [(c, 100 * c + i) for c, n in enumerate(sizes) for i in range(n)]
    blocked, n = waves._blocked(spark.createDataFrame(rows, "comp long, idx long"), Scratch(spark, "test"))
    got = blocked.collect()
    assert n == 3 and sorted((r.comp, r.idx) for r in got) == rows
    assert max(collections.Counter((r.wave, r.block) for r in got).values()) <= 10  # packed by chance, some held 22
    assert all(len({r.block for r in got if r.comp == c}) == 1 for c in range(len(sizes)))
    assert len({r.block for r in got}) == 28  # and no block for every component


def test_near_merge_asks_for_no_pairs_of_wordings(spark, monkeypatch):
    words = "the system shall store every record of".split()
    rows = [("p", i, " ".join([*words, f"kind{i % 60}"]), "d", i % 7, i % 7 + 9) for i in range(240)]  # 60 wordings, each like all others

    def decide(rows, asks, hosts, real=folds.decide_near):
        assert not asks, f"{sum(map(len, asks.values()))} asks for {len(rows)} rows"
        return real(rows, asks, hosts)

    monkeypatch.setattr(folds, "decide_near", decide)
    got = folds.near_dup_merge(spark.createDataFrame(rows, "project_id string, idx long, statement string, doc_id string, start long, end long")).collect()
    assert sorted(i for r in got for i in [r.idx, *r.merged]) == list(range(240)) and len(got) < 60


def test_near_decisions_equal_the_plain_fold_whatever_is_noted(monkeypatch):
    rnd = random.Random(8)
    texts = sorted({" ".join(rnd.sample("abcdefgh", rnd.choice([0, 2, 3, 4]))) for _ in range(60)})
    rows, seen = [], {}
    for i in range(400):
        c, t, s = rnd.randrange(2), rnd.choice(texts), rnd.randrange(12)
        rows.append({"comp": c, "idx": i, "form": seen.setdefault((c, t), i), "norm": t, "doc_id": rnd.choice("xy"), "start": s, "end": s + rnd.choice([0, 3, 6])})
    want, hosts = {}, []
    for r in rows:
        a, span = set(r["norm"].split()), (r["doc_id"], r["start"], r["end"])

        def near(h, r=r, a=a, span=span):
            b = set(h["norm"].split())
            meets = any(d == span[0] and max(e, span[2]) > min(s, span[1]) and min(e, span[2]) - max(s, span[1]) >= 0.6 * (max(e, span[2]) - min(s, span[1])) for d, s, e in h["spans"])
            return h["comp"] == r["comp"] and (h["norm"] == r["norm"] or (bool(a & b) and len(a & b) / len(a | b) >= 0.5 and meets))

        host = next((h for h in hosts if near(h)), None)
        if host is None:
            hosts.append(host := {"comp": r["comp"], "sid": r["idx"], "norm": r["norm"], "spans": []})
        host["spans"].append(span)
        want[r["idx"]] = host["sid"]
    for noted in (1 << 22, 3):
        monkeypatch.setattr(folds, "NOTED", noted)
        got, state = {}, {}
        for at in range(0, 400, 90):  # survivors go from block to block in any order
            said, kept = folds.decide_near(rows[at : at + 90], {}, rnd.sample(list(state.values()), len(state)))
            got |= {x["idx"]: x["host"] for x in said}
            state |= {h["sid"]: h for h in kept}
        assert got == want
    assert len(hosts) > 30


def test_components_without_scoring_all_pairs(spark, monkeypatch):
    """The components are those of all links; in a family of alike wordings, few pairs are scored."""
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 10)
    rnd = random.Random(6)
    words = "system platform shall store show order cart price within five seconds audit export report".split()
    rows = [(f"p{i % 2}", i, " ".join(rnd.choices(words, k=rnd.randrange(0, 8)))) for i in range(110)]
    rows += [("p0", 200, "it is so by far"), ("p0", 201, "it is so by " + "z" * 60)]  # alike by their tokens only
    df = spark.createDataFrame(rows, "project_id string, idx long, statement string")
    forms = Scratch(spark, "test").write(similarity.forms_of(similarity.with_form(df)), "forms")
    last = {r.form: r.last for r in forms.collect()}
    for t in (0.5, 0.72):
        links = similarity.form_links(forms, t).collect()
        for either in (True, False):
            comp = {f: f for f in last}
            edges = [(r.a, r.b) for r in links if either or r.ab is not None or last[r.a] > r.b]
            for _ in comp:
                for a, b in edges:
                    comp[a] = comp[b] = min(comp[a], comp[b])
            assert {r.form: r.comp for r in similarity.form_components(forms, t, either).collect()} == comp and len(set(comp.values())) < len(comp)
    scored, real = [], similarity.ratio
    monkeypatch.setattr(similarity, "ratio", lambda a, b, *m: scored.append(1) or real(a, b, *m))
    texts, every = [f"order record seconds shall store system the within x{i}" for i in range(300)], np.arange(300)
    assert len(set(similarity._connect(texts, every, every, every.copy(), every, every, 0.5, True).tolist())) == 1 and len(scored) < 600


def test_echoes_are_found_by_classes(spark, monkeypatch):
    """As by comparing every pair; copies, and wordings of equal tokens and polarity, are compared once."""
    from lodestar.functions import text as tx
    from lodestar.operators.similarity import echo_free

    rnd = random.Random(8)
    words = "catalogue orders prices sorted low high show hide customer invoices archive export nightly not enable disable".split()
    said = [" ".join(rnd.choices(words, k=rnd.randrange(0, 7))) for _ in range(60)]
    left = [(f"p{i % 2}", i, rnd.choice(["inferred", "ungrounded", "gap"]), rnd.choice(said) + rnd.choice(["", ".", "!", " ?"])) for i in range(240)]
    right = [(f"p{i % 2}", rnd.choice([rnd.choice(said), " ".join(rnd.choices(words, k=5)), "prices sorted from low to high now", "prices sorted from high to low now"])) for i in range(24)]
    core = lambda s: set(spark_core[s])
    texts = spark.createDataFrame([(s,) for s in {x[-1] for x in left + right}], "s string")
    spark_core = {r.s: r.c for r in texts.select("s", tx.core_terms(F.col("s")).alias("c")).collect()}

    def echo(a, b):
        near = tx.similarity(a, b) >= 0.85 or (core(a) and len(core(a) & core(b)) / len(core(a)) >= 0.66)
        return tx.normal(a) == tx.normal(b) or (near and not tx.opposite(a, b))

    want = {i for p, i, kind, s in left if kind != "gap" and s.strip() and any(q == p and echo(s, t) for q, t in right)}
    sizes, real = [], similarity.cross_overlap
    monkeypatch.setattr(similarity, "cross_overlap", lambda a, b, *x: sizes.append(a.count()) or real(a, b, *x))
    items = spark.createDataFrame(left, "project_id string, idx long, kind string, statement string")
    got = {r.idx for r in echo_free(items, spark.createDataFrame(right, "project_id string, statement string")).collect()}
    assert got == {x[1] for x in left} - want and want and max(sizes) <= 2 * len(said)
    assert sizes[0] < len({(p, s) for p, _, kind, s in left if kind != "gap"})
