import random

from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import text as tx
from lodestar.operators import decisions, folds, grounding, review, similarity
from lodestar.operators.graph import connected_components

VERBS, NOUNS = ["store", "not store", "show", "hide", "sort", "export"], ["order", "cart", "price", "user data", "report"]


def statements(seed, n):
    rnd = random.Random(seed)
    tail = ["low to high", "high to low", "within 5 seconds", "in the system", "quickly", ""]
    return [f"The {rnd.choice(['system', 'platform'])} shall {rnd.choice(VERBS)} the {rnd.choice(NOUNS)} {rnd.choice(tail)}".strip() + rnd.choice([".", "", "!"]) for _ in range(n)]


def reqs(spark, n=90, projects=2):
    rows = [(f"p{i % projects}", i, f"id{i}", s, ["functional", "business"][i % 3 == 0], i % 4, [f"d{i % 5}"]) for i, s in enumerate(statements(7, n))]
    return rows, spark.createDataFrame(rows, "project_id string, idx long, id string, statement string, rtype string, authority int, refs array<string>")


def as_dicts(rows):
    return [dict(zip(("project_id", "idx", "id", "statement", "rtype", "authority", "refs"), r, strict=True)) for r in rows]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (9000, 9000)]
    comp = {n: n for e in edges for n in e}
    for _ in comp:
        before = dict(comp)
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == comp
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similarity_join_loses_no_pair(spark, monkeypatch):
    rows, df = reqs(spark)
    for block in (256, 10):
        monkeypatch.setattr(similarity, "BLOCK", block)
        for t, later in ((0.45, False), (0.72, True)):
            want = {}
            for i, a in enumerate(rows):
                for b in rows[i + 1 :]:
                    if a[0] == b[0]:
                        s = tx.similarity(b[3], a[3]) if later else tx.similarity(a[3], b[3])
                        if s >= t:
                            want[a[1], b[1]] = s
            got = {(r.a, r.b): r.sim for r in similarity.similarity_pairs(df, t, later).collect()}
            assert got == want


def plain_fold(rows):
    """The fold of all rows of a project at once, every row against every survivor."""
    out = []
    for r in rows:
        score = [1.0 if tx.normal(r["statement"]) == tx.normal(k["statement"]) else tx.similarity(r["statement"], k["statement"]) for k in out]
        exact = [i for i, k in enumerate(out) if tx.normal(r["statement"]) == tx.normal(k["statement"])]
        i = exact[0] if exact else score.index(max(score)) if score else None
        if i is None or score[i] < 0.72 or score[i] < 0.9 and out[i]["rtype"] != r["rtype"] or tx.opposite(r["statement"], out[i]["statement"]):
            out.append({**r, "refs": list(r["refs"]), "dups": [], "lost": []})
            continue
        k, wording = out[i], r["statement"]
        if r["authority"] > k["authority"]:
            wording, k["statement"], k["authority"] = k["statement"], wording, r["authority"]
        k["refs"], k["dups"], k["lost"] = sorted({*k["refs"], *r["refs"]}), [*k["dups"], r["id"]], [*k["lost"], wording]
    return out


def test_dedup_fold_equals_global_fold(spark):
    rows, df = reqs(spark)
    got = sorted((r.project_id, r.idx, r.statement, tuple(r.duplicate_of), tuple(r.absorbed), tuple(sorted(r.refs))) for r in folds.dedup_fold(df).collect())
    want = []
    for p in ("p0", "p1"):
        want += [(p, k["idx"], k["statement"], tuple(k["dups"]), tuple(k["lost"]), tuple(sorted(k["refs"]))) for k in plain_fold([r for r in as_dicts(rows) if r["project_id"] == p])]
    assert got == sorted(want)
    assert sum(1 + len(g[3]) for g in got) == len(rows)  # nothing is lost
    assert folds.unaccounted(df, folds.dedup_fold(df)).count() == 0
    for g in got:
        assert not any(tx.opposite(g[2], a) for a in g[4][:1])


def test_other_folds_equal_global_ones(spark):
    rows, df = reqs(spark, 70, 1)
    kinds = ["conflict", "inferred", "ungrounded", "critic_flag"]
    rank = {k[0]: 99 if k[3] is None else k[3] for k in lex.OPEN_KINDS}
    items = df.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("idx") % 4 + 1).cast("int"))).withColumn("reason", F.col("id"))
    blank = spark.createDataFrame([("p0", 200 + i, "gap", t, None) for i, t in enumerate(["", " ", "...", None])], "project_id string, idx long, kind string, statement string, reason string")
    items = items.select("project_id", "idx", "kind", "statement", "reason").union(blank)
    want = []
    for r in rows:
        k = next((k for k in want if tx.similarity(r[3], k[2]) >= 0.85 and not tx.opposite(r[3], k[2])), None)
        if k is None:
            want.append([r[1], kinds[r[1] % 4], r[3], r[2]])
        else:
            if rank[kinds[r[1] % 4]] < rank[k[1]]:
                k[1], k[3] = kinds[r[1] % 4], r[2]
            k[2] = max(k[2], r[3], key=len)
    want += [[200 + i, "gap", t, None] for i, t in enumerate(["", " ", "...", None])]
    got = sorted(([r.idx, r.kind, r.statement, r.reason] for r in folds.openq_collapse(items).collect()), key=lambda r: r[0])
    assert got == sorted(want, key=lambda r: r[0])
    near = df.select("project_id", "idx", "statement", F.lit("d").alias("doc_id"), (F.col("idx") % 7).alias("start"), (F.col("idx") % 7 + 9).alias("end"))
    got = sorted((r.idx, tuple(r.merged)) for r in folds.near_dup_merge(near).collect())
    want = []
    for r in rows:
        words, at = set(tx.normal(r[3]).split()), r[1] % 7
        alike = lambda k: len(words & k[1]) / len(words | k[1]) >= 0.5 and any((9 - abs(at - x)) / (9 + abs(at - x)) >= 0.6 for x in k[3])  # noqa: B023, E731
        k = next((k for k in want if tx.normal(r[3]) == k[4] or alike(k)), None)
        if k is None:
            want.append((r[1], words, [], [at], tx.normal(r[3])))
        else:
            k[2].append(r[1])
            k[3].append(at)
    assert got == sorted((k[0], tuple(k[2])) for k in want)
    scoped = [(r[0], r[1], s) for r, s in zip(rows, statements(3, 70), strict=True)]
    extra = [("p0", 100 + i, s) for i, s in enumerate(["reviews moderation", "moderation queue", "queue export", "unrelated wording", "reviews again"])]
    df2 = spark.createDataFrame(scoped + extra, "project_id string, idx long, statement string")
    terms = {r.idx: set(r.t) for r in df2.select("idx", tx.distinctive(tx.decision_terms(F.col("statement"))).alias("t")).collect()}
    left, want = sorted(terms), {}
    while left:  # a cluster takes in one pass all later rows that share a term with what it has so far
        first, seen, rest = left[0], set(), []
        for i in left:
            if i == first or terms[i] & seen:
                want[i], seen = first, seen | terms[i]
            else:
                rest.append(i)
        left = rest
    assert {r.idx: r.cluster for r in folds.scope_clusters(df2).collect()} == want


def test_overlap_joins_against_all_pairs(spark):
    rnd = random.Random(6)
    sets = [sorted({f"t{int(rnd.paretovariate(0.7)) % 40}" for _ in range(rnd.choice([0, 1, 2, 5, 9]))}) for _ in range(120)]
    df = spark.createDataFrame([("p" + str(i % 2), i, s) for i, s in enumerate(sets)] + [("p0", 500, None)], "project_id string, idx long, terms array<string>")
    for t in (0.3, 0.5, 0.6, 0.85, 1.0):
        jac = lambda i, j: len(set(sets[i]) & set(sets[j])) / max(1, len(set(sets[i]) | set(sets[j])))
        want = {(i, j): jac(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and jac(i, j) >= t}
        assert {(r.a, r.b): r.overlap for r in similarity.overlap_pairs(df, t).collect()} == want
    left, right = df.filter("idx < 60"), df.filter("idx >= 60")
    for t in (0.2, 0.66):
        want = {(i, j): len(set(sets[i]) & set(sets[j])) for i in range(60) for j in range(60, 120) if i % 2 == j % 2 and sets[i] and len(set(sets[i]) & set(sets[j])) >= max(1, t * len(sets[i]) - 1e-9)}
        assert {(r.idx, r.match): r.common for r in similarity.cross_overlap(left, right, t).collect()} == want


def test_cross_steps_against_all_pairs(spark, monkeypatch):
    left, right = statements(11, 40), statements(12, 30)
    df = lambda rows: spark.createDataFrame([("p", i, s) for i, s in enumerate(rows)], "project_id string, idx int, statement string")
    for block in (256, 7):
        monkeypatch.setattr(similarity, "BLOCK", block)
        want = {(i, j): s for i, a in enumerate(left) for j, b in enumerate(right) if (s := tx.similarity(a, b)) >= 0.6}
        assert {(r.idx, r.match): r.sim for r in similarity.cross_similarity(df(left), df(right), 0.6).collect()} == want
    best = {i: min(j for (x, j), s in want.items() if x == i and s == max(v for (y, _), v in want.items() if y == i)) for i, _ in want}
    assert {r.idx: r.match for r in similarity.best_match(df(left), df(right), 0.6).collect()} == best
    core = {s: set(r.t) for s, r in ((r.s, r) for r in spark.createDataFrame([(s,) for s in {*left, *right}], "s string").select("s", tx.core_terms(F.col("s")).alias("t")).collect())}

    def echo(a):
        return any(tx.normal(a) == tx.normal(b) or not tx.opposite(a, b) and (tx.similarity(a, b) >= 0.85 or core[a] and core[b] and len(core[a] & core[b]) / len(core[a]) >= 0.66) for b in right)

    items = df(left).withColumn("kind", F.when(F.col("idx") % 3 == 0, "conflict").otherwise("inferred"))
    assert {r.idx for r in similarity.echo_free(items, df(right)).collect()} == {i for i, a in enumerate(left) if i % 3 == 0 or not echo(a)}


def test_verdict_driven_steps(spark):
    rows, df = reqs(spark, 40, 1)
    df = df.drop("refs")
    placed = folds.windows_of(df, 0.5, by_text=True)
    verdicts = placed.filter("pos < 3").select("project_id", "comp", "window", F.lit(1).alias("group_id"), "pos")
    out = folds.consolidated(df, verdicts).collect()
    assert sorted([r.id for r in out] + [d for r in out for d in r.duplicate_of]) == sorted(r[2] for r in rows)
    assert any(r.duplicate_of for r in out)
    windows = folds.windows_of(df, 0.45)
    pair = windows.filter("pos < 2").groupBy("project_id", "comp", "window").count().filter("count = 2").limit(1).select("project_id", "comp", "window")
    said = pair.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(ok).alias("is_conflict")) for a, b, ok in ((0, 1, True), (1, 0, True), (0, 0, True), (0, 1, False), (0, 99, True))])).alias("v")).select("project_id", "comp", "window", "v.*", F.lit("both\nlines").alias("reason"))
    found = folds.conflicts(df, said).collect()
    assert len(found) <= 1 and all(r.reason == "both" for r in found)
    t = spark.createDataFrame([("p", "a", "catalogue search for shoppers", ["d1", "d2"], ["x"]), ("p", "b", "loyalty points scheme", ["d1", "d2"], ["x"]), ("p", "c", "export audit files", ["d1"], ["Business Objectives"]), ("p", "d", "print invoices", ["d1"], ["x"]), ("p", "e", "ok", ["d1"], ["x"])], "project_id string, id string, statement string, doc_ids array<string>, locations array<string>")
    v = spark.createDataFrame([("p", x, False, False) for x in "abcd"], "project_id string, id string, holds boolean, open_decision boolean")
    o = spark.createDataFrame([("p", "loyalty points undecided")], "project_id string, statement string")
    assert {r.id: r.outcome for r in decisions.verify_outcome(t, v, o).collect()} == {"a": "critic_flag", "b": "critic_rejected", "c": "critic_flag", "d": "critic_rejected", "e": "holds"}
    c = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    w = spark.createDataFrame([(1, True, False, True), (2, True, True, True)], "k int, grounded boolean, invented boolean, is_requirement boolean")
    assert {r.k: r.accepted for r in decisions.critic_filter(c, w, ["k"]).collect()} == {1: True, 2: False, 3: False}


def test_locate_and_contains_join(spark):
    assert grounding.locate("Ab  c", "x aB\nc") == (2, 6) and grounding.locate("it's", "so it’s") == (3, 7) and grounding.locate("", "x") is None
    docs = spark.createDataFrame([(1, "alpha beta gamma delta 😀 end"), (2, "beta gamma"), (3, None), (4, "xalpha beta gammay")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, ""), (4, "😀 end"), (5, None)], "item_id long, text string")
    got = sorted((r.item_id, r.doc_id, r.start, r.end) for r in grounding.contains_join(docs, quotes).collect())
    assert got == [(1, 1, 0, 16), (1, 4, 1, 17), (2, 1, 6, 10), (2, 2, 0, 4), (2, 4, 7, 11), (4, 1, 23, 28)]


def test_review_log(spark):
    log = spark.createDataFrame([(1, "a", "accept", "x"), (2, "a", "reject", "x"), (3, "b", "edit", "auto-approve"), (4, "z", "accept", "x"), (5, "b", "oops", "x")], "seq long, requirement_id string, action string, actor string")
    known = spark.createDataFrame([("p", "a", 0.95), ("p", "b", 0.4), ("q", "c", 0.4)], "project_id string, requirement_id string, confidence double")
    good, bad = review.validated(log, known)
    assert sorted(r.seq for r in good.collect()) == [1, 2, 3] and sorted(r.seq for r in bad.collect()) == [4, 5]
    assert {r.requirement_id: r.status for r in review.fold_status(good).collect()} == {"a": "rejected", "b": "approved"}
    bands = {(r.project_id, r.band): (r.accepted, r.decided) for r in review.calibration(known, good).collect()}
    assert bands["p", "0.90-1.00"] == (0, 1) and bands["q", "0.90-1.00"] == (0, 0)
    assert {r.project_id: r.bar for r in review.suggested_bar(review.calibration(known, good)).collect()} == {"p": 0.9, "q": 0.9}
