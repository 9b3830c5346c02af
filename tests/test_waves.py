"""Ordered folds in waves against the sequential fold: 300 random projects, tiny blocks, and one component of 10^5 rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import folds, similarity, waves
from test_operators import as_dicts, plain_fold

VERBS, NOUNS, ENDS = ["store", "not store", "show", "hide", "sort"], ["order", "cart", "price"], ["low to high", "high to low", "in the system", "", "", "now"]


def cases(n, seed):
    """Rows of n projects: few wordings, so that chains of similar ones, copies and take-overs are frequent."""
    rnd, out = random.Random(seed), []
    for p in range(n):
        for _ in range(rnd.randrange(1, 14)):
            s = f"The {rnd.choice(['system', 'platform'])} shall {rnd.choice(VERBS)} the {rnd.choice(NOUNS)} {rnd.choice(ENDS)}".strip() + rnd.choice(["", ".", "  !"])
            out.append((f"p{p}", len(out), f"id{len(out)}", rnd.choice([s, s.upper(), "", "..."] if rnd.random() < 0.2 else [s]), rnd.choice(["functional", "business"]), rnd.randrange(4), [f"d{rnd.randrange(3)}"]))
    return out


def by_project(rows):
    out = {}
    for r in rows:
        out.setdefault(r["project_id"], []).append(r)
    return out.values()


@pytest.mark.parametrize("block", [4])
def test_dedup_of_300_projects_equals_the_sequential_fold(spark, monkeypatch, block):
    monkeypatch.setattr(waves, "BLOCK", block)
    rows = cases(300, 11)
    df = spark.createDataFrame(rows, "project_id string, idx long, id string, statement string, rtype string, authority int, refs array<string>").repartition(6)
    got = {r.idx: (r.project_id, r.id, r.statement, r.rtype, list(r.duplicate_of), list(r.absorbed), sorted(r.refs)) for r in folds.dedup_fold(df).collect()}
    want = {k["idx"]: (k["project_id"], k["id"], k["statement"], k["rtype"], k["dups"], k["lost"], sorted(set(k["refs"]))) for one in by_project(as_dicts(rows)) for k in plain_fold(one)}
    assert got == want and sum(len(v[4]) for v in want.values()) > 300


def test_clusters_and_merges_in_tiny_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["moderation", "wishlist", "loyalty", "catalogue", "invoices", "shipping", "reviews"]
    items = [(f"p{i % 3}", i, " ".join(rnd.sample(words, rnd.choice([0, 1, 1, 2])))) for i in range(90)]
    df = spark.createDataFrame(items, "project_id string, idx long, statement string")
    spans = df.select("project_id", "idx", "statement", F.lit("d").alias("doc_id"), (F.col("idx") % 7).alias("start"), (F.col("idx") % 7 + 9).alias("end"))
    want = [sorted(map(tuple, folds.scope_clusters(df).collect())), sorted((r.idx, tuple(r.merged)) for r in folds.near_dup_merge(spans).collect())]
    monkeypatch.setattr(waves, "BLOCK", 14)
    got = [sorted(map(tuple, folds.scope_clusters(df).collect())), sorted((r.idx, tuple(r.merged)) for r in folds.near_dup_merge(spans).collect())]
    assert got == want and any(len(m) > 2 for _, m in want[1])


@pytest.mark.parametrize("rising", [True, False])
def test_a_chain_of_100000_rows_in_one_component(spark, rising):
    n = 100_000
    row = spark.range(n).select(F.lit(0).cast("long").alias("comp"), F.col("id").alias("idx"), F.col("id").alias("who"), F.col("id").alias("form"), F.lit("It shall work").alias("statement"), (F.col("id") if rising else F.lit(0).cast("long")).alias("authority"), F.lit("functional").alias("rtype"))
    asks = spark.range(1, n).select(F.col("id").alias("who"), (F.col("id") - 1).alias("key"), F.lit(0.95).alias("sim"))
    said = waves.fold(row, asks, folds.decide_duplicates, "idx long, host long, took boolean, lost long", "sid long, keys array<long>, statement string, authority long, rtype string, wording long")
    # with rising authority the one survivor passes its voice along the chain; without, every second row finds nobody who speaks like it
    got = said.agg(F.count("*"), F.count_distinct("host"), F.count_if("took"), F.count_if(F.col("lost") == F.col("idx") - 1)).first()
    assert tuple(got) == ((n, 1, n, n - 1) if rising else (n, n // 2, n // 2, 0))


def test_bounds_lose_no_pair_and_are_measured():
    rnd = random.Random(9)
    words = "system platform shall store show order cart price within five seconds audit export report user login password".split()
    texts = [" ".join(sorted(rnd.choices(words, k=rnd.randrange(1, 14)))) for _ in range(150)] + [" ".join(sorted(rnd.choices(words, k=60))) for _ in range(4)]
    for t in (0.45, 0.72, 0.85):
        seen = {}
        kept = {(i, j) for a, b in similarity.candidates(texts, texts, t, seen) for i, j in zip(a.tolist(), b.tolist())}
        real = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if tx.profile(a).ratio(tx.profile(b)) >= t}
        assert real <= kept and seen["pairs"] == len(texts) ** 2 and seen["subsequence"] == len(kept) <= seen["characters"] <= seen["length"]
        if t >= 0.72:
            assert len(kept) < 0.35 * seen["length"]


def test_common_subsequence_against_the_table():
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abcde ", k=rnd.choice([1, 5, 63, 64, 65, 130]))) for _ in range(30)]
    codes, counts, letters = similarity._letters(texts)
    i, j = (x.ravel() for x in __import__("numpy").meshgrid(range(30), range(30)))
    got = similarity.common_subsequence(codes, letters, counts.sum(axis=1), i, j)
    for a, b, n in zip(i, j, got):
        row = [0] * (len(texts[b]) + 1)
        for x in texts[a]:
            diag = 0
            for k, y in enumerate(texts[b], 1):
                row[k], diag = (diag + 1 if x == y else max(row[k], row[k - 1])), row[k]
        assert row[-1] == n


def test_voices_are_found_without_scoring_all(monkeypatch):
    """The best voices are those of a full scan, whatever comes and goes, and few pairs are scored."""
    rnd, scored, real = random.Random(3), [], similarity.ratio
    monkeypatch.setattr(folds, "ratio", lambda a, b, m: scored.append(1) or real(a, b))
    words = "system platform shall store show order cart price within five seconds audit export report user login".split()
    spelled = {f: " ".join(sorted(rnd.choices(words, k=rnd.randrange(0, 9)))) for f in range(400)}
    alike, voices, pairs = folds.Alike(spelled, folds.DEDUP), set(), 0
    for _ in range(3000):
        f = rnd.randrange(400)
        if f in voices and rnd.random() < 0.7:
            voices.remove(f)
            alike.drop(f)
        elif f not in voices and rnd.random() < 0.5:
            voices.add(f)
            alike.add(f)
        elif f not in voices and spelled[f]:
            pairs += len(voices)
            near = {v: tx.similarity(spelled[f], spelled[v]) for v in voices if spelled[v]}
            best = max(near.values(), default=0)
            assert dict(alike.of(f)) == ({v: s for v, s in near.items() if s == best} if best >= folds.DEDUP else {})
    assert pairs > 20_000 and len(scored) < pairs / 4


def test_all_voices_alike_are_found_without_scoring_all(monkeypatch):
    rnd, scored, real = random.Random(5), [], similarity.ratio
    monkeypatch.setattr(folds, "ratio", lambda a, b, m: scored.append(1) or real(a, b))
    words = "system platform shall store show order cart price within five seconds".split()
    spelled = {f: " ".join(sorted(rnd.choices(words, k=rnd.randrange(0, 6)))) for f in range(300)}
    near, voices, pairs = folds.Near(spelled, folds.COLLAPSE), set(), 0
    for _ in range(2000):
        f = rnd.randrange(300)
        if f in voices and rnd.random() < 0.4:
            voices.remove(f)
            near.drop(f)
        elif f not in voices and rnd.random() < 0.5:
            voices.add(f)
            near.add(f)
        else:
            pairs += len(voices)
            assert {k for k, _ in near.of(f)} == {v for v in voices if tx.similarity(spelled[f], spelled[v]) >= folds.COLLAPSE}
    assert pairs > 20_000 and len(scored) < pairs / 4
