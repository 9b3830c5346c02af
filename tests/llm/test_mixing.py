import hashlib

import pytest

from lodestar.llm import mixing


def brute_mix(rows, weights, cap=3, seed="mix"):
    """Copies by doc_id, from (doc_id, source, size)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    w = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free, rest = {}, set(sources), float(sum(size.values()))
    while free:
        each = rest / sum(w[s] for s in free)
        over = {s for s in free if each * w[s] > cap * size[s]}
        if not over:
            target |= {s: each * w[s] for s in free}
            break
        for s in over:
            target[s] = cap * size[s]
            rest -= target[s]
        free -= over
    out = {}
    for s in sources:
        mine = sorted((int(hashlib.md5(f"{seed}-{r[0]}".encode()).hexdigest()[:15], 16), r[0], r[2]) for r in rows if r[1] == s)
        at = 0
        for _, i, n in mine:
            out[i] = sum(n > 0 and e * size[s] + at + n / 2 <= target[s] + 1e-9 for e in range(cap))
            at += n
    return out


def test_against_brute_force(spark):
    rows = [(i, f"s{i % 5}" if i % 11 else None, " ".join(["w"] * (i * 7 % 60))) for i in range(400)] + [(1000, "tiny", "one two"), (1001, "zero", None), (1002, "zero", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, mix_target int")
    got = mixing.mix(df, mixing.flat(5, 2, 1)).collect()
    assert {r.doc_id: r.mix_copies for r in got} == brute_mix([(i, s, len((t or "").split())) for i, s, t in rows], (5, 2, 1))
    by = {}
    for r in got:
        by.setdefault(r.source, [r.mix_target, 0, 0])
        by[r.source][1] += r.mix_taken
        by[r.source][2] = max(by[r.source][2], r.mix_size)
    assert all(abs(t - n) <= big for t, n, big in by.values())
    assert all(r.mix_taken <= 3 * r.mix_size for r in got)
    assert mixing.mix(df.limit(0), mixing.flat(1)).count() == 0


def test_schedule_is_inverted(spark):
    rows = [(i, "ab"[i % 2], " ".join(["w"] * 20)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    up, down = [(0.0, 0.0), (1.0, 2.0)], [(0.0, 2.0), (0.5, 1.0), (1.0, 0.0)]
    out = mixing.curriculum(mixing.mix(df, [up, down])).collect()
    at = [r.mix_position for r in out]
    assert at == sorted(at) and 0 <= at[0] and at[-1] < 1
    for t in (0.25, 0.5, 0.75):
        n = {s: sum(r.source == s and r.mix_position < t for r in out) / sum(r.source == s for r in out) for s in "ab"}
        assert n["a"] == pytest.approx(t * t, abs=0.01) and n["b"] == pytest.approx(2 * t - t * t, abs=0.01)


def test_query_runs_the_curriculum(spark, monkeypatch):
    assert [round(mixing._integral(x)[-1], 12) for x in mixing.FADING] == [5, 2, 1]
    seen = []
    whole = mixing.curriculum
    monkeypatch.setattr(mixing, "curriculum", lambda mixed: seen.append(1) or whole(mixed))
    got = mixing.op2_mix_sources(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    want = mixing.mix(docs, mixing.FADING).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert seen and sorted([(r.doc_id, r["size"], r.taken, r.first_position) for r in got], key=key) == sorted([(r.doc_id, r.mix_size, r.mix_taken, r.mix_position) for r in want], key=key)


def test_query_is_sorted_and_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = mixing.op2_mix_sources(spark, sf).collect()
    at = [r.first_position for r in got if r.first_position is not None]
    assert at == sorted(at) and [r.first_position for r in got[: len(at)]] == at
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.sql(mixing.OP2_SQL)
    rows = [tuple(r[c] for c in want.columns) for r in got]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)


def test_fading_sources(spark):
    rows = [(i, f"s{i % 3}", "w " * 20) for i in range(3000)]
    out = mixing.curriculum(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), mixing.FADING)).collect()
    first = [r.source for r in out if r.mix_position < 0.25]
    last = [r.source for r in out if r.mix_position >= 0.75]
    n = lambda part, s: part.count(s)
    assert n(first, "s0") > 1.5 * n(last, "s0") and n(last, "s1") > 1.4 * n(first, "s1") and n(last, "s2") > 5 * n(first, "s2")
