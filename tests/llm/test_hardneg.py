import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import hardneg

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(data):
    rows = []
    for r in data:
        i, v, lab = r[:3]
        if lab is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        rows.append((i, [math.floor(256 * float(np.float32(c))) for c in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab))
    out = []
    last = lambda b: (-b[0], b[1] is None, b[1] or 0)
    for i, v, lab in rows:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, u)), j, m) for j, u, m in rows if len(u) == len(v)]
        for ps, j, _ in sorted([s for s in scored if s[2] == lab and s[1] != i], key=last)[:5]:
            ok = [s for s in scored if s[2] != lab and 50 * ps <= 100 * s[0] <= 95 * ps]
            out += [(i, j, n, x, ps, s) for n, (s, x, _) in enumerate(sorted(ok, key=last)[:3], 1)]
    return sorted(out, key=repr)


def mined(spark, path, data):
    spark.createDataFrame(data, SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    df = hardneg.op12_hard_negatives(spark, str(path))
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows(n, dim, labels, seed, coarse=False):
    rnd = random.Random(seed)
    centre = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    out = []
    for i in range(n):
        c = centre[rnd.randrange(8)]
        v = [(x + rnd.gauss(0, 0.6)) / 4 for x in c]
        out.append((i, [round(x * 4) / 4 for x in v] if coarse else v, rnd.choice(labels), 1))
    return out


def test_the_given_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = sorted(con.sql(f"select {', '.join(COLUMNS)} from ({hardneg.OP12_SQL})").fetchall())
    df = hardneg.op12_hard_negatives(spark, SF)
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) > 60
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hardneg, "LEAST_GROUP", 150)  # several trees; half of all rows have one label
    data = rows(1200, 6, [3] * 5 + [0, 1, 2, 4, 9], 1)
    want = brute(data)
    assert len(want) > 200 and mined(spark, tmp_path, data) == want


def test_ties_repeated_and_unusable_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hardneg, "LEAST_GROUP", 60)
    data = rows(300, 3, [1, 2, 3], 2, coarse=True) + rows(120, 2, [1, 2], 3, coarse=True)
    data += [(100, data[7][1], 2, 0), (100, data[7][1], 2, 0), *[(None, data[j][1], lab, 0) for j in range(300) for lab in (1, 2, 3)], (150, None, 1, 0), (200, [], 1, 0)]
    data += [(250, [1.0, None, 1.0], 1, 0), (350, [math.nan, 1.0, 1.0], 1, 0), (450, [math.inf, 0.0, 0.0], 2, 0), (500, [1.0, 1.0, 1.0], None, 0), (550, [0.25] * 5, 1, 0)]
    want = brute(data)
    assert len(want) > 50 and any(r[3] is None or r[1] is None for r in want)
    assert mined(spark, tmp_path, data) == want


def test_empty_and_one_label_only(spark, tmp_path):
    assert mined(spark, tmp_path / "a", []) == []
    assert mined(spark, tmp_path / "b", [(i, [float(i), 1.0], 1, 0) for i in range(1, 60) if i % 7]) == []
    assert mined(spark, tmp_path / "c", [(50, [1.0], 1, 0)]) == []


def test_a_tree_answers_like_a_scan_and_prunes():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((4000, 3)) * 60).astype(np.int32)
    ids = rng.permutation(4000).astype(np.int64)
    labels = rng.integers(0, 4, 4000)
    tree = hardneg.grow(x, ids, np.zeros(4000, bool), labels)
    q = (rng.standard_normal((64, 3)) * 60).astype(np.int32)
    asked = rng.integers(0, 8000, (64, 2))
    low, high = -(-50 * asked // 100), 95 * asked // 100
    best, row, visited = hardneg.search(tree, q, np.full(64, -1), np.zeros(64, np.int64), low, high, 3, False)
    for i in range(64):
        s = x.astype(np.int64) @ q[i]
        for w in range(2):
            want = sorted((-a, b) for a, b, m in zip(s.tolist(), ids.tolist(), labels) if m != 0 and low[i, w] <= a <= high[i, w])[:3]
            assert [(-a, int(tree.ids[r])) for a, r in zip(best[i, w], row[i, w]) if a > hardneg.NONE] == want
    assert visited < 0.8 * 64 * tree.leaves


def test_bounds_hold_for_every_member():
    rng = np.random.default_rng(5)
    for dim in (1, 8, 64):
        x = (rng.standard_normal((900, dim)) * 100).astype(np.int32)
        tree = hardneg.grow(x, np.arange(900), np.zeros(900, bool), np.zeros(900, np.int64))
        q = (rng.standard_normal((40, dim)) * 300).astype(np.int32)
        least, most = hardneg.leaf_bounds(tree, q)
        s = q.astype(np.int64) @ tree.x.T.astype(np.int64)
        for leaf in range(tree.leaves):
            part = s[:, tree.cuts[leaf] : tree.cuts[leaf + 1]]
            assert (part >= least[:, leaf, None]).all() and (part <= most[:, leaf, None]).all()


def test_large_components_stay_exact():
    rng = np.random.default_rng(6)
    x = rng.integers(-hardneg.LARGEST, hardneg.LARGEST, (300, 16)).astype(np.int32)
    q = rng.integers(-hardneg.LARGEST, hardneg.LARGEST, (4, 16)).astype(np.int32)
    tree = hardneg.grow(x, np.arange(300), np.zeros(300, bool), np.ones(300, np.int64))
    any_score = np.zeros((4, 1), np.int64)
    best, row, _ = hardneg.search(tree, q, np.full(4, -1), np.ones(4, np.int64), any_score + hardneg.NONE + 1, any_score - hardneg.NONE, 5, True)
    for i in range(4):
        want = sorted(((sum(int(a) * int(b) for a, b in zip(q[i], v)), j) for j, v in enumerate(x)), key=lambda t: (-t[0], t[1]))[:5]
        assert [(int(s), int(tree.ids[r])) for s, r in zip(best[i, 0], row[i, 0])] == want


def test_anchors_and_cuts_are_parameters(spark):
    data = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.9, 0.1], 2), (4, [0.5, 0.1], 2), (5, [0.1, 0.0], 2)]
    df = spark.createDataFrame(data, "key long, v array<double>, kind long")
    out = hardneg.mine(df, F.col("key") == 1, vec_id="key", embedding="v", label="kind", positives=1, k=1, low=10, high=60)
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in out.collect()] == [(1, 2, 4)]
