import math

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(n=700, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim)) * 0.3 + rng.standard_normal(dim)).tolist()


def brute(rows):
    """Exact integers by Python, covariance and eigenvectors by NumPy, of (vec_id, vector) of one length."""
    xs = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n = len(xs)
    s = [sum(c) for c in zip(*xs)]
    dev = [sum((n * x - t) ** 2 for x, t in zip(r, s)) for r in xs]
    z = np.array([[x - t / n for x, t in zip(r, s)] for r in xs])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    return n, dev, z @ u / np.sqrt(e), e / e.sum()


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def check(got, rows, k=8):
    n, dev, w, share = brute(rows)
    sign = {}
    for (i, v), d, row in zip(rows, dev, w):
        assert sorted(got[i]) == list(range(1, min(k, len(v)) + 1))
        for c, r in got[i].items():
            assert r.n == n and r.deviation == d == r.deviation_exact and abs(r.explained / share[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9
            sign.setdefault(c, math.copysign(1, r.whitened * row[c - 1]) if abs(row[c - 1]) > 1e-3 else None)
            if sign[c]:
                assert abs(r.whitened - sign[c] * row[c - 1]) < 1e-6


def op(spark, tmp_path, data):
    spark.createDataFrame(data, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op13_whitening(spark, str(tmp_path))


def test_the_given_table_against_numpy(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = whitening.op13_whitening(spark, SF)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double", "deviation_exact": "decimal(38,0)"}
    check(by_row(df), rows)


def test_unusable_rows_and_lengths(spark, tmp_path):
    a, b = vectors(), vectors(90, 3, 6)
    data = [(i, v, 1) for i, v in enumerate(a)] + [(1000 + i, v, None) for i, v in enumerate(b)]
    bad = [(5000, None, 1), (5001, [], 1), (5002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5003, [math.nan] * 6, 1), (5004, [math.inf] * 3, 1)]
    got = by_row(op(spark, tmp_path, data + bad))
    assert not {i for i in got if i and i >= 5000}
    check(got, list(enumerate(a)))
    check(got, [(1000 + i, v) for i, v in enumerate(b)])


def test_repeated_rows_null_ids_and_other_columns(spark):
    a = vectors(200)
    data = [(i, v, "x", 1.5) for i, v in enumerate(a)] + [(0, a[0], "x", 1.5), (None, a[1], "y", None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, note string, Whitened double")
    fits = whitening.fit(df)
    out = whitening.project(df, fits)
    assert fits[6].n == 202 and out.count() == 202 and out.columns == ["vec_id", "embedding", "note", "n", "deviation", "whitened", "explained", "identity_error"]
    twin = [r.whitened for r in out.filter("vec_id = 0 or vec_id = 1 or vec_id is null").orderBy("vec_id").collect()]
    assert np.allclose(twin[0], twin[3], atol=1e-12) and np.allclose(twin[1], twin[2], atol=1e-12) and out.filter("note = 'y'").first().embedding == a[1]


def test_no_variance_and_empty_tables(spark, tmp_path):
    (got,) = by_row(op(spark, tmp_path / "one", [(7, [0.25, 0.5], 1)])).values()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got.values()] == [(1, 0, None, 0.0, 0.0)] * 2
    flat = by_row(op(spark, tmp_path / "flat", [(i, [0.1 * i, 0.5, 0.5 - 0.1 * i], 1) for i in range(20)]))
    assert all(r[1].whitened is not None and abs(r[1].explained - 1) < 0.01 and r[3].whitened is None and r[3].explained == 0 for r in flat.values())
    assert all(abs(r[1].identity_error) < 1e-9 for r in flat.values())
    assert op(spark, tmp_path / "none", []).count() == 0
    assert op(spark, tmp_path / "nulls", [(1, None, None)]).count() == 0


def test_large_entries_stay_exact(spark, tmp_path):
    rng = np.random.default_rng(2)
    for scale, name in ((1e3, "mid"), (1e9, "big")):
        rows = [(i, v) for i, v in enumerate((rng.standard_normal((300, 4)) * scale).tolist())]
        got = by_row(op(spark, tmp_path / name, [(i, v, 0) for i, v in rows]))
        dev = brute(rows)[1]
        assert [int(got[i][1].deviation_exact) for i, _ in rows] == dev
        assert [got[i][1].deviation for i, _ in rows] == [d if d < 2**63 else None for d in dev]
    huge = by_row(op(spark, tmp_path / "huge", [(i, [1e300 * (-1) ** i, float(i)], 0) for i in range(10)]))
    assert len(huge) == 10 and all(math.isfinite(r[1].whitened) for r in huge.values())


def test_deviation_paths_agree():
    rng = np.random.default_rng(4)
    x = rng.integers(99_000, 101_000, (50, 5))
    for n in (50, 3 * 10**9, 2**41):
        f = whitening.Fit(n, [int(v) for v in rng.integers(99_500, 100_500, 5) * n + rng.integers(0, n, 5)])
        assert f.deviations(x) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, f.sums)) for row in x]


def test_covariance_is_merged_over_many_tasks(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(640, 5))], "vec_id long, embedding array<double>")
    many, one = whitening.fit(df.repartition(40)), whitening.fit(df.coalesce(1))
    assert many[5].sums == one[5].sums and np.allclose(many[5].values, one[5].values, rtol=1e-12) and np.allclose(many[5].axes, one[5].axes, atol=1e-9)
    assert whitening.project(df.withColumn("n", F.lit(9)), many).first().n == 640
