import numpy as np

from lodestar.llm import capfilters


def brute(rows):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) for r in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    comp = list(ids)
    for _ in range(n):
        new = [min([comp[i], *[comp[j] for j in np.flatnonzero(link[i])]]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return [(ids[i], int(link[i].sum()), comp[i], comp[i] == ids[i]) for i in range(n)]


def vectors(seed=0, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(500):
        if i % 5 or not rows:
            v = rng.standard_normal(dim)
        else:
            v = np.array(rows[rng.integers(len(rows))][1]) * rng.uniform(0.5, 2)
            v = v + rng.standard_normal(dim) * np.linalg.norm(v) / np.sqrt(dim) * rng.choice([0, 0.2, 0.35, 0.42])
        rows.append((i, [float(np.float32(x)) for x in v]))
    hot = rows[3][1]
    rows += [(600 + i, hot) for i in range(30)]
    rows += [(700, None), (701, []), (702, [0.0] * dim), (703, [1.0] * (dim - 1) + [None]), (704, [float("nan")] * dim), (705, [1.0] * (dim - 1)), (706, [1e200] * dim), (707, [1e-200] * dim)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = vectors()
    want = sorted(brute(rows))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    for block in (1024, 16):
        monkeypatch.setattr(capfilters, "BLOCK", block)
        got = sorted(map(tuple, capfilters.near_vectors(df).collect()))
        assert len(got) == len(want)
        assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
        assert sum(g != w for g, w in zip(got, want, strict=True)) <= 0.02 * len(want)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    for n, dim in ((500, 64), (50_000, 64), (2_000_000, 64), (50_000, 32), (50_000, 256), (1_000_000_000, 64), (100_000_000, 256)):
        how = capfilters.plan(n, dim)
        x = rng.standard_normal((300, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((300, dim))
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        y = 0.9 * x + np.sqrt(1 - 0.81) * y
        met = [bool(set(a) & set(b)) for a, b in zip(capfilters.list_decode(x, how), capfilters.list_decode(y, how), strict=True)]
        assert sum(met) / 300 >= 0.97, (n, dim, how)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert capfilters.near_vectors(df).count() == 0


def test_recall_with_few_dimensions():
    rng = np.random.default_rng(1)
    for n, dim in ((50_000, 3), (50_000, 16), (50_000, 4), (200_000, 8), (1_000_000, 12), (5_000_000, 16), (5_000_000, 24), (50_000, 2), (1_000_000, 1)):
        how = capfilters.plan(n, dim)
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        x = unit(rng.standard_normal((300, dim)))
        y = rng.standard_normal((300, dim))
        y -= (y * x).sum(1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * unit(y) if dim > 1 else x
        met = [bool(set(a) & set(b)) for a, b in zip(capfilters.list_decode(x, how), capfilters.list_decode(y, how), strict=True)]
        assert sum(met) / 300 >= 0.97, (n, dim, how)


def test_exact_where_no_plan_does(spark, monkeypatch):
    rows = vectors(dim=4)
    want = sorted(brute(rows))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(capfilters, "MAX_TABLES", 0)
    assert capfilters.plan(500, 4) == capfilters.EXACT
    for block in (1024, 64):
        monkeypatch.setattr(capfilters, "BLOCK", block)
        assert sorted(map(tuple, capfilters.near_vectors(df).collect())) == want


def test_caps_do_not_grow_with_the_table():
    """Tens of caps a vector and CAP_SIZE vectors a cap, from ten thousand to a thousand million vectors."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (10_000, 1_000_000, 100_000_000, 1_000_000_000):
        how = capfilters.plan(n, 64)
        caps = np.mean([len(c) for c in capfilters.list_decode(x, how)])
        held = n * caps / (how.tables * how.directions)  # vectors in a cap, on average
        assert how.words <= 200 and caps < 400 and held < 3 * capfilters.CAP_SIZE, (n, how, caps, held)


def test_all_directions_beyond_the_bound_are_listed():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for parts in (2, 3, 4):
        how = capfilters.Plan(1.2, 5, parts, 1)
        turn, words = capfilters.codes(12, 5, parts, 0)
        y, scale = x @ turn, np.sqrt(12 / parts)
        cut = np.split(y, np.cumsum([w.shape[1] for w in words])[:-1], axis=1)
        part = [c @ w.T * scale for c, w in zip(cut, words, strict=True)]
        want = set()
        for i in range(50):
            for d in np.ndindex(*[5] * parts):
                if sum(part[k][i, d[k]] for k in range(parts)) >= 1.2:
                    want.add((i, int(np.ravel_multi_index(d, [5] * parts))))
        r, c = capfilters.decode_table(x, how, 0)
        assert set(zip(r.tolist(), c.tolist())) == want and len(r) == len(want)
