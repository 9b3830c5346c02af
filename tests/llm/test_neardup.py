import random
import re

import numpy as np

from lodestar.llm import blocks, neardup


def run_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [run_set(t) for _, t in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= 0.8 for j in range(n)] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *[comp[j] for j in range(n) if link[i][j]]]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return sorted((rows[i][0], min(rows[j][0] for j in range(n) if comp[j] == comp[i]), sum(link[i]), rows[i][0] == min(rows[j][0] for j in range(n) if comp[j] == comp[i])) for i in range(n))


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(60))
    base = [[word() for _ in range(rnd.choice([3, 20, 60, 200]))] for _ in range(30)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, (" ".join(w)).upper() if i % 7 == 0 else ", ".join(w)))
    big = [word() for _ in range(120)]
    for i in range(200, 260):  # a large group of near copies
        w = list(big)
        w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows + [(300, None), (301, ""), (302, " ... "), (303, "one two"), (304, "One, two!")]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    for size in (1024, 8):
        monkeypatch.setattr(neardup, "BLOCK", size)
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ld_row string")
        result, _, _ = neardup.near_duplicates(df)
        got = sorted((r.doc_id, r.nd_class_id, r.nd_n_links, r.nd_kept) for r in result.collect())
        want = brute(rows)
        assert len(got) == len(want)
        assert sum(g[2] for g in got) >= 0.999 * sum(w[2] for w in want)
        assert got == want
        kept = {r.doc_id for r in neardup.keep_one_of_each(df).collect()}
        assert kept == {w[0] for w in want if w[3]}


def test_repeated_rows_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, text + " z")], "doc_id long, text string")
    result, _, _ = neardup.near_duplicates(df)
    rows = result.collect()
    assert sorted(r.nd_n_links for r in rows) == [0, 3, 3, 3, 3] and sum(r.nd_kept for r in rows) == 2
    assert neardup.near_duplicates(df.limit(0))[0].count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs at the threshold among many documents: at least the planned share is found."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    rows = []
    for i in range(0, 1600, 2):
        a = [word() for _ in range(100)]
        b = list(a)
        b[rnd.choice([20, 40])], b[rnd.choice([60, 80])] = word(), word()  # 10 of 96 runs differ on each side: 86 of 106
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
    sets = {i: run_set(t) for i, t in rows}
    near = [i for i in range(0, 1600, 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8]
    assert len(near) > 700 and max(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in near) < 0.82
    result, _, _ = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    links = {r.doc_id: r.nd_n_links for r in result.collect()}
    assert sum(links[i] for i in near) >= 0.995 * len(near) and sum(links.values()) <= 2 * len(near)


def test_shortened_until_recall(spark):
    """A class stops as soon as the trees it has searched reach the recall, smallest nodes first."""
    rows = [(1, t, d, 10 * t + d, 2 if d == 6 else 50 * (7 - d) + t) for t in range(neardup.TREES) for d in range(3, 7)]
    rows += [(2, 0, 3, 3, 4), (2, 0, 4, 4, 4)]
    df = spark.createDataFrame(rows, "item long, tree long, depth long, prefix long, size long")
    taken = lambda i: {(r.tree, r.depth) for r in neardup._wanted(df.filter(f"item = {i}"), 0.8).collect()}
    one = taken(1)
    depth = {t: min(d for x, d in one if x == t) for t in range(neardup.TREES)}
    miss = np.prod([1 - 0.8 ** depth[t] for t in depth])
    assert miss <= 1 - neardup.RECALL and {(t, 6) for t in range(neardup.TREES)} <= one and 3 not in depth.values()
    assert not [t for t in depth if depth[t] == 4 and miss / (1 - 0.8**4) * (1 - 0.8**5) <= 1 - neardup.RECALL and t == max(x for x in depth if depth[x] == 4)]
    assert taken(2) == set()  # alone at short prefixes in the other trees, which is recall enough


def test_trie_sizes_do_not_depend_on_the_deal(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 30, dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[:-1], s[-1:] + np.uint64(k + 1)])) for k, s in enumerate(sets) for _ in range(3)]
    paths = neardup.tree_paths(sets).view(np.int64)
    order = sorted((t, int(paths[i, t]), i) for i in range(len(sets)) for t in range(neardup.TREES))
    import pyarrow as pa

    def sizes(step):
        out = {}
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in order[a : a + step]]) for c in range(3)] + [pa.array([1] * len(order[a : a + step]))], names=["tree", "path", "item", "n_runs"]) for a in range(0, len(order), step)]
        for b in neardup._trie_pass(iter(batches)):
            for r in b.to_pylist():
                if r["depth"]:
                    key = r["tree"], r["depth"], r["prefix"]
                    out[key] = out.get(key, 0) + r["n"]
        return {k: n for k, n in out.items() if n > 1}

    assert sizes(10_000) == sizes(7) == sizes(1) and sizes(7)


def test_summarize_labels_chains():
    items = np.array([50, 10, 40, 20, 30])
    link = np.zeros((5, 5), bool)
    for a, b in ((0, 2), (2, 4), (4, 3)):
        link[a, b] = link[b, a] = True
    got = {i: (n, r) for i, n, r in zip(*blocks.summarize(items, np.array([1, 1, 5, 1, 1]), link), strict=True)}
    assert got == {50: (5, 20), 40: (2, 20), 30: (6, 20), 20: (1, 20)}
