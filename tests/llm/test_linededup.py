import random

from lodestar.llm import linededup


def brute(rows, least):
    """Every run of whole lines with enough words that starts earlier is marked, by trying all runs."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone = {}, {i: set() for i in order}
    places = []
    for d in order:
        lines = [] if rows[d][1] is None else rows[d][1].split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least:
                    places.append((d, a, b, tuple(lines[a:b])))
    for d, a, b, run in places:
        if run in seen:
            gone[d] |= set(range(a, b))
        else:
            seen[run] = d
    out = []
    for i, (doc_id, text) in enumerate(rows):
        lines = [] if text is None else text.split("\n")
        out.append((doc_id, None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone[i]), len(gone[i])))
    return sorted(out, key=repr)


def got(spark, rows, least):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ld_file int").coalesce(1)
    return sorted([(r.doc_id, r.text, r.ld_n_removed) for r in linededup.dedup_lines(df, min_words=least).collect()], key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    pool = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(0, 6))) for _ in range(7)]
    rows = [(i if i % 9 else None, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14)))) for i in range(60)]
    rows += [(70, None), (71, ""), (71, ""), (72, rows[5][1]), (72, rows[5][1]), (73, "x y z w\n" * 9)]
    want, have = brute(rows, 5), got(spark, rows, 5)
    assert have == want
    assert any(n for *_, n in have)


def test_copies_and_short_lines(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(1, f"first\n{passage}\nend"), (2, f"second\n{passage}\nfin"), (3, "All rights reserved."), (4, "All rights reserved."), (5, passage)]
    assert got(spark, rows, 50) == sorted([(1, rows[0][1], 0), (2, "second\nfin", 1), (3, rows[2][1], 0), (4, rows[3][1], 0), (5, "", 1)], key=repr)


def test_empty_table(spark):
    assert got(spark, [], 50) == []


def test_blank_lines_and_very_long_texts(spark):
    """Windows with many blank lines between words overlap a lot; a long text is whole."""
    sparse = "\n".join(x for i in range(80) for x in (f"w{i}", *[""] * 40))
    body = "\n".join(f"line {i} of a long text {i * i}" for i in range(6000))
    rows = [(1, sparse), (2, "own start\n" + sparse + "\nown end"), (3, body), (4, "new\n" + body)]
    out = {i: (t, n) for i, t, n in got(spark, rows, 50)}
    assert out[1] == (sparse, 0) and out[3] == (body, 0) and out[4] == ("new", 6000)
    assert out[2][0].startswith("own start\n") and out[2][0].endswith("own end") and "w5" not in out[2][0].split("\n")
