import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import langid

SF = "/root/testdata/sf0.01"


def brute_marginals(scores, transitions):
    n, k = scores.shape
    out, total = np.zeros((n, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path)))
        w *= sum(np.exp(transitions[a, path[0]]) for a in range(k)) / k
        total += w
        for i, y in enumerate(path):
            out[i, y] += w
    return out / total


def test_forward_backward_against_enumeration(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 3)
    rng = np.random.default_rng(0)
    sizes = [0, 1, 3, 8, 4, 0, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores, trans = rng.standard_normal((first[-1], 3)), rng.standard_normal((3, 3))
    got = langid.marginals(scores, first, trans)
    for a, b in itertools.pairwise(first):
        if b > a:
            assert np.allclose(got[a:b], brute_marginals(scores[a:b], trans), atol=1e-6)


def test_held_out_accuracy_and_switches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows = langid.identify(docs, model).collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) > 100
    assert sum(r.lid_lang == r.lang for r in out) / len(out) >= 0.97
    assert all(0 <= r.lid_score <= 1 for r in rows)
    by = {lang: [r.text for r in out if r.lang == lang and r.n_chars > 400] for lang in ("en", "de")}
    tagger = langid.Tagger(model)
    plain = lambda t: [w for w in t.split() if w.isalpha()][:30]
    mixed = " ".join([*plain(by["en"][0]), *plain(by["de"][0])])
    _, _, _, gamma = tagger.tag([mixed])
    tags = [model.langs[k] for k in gamma.argmax(axis=1)]
    assert tags[:30].count("en") >= 27 and tags[-30:].count("de") >= 27


def test_defined_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 --- 45", None), (4, "the of and " * 30, "en"), (4, "the of and " * 30, "en"), (None, "der die das " * 30, "de"), (6, "der die das " * 3000, "de"), (7, "the and der " * 5, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, lid_lang int")
    model = langid.fit(df.select("doc_id", "text", "lang"))
    got = langid.identify(df, model).collect()
    assert [r.lid_lang for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(r.lid_score == 0 for r in got if r.lid_lang == "und")
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.fit(df.filter("lang is null").select("doc_id", "text", "lang"))
    assert {r.lid_lang for r in langid.identify(df, none).collect()} == {"und"}
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_least_score_is_where_wrong_labels_prevail(spark):
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 == 2]
    free = next(i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(i, "a", "b" if k % 6 else "a", 0.3) for k, i in enumerate(held[:30])]  # 25 wrong, 5 right
    rows += [(i, "a", "a", 0.5) for i in held[30:36]] + [(held[36], "a", "b", 0.55)]  # 25 for 11, then 26 for 11
    rows += [(i, "a", "b" if k % 2 else "a", 0.7) for k, i in enumerate(held[200:240])]  # even odds
    rows += [(i, "a", "a", 0.9) for i in held[40:200]] + [(free, "a", "b", 0.95)] * 500 + [(held[0], None, "b", 0.95)] * 500
    df = spark.createDataFrame(rows, "doc_id long, lang string, lid_lang string, lid_score double")
    assert abs(langid.least_score(df) - 0.555) < 0.006  # 26 > 2 * 11 again
    assert langid.least_score(df.filter("lid_score > 0.6")) == 0 and langid.least_score(df.limit(0)) == 0


def test_rejects_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lid_words", F.lit(1))
    lost = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("lang")))
    junk = docs.limit(3).withColumn("text", F.lit("12 34 -- 56")).withColumn("doc_id", F.col("doc_id") + 10**9)
    kept = {r.doc_id: r.lang for r in langid.keep_identified(lost.union(junk)).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert not [i for i in kept if i >= 10**9] and len(kept) >= 0.995 * len(want)
    filled = [i for i in kept if i % 7 == 0 and want[i] is not None]
    assert sum(kept[i] == want[i] for i in filled) >= 0.97 * len(filled) > 50


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.append((texts, labels)))
    a, b, c = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    rows = [(a, f"text number {i}", "en") for i in range(3000)] + [(b, "x" * 200, "de")] * 400 + [(c, "y", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TRAIN_TOTAL", 3000)
    langid.fit(df, per_lang=50)
    (texts, labels), = seen
    assert 30 <= labels.count("en") <= 50 and 1 <= labels.count("de") <= 15 and labels.count("fr") == 1  # one id does not bring all its rows


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "the of and was in that " * 20 , "en"), (3, "der die das und ist ein " * 20, "de"), (4, "der die und " * 100_000, None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {r.doc_id: r.lid_lang for r in langid.identify(df, model).collect()}
    assert got[4] == "de"
