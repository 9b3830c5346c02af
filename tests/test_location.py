"""Tolerant location against ``locate`` of every pair."""

import random

from pyspark.sql import functions as F

from lodestar.operators import location
from lodestar.operators.grounding import locate

PARTS = ["Alpha", "beta", "it's", "it’s", "x–y", "x-y", "“q”", '"Q"', "ΣΑΣ", "σας", "ſo", "SO", "ı", "I", "İ", "K", "k", "straße", "STRASSE", "é", "É", "😀", "(a+b)", "µ", "μ"]
GAPS = [" ", " ", "  ", "\n", "  ", "\t\x1c"]


def words(rnd, n):
    return "".join(rnd.choice(PARTS) + rnd.choice(GAPS) for _ in range(n))


def data():
    rnd = random.Random(4)
    docs = [(i, words(rnd, rnd.randrange(1, 60)), "s") for i in range(120)] + [(900, None, "s"), (901, "", "s"), (902, "  \n ", "s")]
    quotes = [words(rnd, rnd.randrange(1, 4)) for _ in range(150)] + [words(rnd, 2).strip() for _ in range(100)] + ["", None, " ", "\n", "  \n ", "Alpha", "Alpha", "zzz"]
    return docs, list(enumerate(quotes))


def test_every_pair_is_located_as_by_hand(spark, monkeypatch):
    docs, quotes = data()
    want = sorted((i, d, *at, t[at[0] : at[1]] == q) for i, q in quotes for d, t, _ in docs if (at := locate(q, t)))
    ddf, qdf = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3), spark.createDataFrame(quotes, "item_id long, text string")
    for size in (location.RANGE_BYTES, 4000):  # one automaton, and several
        monkeypatch.setattr(location, "RANGE_BYTES", size)
        out = location.locate_join(ddf, qdf)
        assert sorted((r.item_id, r.doc_id, r.start, r.end, r.verbatim) for r in out.collect()) == want
    assert len(want) > 2000 and 200 < sum(not w[-1] for w in want) and out.columns == ["doc_id", "source", "start", "end", "verbatim", "item_id"]
    assert location.locate_join(ddf, qdf.limit(0)).count() == 0 and location.locate_join(ddf.limit(0), qdf).count() == 0


def test_valid_spans_keep_the_sources_words_once(spark):
    text = "We said: The Order  must ship\ntoday, ok. The order must ship today"
    quotes = ["the order must SHIP today", "The Order  must ship\ntoday", "ok", "ship today", "missing words here now", "must ship today"]
    want = [("The Order  must ship\ntoday", 9, 35), ("must ship today", 51, 66)]
    assert location.valid_span_list(quotes, text) == want
    df = spark.createDataFrame([(1, quotes, text), (2, quotes, None), (3, None, text), (4, [], text)], "k int, q array<string>, t string")
    assert [[tuple(x) for x in r.s] for r in df.select("k", location.spans_of("q", "t").alias("s")).orderBy("k").collect()] == [want, [], [], []]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = location.locate_join(docs, spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")).withColumn("quote_no", F.col("item_id"))
    got = sorted((r.quote_no, r.slice, r.start, r.end) for r in location.valid_spans(found, docs, ["doc_id"]).collect())
    assert [g[1:] for g in got] == want


def test_places_map_back(spark):
    rnd = random.Random(6)
    for _ in range(200):
        t = words(rnd, 20)
        form, places = location.search_form(t), location.Places(t)
        assert all(form[i] == location.search_form(t[places.of(i)]) for i in range(len(form)))
