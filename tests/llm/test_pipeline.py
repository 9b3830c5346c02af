import corpus_pipeline
from lodestar.llm.mixing import n_words
from lodestar.runtime import Scratch
from pyspark.sql import functions as F
from test_linededup import brute as brute_lines
from test_mixing import brute_mix
from test_neardup import brute as brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    scratch = Scratch(spark, "t")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.write(stage(spark, docs, SF), name)
        if k < 4:
            assert docs.columns == columns
        kept.append(docs.count())
        if name == "language_id":
            assert kept[-1] >= 0.97 * before.count()
        if name == "line_dedup":
            rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
            want = [(i, t) for i, t, n in brute_lines(rows, 50) if not (n and t == "")]
            assert sorted(want) == sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "near_dup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(w[0] for w in brute_groups(rows) if w[3]) == sorted(r.doc_id for r in docs.collect())
        if name == "mix":
            rows = [tuple(r) for r in before.select("doc_id", "source", n_words(F.col("text"))).collect()]
            want = {i: c for i, c in brute_mix(rows, (5, 2, 1)).items() if c}
            assert want == {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert kept[-1] == kept[-2] and "sp_ids" in docs.columns
    assert corpus_pipeline.run(spark, SF).count() == kept[-1]


def test_nulls_and_empty_table(spark):
    """A text without letters goes; copies of repeated lines and of documents go; sources without a name are a source."""
    en, de = "the of and that was " * 40, "der die das und ist " * 40
    rows = [(1, None, None, None, None, 7), (2, "", "en", "s", 0, 7), (3, en, "en", None, 800, 7), (3, en, "en", None, 800, 7), (4, de, "de", "s", 800, 7)]
    rows += [(5, "12 -- 34", None, "s", 8, 7), (None, "a few words of the and was", None, "t", 26, 7), (8, "die und der ist das noch", "de", "t", 24, 7)]
    docs = Scratch(spark, "t").write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, nd_kept int"), "d")
    kept = {}
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = Scratch(spark, "t").write(stage(spark, out, SF), "x")
        kept[name] = sorted((r.doc_id or -1, r.lang) for r in out.collect())
    assert kept["language_id"] == [(-1, "en"), (3, "en"), (3, "en"), (4, "de"), (8, "de")]
    assert kept["line_dedup"] == kept["near_dup"] == [(-1, "en"), (3, "en"), (4, "de"), (8, "de")]  # the second copy lost its only line
    assert set(kept["mix"]) <= set(kept["near_dup"]) and {r.nd_kept for r in out.collect()} == {7}
    assert kept["pieces"] == kept["mix"] and all(r.sp_n_tokens > 0 for r in out.collect())
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = Scratch(spark, "t").write(stage(spark, out, SF), "x")
        assert out.count() == 0 and {"doc_id", "lang", "source", "n_chars"} <= set(out.columns)
