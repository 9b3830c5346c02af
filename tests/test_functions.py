import difflib
import random

from pyspark.sql import functions as F

from lodestar.functions import classify as cl
from lodestar.functions import numeric as nu
from lodestar.functions import text as tx


def one(spark, col, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in cols.items()))
    return df.select(col.alias("x")).first().x if names else None


def test_normal_forms(spark):
    assert one(spark, tx.normalize(F.col("s")), s="  “Hello”  –  WORLD’s\n") == "\"hello\" - world's"
    assert one(spark, tx.normalize_exact(F.col("s")), s="Straße\x1cX") == "strasse x" == tx.normal("Straße\x1cX")
    assert one(spark, tx.plain_marks(F.col("s")), s="‘a’—“b”") == "'a'-\"b\""


def test_similarity_keeps_its_traps():
    assert tx.similarity("login users", "logins user") > 0.9  # no shared token
    assert tx.similarity("é", "é") == 0.0  # no token at all
    a, b = "the cart shall persist for " + "item " * 60, "the basket shall persist for " + "thing " * 60
    ja, jb = (" ".join(sorted(tx.token_list(x))) for x in (a, b))
    assert tx.similarity(a, b) == max(difflib.SequenceMatcher(None, ja, jb).ratio(), len(set(tx.token_list(a)) & set(tx.token_list(b))) / len(set(tx.token_list(a)) | set(tx.token_list(b))))


def test_polarity_columns_equal_python(spark):
    rnd = random.Random(3)
    vocab = "low high not shall store min max price list enable disable before after sort cart".split()
    rows = [(" ".join(rnd.choice(vocab) for _ in range(6)), " ".join(rnd.choice(vocab) for _ in range(6))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", tx.polarity_conflict(tx.has_negation(a), tx.tokens(a), tx.has_negation(b), tx.tokens(b)).alias("x")).collect()
    assert all(r.x == tx.opposite(r.a, r.b) for r in got) and {r.x for r in got} == {True, False}


def test_rendering(spark):
    assert one(spark, tx.to_shall_voice(F.col("s")), s="Must it? It must MUST.") == "Shall it? It shall Shall."
    assert one(spark, tx.md_cell(F.col("s")), s="a|b\n c") == "a\\|b c"
    assert one(spark, tx.pascal(F.col("s")), s="user ACCOUNT-id") == "UserAccountId"
    assert one(spark, tx.safe_component(F.col("s")), s=' a/b:"c". ') == "a_b__c_"
    assert [one(spark, tx.human_size(F.col("n")), n=float(n)) for n in (5, 2048, 5 << 20)] == ["5 B", "2.0 KB", "5.0 MB"]


def test_classifiers(spark):
    assert one(spark, cl.ears(F.col("s"))["pattern"], s="When x, the system shall do y.") == "event-driven"
    assert one(spark, cl.ears(F.col("s"))["ok"], s="It shall.") is False
    assert one(spark, cl.is_pointer(F.col("s")), s="The system shall comply with NFR-SEC-05.") is True
    assert one(spark, cl.is_pointer(F.col("s")), s="The system shall encrypt data in accordance with NFR-SEC-05.") is False
    assert one(spark, cl.scope_flag(F.col("s"))["reason"], s="Wishlist is Out-of-scope now") == 'source marks this out of scope ("Out-of-scope")'
    assert one(spark, F.array_join(cl.stated_tokens(F.col("s")), ","), s="we use java and next.js on the mern stack, not javascript") == "next.js,java,mern"
    assert one(spark, cl.signal_count(F.col("s"), ("chat", "spa")), s="chat chat space") == 3


def test_triage_adds_up(spark):
    none = F.array().cast("array<string>")
    x = cl.triage(F.lit(True), F.lit(0.0), none, F.array(F.lit("a")), F.lit(False), F.lit("constraint"), F.lit("could"), F.array(F.lit("")))
    r = spark.range(1).select(x.alias("x")).first().x
    assert (r.level, r.score) == ("attention", 3 + 2 + 2 + 1 + 1 + 1) and len(r.reasons) == 6


def test_numeric(spark):
    r = spark.range(1).select(nu.iou(F.lit(0), F.lit(10), F.lit(5), F.lit(15)).alias("a"), nu.coverage(F.lit(0), F.lit(10), F.lit(8), F.lit(30)).alias("b"), nu.contrast(F.lit("000000"), F.lit("ffffff")).alias("c"), nu.go_no_go(F.lit(0.8), F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(False)).alias("d")).first()
    assert (round(r.a, 6), r.b, round(r.c, 6), r.d) == (0.333333, 0.2, 21.0, "marginal")
