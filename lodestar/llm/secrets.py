"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

All of it is DataFrame expressions; no Python runs on the executors.

Fixed patterns (kinds assign, access, hex) give the base spans, leftmost and non-overlapping per kind. Places of
matches come from the lengths of what ``split`` leaves between them, so they are code points.

The battery looks at candidates: what base spans leave of maximal runs of token characters, in pieces of at least
``MIN_LEN`` with letters and digits. The encoding is inferred from the characters: hex, base32, base36 (letters of one
case), base36 with two signs, or base64 (standard or URL-safe). Every candidate has one. A candidate is a discovery if
it is shown to be random; so each test has the null hypothesis "not random in this respect, by at least a margin",
and its p-value is the chance, at the margin, of a statistic that looks as random (an equivalence test):
  * uniformity: Pearson's chi-squared over the alphabet of k characters, which counts pairs of equal characters. Null:
    two characters agree with chance at least 1/k + ``COLLISION`` (English letters: 0.0655). The number of equal pairs
    then has a known mean and variance (``TRIPLE`` is the chance that three agree over the square of that for two;
    English letters: 1.25); its lower tail by the Wilson-Hilferty cube root with these moments;
  * runs of characters from the lower and upper half of the alphabet (Wald-Wolfowitz). Null: the share of places where
    the half changes is off its expectation by at least ``RUNS`` (0.5: always or never); two one-sided normal tails;
  * serial correlation of neighbouring characters' numbers. Null: at least ``SERIAL`` in size; likewise.
"Structured" means that any of the nulls holds, so the p-value of a candidate is the largest of the three (an
intersection-union test, valid without independence). All three shrink with the length. Candidates are split into length bands; in each band the Benjamini-Hochberg step-up at ``FDR``
decides on a histogram of log p-values, whose size does not depend on the data; a bin counts with its upper edge.

Texts are scanned once: spans and the candidates' bins are written without the texts, and the step-up's cuts are
applied to what was written.

Defined cases: a null text counts as empty and has no spans; repeated rows each get their spans; texts of any
length are scanned whole; spans of different kinds may overlap, and ties of start and end are ordered by kind; an
empty table gives an empty one. Columns named ``sec_*`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.runtime import Scratch

# The base patterns, their least lengths, and their order
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

MIN_LEN = 20
#: Margins: chance of equal characters over 1/k, share of half changes, size of the serial correlation.
COLLISION, RUNS, SERIAL = 1 / 32, 0.4, 0.8
TRIPLE = 1.5
FDR = 0.01
BAND, BINS = 16, 400
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base38": "0123456789abcdefghijklmnopqrstuvwxyz+/",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<s, e, m, g>> of all matches of a pattern that never matches the empty string, in order.

    s and e are code points, e exclusive; m is the match and g the wanted group.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.arrays_zip(found.alias("m"), inner.alias("g"), gaps.alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string,g:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        span = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["g"].alias("g"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # the last gap has no match after it
    return F.aggregate(F.filter(steps, lambda x: x["m"].isNotNull()), start, add, lambda acc: acc["out"])


def _spans(text: Column, kind: str, pattern: str, keep, group: int | None = None, gate: str | None = None) -> Column:
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    found = F.transform(F.filter(_matches(text, pattern, group), keep), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    return F.when(text.rlike(gate or pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> of the fixed patterns' spans."""
    # the gates hold whenever a match that is kept exists, and spare most texts the walk over their matches
    return F.concat(
        _spans(text, "assign", ASSIGN, lambda x: F.length(x["g"]) >= ASSIGN_LEAST, 2),
        _spans(text, "access", ACCESS, lambda x: F.length(x["m"]) >= ACCESS_LEAST, gate="AKIA[A-Z0-9]{16}"),
        # a run of 24 or more is the same match, and shorter runs would only be dropped
        _spans(text, "hex", HEX.replace("+", f"{{{HEX_LEAST},}}"), lambda x: F.length(x["m"]) >= HEX_LEAST),
    )


def render(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count_of(text: Column, piece: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)


def log_tail(z: Column) -> Column:
    """log10 of the upper normal tail, never below it: sqrt(2/pi) exp(-z^2/2) / (z + sqrt(z^2 + 8/pi)) for z >= 0, by reflection below."""
    upper = lambda x: F.lit(math.log10(math.sqrt(2 / math.pi))) - x * x / (2 * math.log(10)) - F.log10(x + F.sqrt(x * x + 8 / math.pi))
    return F.when(z >= 0, upper(z)).otherwise(F.log10(1 - F.pow(F.lit(10.0), upper(-z)) / 1.05))


def _encoding(tok: Column) -> Column:
    has = lambda p: tok.rlike(p)
    return (
        F.when(has(r"^[0-9a-fA-F]+$"), F.lit("hex"))
        .when(has("^([A-Z2-7]+|[a-z2-7]+)$"), F.lit("base32"))
        .when(has("^([A-Z0-9]+|[a-z0-9]+)$"), F.lit("base36"))
        .when(has("[A-Z]") & has("[a-z]"), F.lit("base64"))
        .otherwise(F.lit("base38"))
    )


def battery(found: Column) -> Column:
    """Candidates, array<struct<s, e, m, ..>>, with their encoding and the three log10 p-values: struct<s, e, n, enc, chi, runs, serial>.

    Each step binds what the next one reads several times.
    """
    letters = F.map_from_arrays(F.array(*[F.lit(e) for e in ALPHABETS]), F.array(*[F.lit(a) for a in ALPHABETS.values()]))

    def spelled(x: Column) -> Column:
        # one spelling per encoding: one case but for base64, URL-safe signs as standard
        signs = F.translate(x["m"], "-_", "+/")
        plain = F.when(x["enc"] == "base32", F.upper(x["m"])).when(x["enc"] == "base64", signs).otherwise(F.lower(signs))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["enc"].alias("enc"), plain.alias("plain"), F.element_at(letters, x["enc"]).alias("a"))

    def coded(x: Column) -> Column:
        code = F.filter(F.transform(F.split(x["plain"], ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(x["a"], c))), lambda i: i > 0)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["enc"].alias("enc"), F.length(x["a"]).cast("double").alias("k"), code.alias("code"), F.length(x["plain"]).cast("double").alias("n"))

    def counted(x: Column) -> Column:
        run = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("pairs"))

        def equal(acc: Column, c: Column) -> Column:  # in sorted order a character meets the equal ones before it
            before = F.when(acc["last"] == c, acc["run"]).otherwise(F.lit(0).cast("long"))
            return F.struct(c.alias("last"), (before + 1).alias("run"), (acc["pairs"] + before).alias("pairs"))

        ahead = F.slice(x["code"], 2, F.greatest(F.size(x["code"]), F.lit(1)))
        behind = F.slice(x["code"], 1, F.greatest(F.size(x["code"]) - 1, F.lit(0)))
        low, mid = lambda c: c <= F.floor(x["k"] / 2), (x["k"] + 1) / 2
        change = F.aggregate(F.zip_with(behind, ahead, lambda c, d: (low(c) != low(d)).cast("int")), F.lit(0), lambda acc, y: acc + y)
        serial = F.aggregate(F.zip_with(behind, ahead, lambda c, d: (c - mid) * (d - mid)), F.lit(0.0), lambda acc, y: acc + y)
        keep = [x[c].alias(c) for c in ("s", "e", "enc", "k", "n")]
        pairs = F.aggregate(F.array_sort(x["code"]), run, equal, lambda acc: acc["pairs"])
        return F.struct(*keep, pairs.alias("pairs"), F.size(F.filter(x["code"], lambda c: ~low(c))).alias("ones"), change.alias("change"), serial.alias("serial"))

    def tested(x: Column) -> Column:
        n, k = x["n"], x["k"]
        p2 = 1 / k + COLLISION
        p3 = TRIPLE * p2 * p2
        mean = n * (n - 1) / 2 * p2
        var = n * (n - 1) / 2 * (p2 - p2 * p2) + n * (n - 1) * (n - 2) * (p3 - p2 * p2)
        s = var / (9 * mean * mean)
        z_chi = (F.pow((x["pairs"] + 0.5) / mean, F.lit(1 / 3)) - (1 - s)) / F.sqrt(s)
        off = F.abs(x["change"] / (n - 1) - 2 * x["ones"] * (n - x["ones"]) / (n * (n - 1)))
        r = x["serial"] / ((k * k - 1) / 12) / (n - 1)
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), n.cast("int").alias("n"), x["enc"].alias("enc"),
            log_tail(-z_chi).alias("chi"),
            # the share of changes has a deviation of at most 1 / (2 sqrt(n - 1))
            log_tail((RUNS - off) * 2 * F.sqrt(n - 1)).alias("runs"),
            log_tail((SERIAL - F.abs(r)) * F.sqrt(n - 1)).alias("serial"),
        )

    named = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _encoding(x["m"]).alias("enc")))
    for step in (spelled, coded, counted, tested):
        named = F.transform(named, step)
    return named


def p_bin(tests: Column) -> Column:
    """Bin of the combined p-value: bin b holds p with 10^-(b+1)/10 < p <= 10^-b/10."""
    worst = F.greatest(tests["chi"], tests["runs"], tests["serial"])
    return F.least(F.floor(F.greatest(-worst, F.lit(0.0)) * 10), F.lit(BINS - 1)).cast("int")


def _step_up(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Benjamini-Hochberg in every length band, on a histogram: (sec_band, sec_cut), keep bins from the cut on."""
    hist = scratch.write(found.groupBy("sec_band", "sec_bin").count(), "histogram")  # at most 17 bands by BINS rows
    order = W.partitionBy("sec_band").orderBy(F.desc("sec_bin")).rowsBetween(W.unboundedPreceding, 0)
    seen = hist.withColumn("upto", F.sum("count").over(order)).withColumn("all", F.sum("count").over(W.partitionBy("sec_band")))
    worst = F.pow(F.lit(10.0), -F.col("sec_bin") / 10)
    return seen.filter(worst <= F.col("upto") / F.col("all") * FDR).groupBy("sec_band").agg(F.min("sec_bin").alias("sec_cut"))


def _meet(x: Column, y: Column) -> Column:
    return (y["s"] < x["e"]) & (x["s"] < y["e"])


def _rest(x: Column) -> Column:
    """What the spans of sec_base leave of a run, as structs like it (g is empty)."""
    piece = lambda s, e: F.struct(s.alias("s"), e.alias("e"), F.substring(x["m"], s - x["s"] + 1, e - s).alias("m"), F.lit("").alias("g"))
    start = F.struct(x["s"].alias("at"), F.array().cast("array<struct<s:int,e:int,m:string,g:string>>").alias("out"))

    def cut(acc: Column, y: Column) -> Column:
        return F.struct(F.greatest(acc["at"], y["e"]).alias("at"), F.when(acc["at"] < y["s"], F.concat(acc["out"], F.array(piece(acc["at"], y["s"])))).otherwise(acc["out"]).alias("out"))

    spans = F.sort_array(F.filter("sec_base", lambda y: _meet(x, y)))
    return F.aggregate(spans, start, cut, lambda acc: F.when(acc["at"] < x["e"], F.concat(acc["out"], F.array(piece(acc["at"], x["e"])))).otherwise(acc["out"]))


def scan(docs: DataFrame, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with sec_base and sec_all, arrays of struct<s, k, e> (k: place in ``KINDS``), with or without the text."""
    scratch = Scratch(docs.sparkSession, "secrets")
    docs = docs.drop(*[c for c in docs.columns if c.startswith("sec_")])
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn("sec_base", base_spans(t))
    none = F.array().cast("array<struct<s:int,e:int,m:string,g:string>>")
    encoded = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    runs = F.when(t.rlike(CANDIDATE), F.filter(_matches(t, CANDIDATE), lambda x: encoded(x["m"]))).otherwise(none)
    pieces = F.flatten(F.transform(runs, lambda x: F.when(F.exists("sec_base", lambda y: _meet(x, y)), _rest(x)).otherwise(F.array(x))))
    clear = F.filter(pieces, lambda x: (F.length(x["m"]) >= MIN_LEN) & encoded(x["m"]))
    judged = F.transform(battery(clear), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.floor(F.least(x["n"], F.lit(256)) / BAND).cast("int").alias("sec_band"), p_bin(x).alias("sec_bin")))
    found = base.withColumn("sec_found", judged)
    found = scratch.write(found if keep_text else found.drop(text), "found")
    # every candidate of the corpus takes part in the step-up
    cuts = _step_up(found.select(F.explode("sec_found").alias("c")).select("c.sec_band", "c.sec_bin"), scratch).collect()  # one row for each of at most 17 length bands

    def keep(x: Column) -> Column:
        cut = F.lit(BINS)
        for r in cuts:
            cut = F.when(x["sec_band"] == r["sec_band"], F.lit(r["sec_cut"])).otherwise(cut)
        return x["sec_bin"] >= cut

    extra = F.transform(F.filter("sec_found", keep), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index("random")).alias("k"), x["e"].alias("e")))
    return found.withColumn("sec_all", F.concat("sec_base", extra)).drop("sec_found")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs, keep_text=False)
    n = lambda kind: F.size(F.filter("sec_base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.encode(render(F.col("sec_base")), "UTF-8"), 256).alias("base_sha256"), render(F.col("sec_all")).alias("spans"))
