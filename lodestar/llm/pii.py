"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

All of it is DataFrame expressions; no Python runs on the executors.

Every kind has a pattern, a validator, a prior score, and words that speak for or against it within ``NEAR`` characters:
  * email, ip, card, phone are the base: what passes its validator (parts at most 255; 16 to 19 digits by Luhn; 8 to 15
    digits) stays whatever its score; the score is reported;
  * iban (ISO 13616, mod 97), pan (13 to 15 digits by Luhn), nid (3-2-4 digits with a possible area number), tel (a number in
    3-3-4 digits without a country code) and dob (a calendar date) are added if they pass and their score reaches ``LEAST``.
A score is the prior, plus ``CONFIRMED`` for a checksum that holds, plus ``FOR`` or minus ``AGAINST`` for a word of the kind's
list. So an iban needs its checksum alone, a pan its checksum and a word, and nid, tel and dob a word.

Patterns take possessive quantifiers and start at the edge of a run, so a text is scanned in linear time and without
recursion however long it is: where a pattern fails at a run's first character, it fails at the others too, for the
character after the run is the same. The matches are those of a leftmost, non-overlapping search. Places come from the lengths
of what ``split`` leaves between matches, so they are code points; the context is taken from these pieces as well,
so it never reaches into a neighbouring match of the same pattern.

Defined cases: a null or empty text has no spans; repeated rows each get their spans; texts of any length are scanned
whole; spans of different kinds may overlap; ties of kind and start cannot occur; an empty table gives an empty one.
Columns named ``pii_*`` are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, their digits, and the patterns
KINDS = ("email", "ip", "card", "phone", "iban", "pan", "nid", "tel", "dob")
BASE = 4
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Runs of fewer digits would be dropped anyway, at each of their starts.
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PAN = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
NID = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
TEL = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
DOB = r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[/.](?:0?[1-9]|1[0-2])[/.](?:19|20)[0-9]{2})(?![0-9/-])"

NEAR = 48
LEAST, CONFIRMED, FOR, AGAINST = 0.5, 0.4, 0.3, 0.3
#: Steps of running sums that are held in one array while the next are added.
RUN = 256
SPAN = "array<struct<k:int,s:int,e:int,score:double,m:string>>"


@dataclass(frozen=True)
class Kind:
    pattern: str
    gate: str
    valid: Callable[[Column], Column]
    prior: float
    checksum: bool = False
    words: str = ""
    doubts: str = ""
    inside: str = ""  # what stands before a match that belongs to a longer thing


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    return F.call_function("luhn_check", digits(m))


def digit_count(m: Column, low: int, high: int) -> Column:
    return F.length(digits(m)).between(low, high)


def mod97(m: Column) -> Column:
    """Whether the remainder of ISO 7064 is 1: the first four characters go to the end, letters count from 10."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v < 0, acc).otherwise((acc * F.when(v > 9, 100).otherwise(10) + v) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _words(*names: str) -> str:
    return r"(?iU)(?<!\p{L})(?:" + "|".join(names) + r")(?!\p{L})"


RULES = {
    "email": Kind(EMAIL, r"@[A-Za-z0-9-]+\.", lambda m: F.lit(True), 0.7, words=_words("e-?mail", "mail", "contact", "write to", "courriel", "correo")),
    "ip": Kind(IP, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", lambda m: m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"), 0.5, words=_words("ip", "host", "address", "login", "server", "client"), doubts=_words("version", "v", "section", "release")),
    "card": Kind(CARD, r"[0-9](?:[\x20-]?[0-9]){15}", lambda m: digit_count(m, 16, 19) & luhn(m), 0.2, True, _words("cards?", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"), _words("order", "invoice", "serial", "tracking")),
    "phone": Kind(PHONE, r"\+[0-9]", lambda m: digit_count(m, 8, 15), 0.5, words=_words("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "tel[eé]fono", "t[eé]l[eé]phone")),
    "iban": Kind(IBAN, r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{10}", mod97, 0.2, True, _words("iban", "account", "bank", "konto", "compte", "cuenta")),
    "pan": Kind(PAN, r"[0-9](?:[\x20-]?[0-9]){12}", lambda m: digit_count(m, 13, 15) & luhn(m), 0.0, True, _words("cards?", "visa", "amex", "american express", "credit", "debit", "carte", "karte", "tarjeta"), _words("order", "invoice", "serial", "tracking", "imei", "isbn", "ean")),
    "nid": Kind(NID, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: F.lit(True), 0.3, words=_words("ssn", "social security", "taxpayer", "national id", "itin"), doubts=_words("order", "part", "model", "serial")),
    "tel": Kind(TEL, r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", lambda m: F.lit(True), 0.3, words=_words("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "tel[eé]fono", "t[eé]l[eé]phone"), doubts=_words("order", "part", "serial", "invoice"), inside=r"\+[0-9][\x20().0-9-]*$"),
    "dob": Kind(DOB, r"(?:19|20)[0-9]{2}", lambda m: F.lit(True), 0.2, words=_words("born", "birth", "birthday", "dob", "n[eé]e?", "geboren", "geburtsdatum", "nacid[oa]", "nacimiento"), doubts=_words("released?", "published", "version")),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(steps: Column) -> Column:
    """Running sums of array<int>, in arrays of ``RUN``: adding to one long array would copy it at every step."""
    n = F.ceil(F.size(steps) / RUN).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda b: F.slice(steps, (b - 1) * RUN + 1, RUN))
    none = lambda kind, at: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def inner(at: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, none("array<int>", at), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))

    outer = lambda acc, chunk: _let(inner(acc["at"], chunk), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
    return F.aggregate(chunks, none("array<array<int>>", F.lit(0)), outer, lambda acc: F.flatten(acc["out"]))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, before, after>> of all matches of a pattern that never matches the empty string.

    s and e are code points, e exclusive; before and after are up to ``NEAR`` characters between it and its neighbours.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def places(x: Column) -> Column:
        steps = F.zip_with(x["m"], F.slice(x["gap"], 1, F.size(x["m"])), lambda m, g: F.length(m) + F.length(g))
        near = F.transform(x["gap"], lambda g: F.struct(F.right(g, F.lit(NEAR)).alias("tail"), F.left(g, F.lit(NEAR)).alias("head")))
        return F.struct(x["m"].alias("m"), running(steps).alias("e"), near.alias("near"))

    def spans(x: Column) -> Column:
        zipped = F.arrays_zip(x["m"].alias("m"), x["e"].alias("e"), F.slice(x["near"], 1, F.size(x["m"])).alias("b"), F.slice(x["near"], 2, F.size(x["m"])).alias("a"))
        return F.transform(zipped, lambda y: F.struct((y["e"] - F.length(y["m"])).alias("s"), y["e"].alias("e"), y["m"].alias("m"), y["b"]["tail"].alias("before"), y["a"]["head"].alias("after")))

    return _let(_let(both, places), spans)


def propose(text: Column, name: str) -> Column:
    """Validated and scored spans of one kind: array<struct<k, s, e, score, m>>."""
    rule = RULES[name]
    none = F.array().cast(SPAN)
    found = F.filter(matches(text, rule.pattern), lambda x: rule.valid(x["m"]))
    if rule.inside:
        found = F.filter(found, lambda x: ~x["before"].rlike(rule.inside))

    def scored(x: Column) -> Column:
        score = F.lit(rule.prior + CONFIRMED * rule.checksum)
        near = lambda words: x["before"].rlike(words) | x["after"].rlike(words)
        score = score + F.when(near(rule.words), FOR).otherwise(0.0)
        if rule.doubts:
            score = score - F.when(near(rule.doubts), AGAINST).otherwise(0.0)
        bounded = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6)
        return F.struct(F.lit(KINDS.index(name)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), bounded.alias("score"), x["m"].alias("m"))

    out = F.transform(found, scored)
    if KINDS.index(name) >= BASE:
        out = F.filter(out, lambda x: x["score"] >= LEAST)
    return F.when(text.rlike(rule.gate), out).otherwise(none)


def scan(docs: DataFrame, *, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with pii_spans, array<struct<k, s, e, score, m>> by kind (place in ``KINDS``), then start."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("pii_")])
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("pii_spans", F.concat(F.array().cast(SPAN), *[propose(t, k) for k in KINDS if k in kinds]))


def render(spans: Column) -> Column:
    """kind:start:end, joined by commas, in the order of the array."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op11_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda x: x["k"] < BASE)
    n = lambda kind: F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform(spans, lambda x: x["score"].cast("string")), ",").alias("scores")
    return scan(docs).select("doc_id", *[n(k) for k in KINDS[:BASE]], F.sha2(F.encode(render(base), "UTF-8"), 256).alias("base_sha256"), render(spans).alias("spans"), scores)
