"""Rule classifiers as columns: first match wins, lexicons come from ``lexicons``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions.text import any_of, content_terms, words_literal


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_match(c: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """Label of the first rule (label, pattern) that matches."""
    out = None
    for label, pattern in rules:
        out = F.when(c.rlike(pattern), F.lit(label)) if out is None else out.when(c.rlike(pattern), F.lit(label))
    return out.otherwise(default)


def contains_any(c: Column, keys) -> Column:
    return any_of([F.contains(c, F.lit(k)) for k in keys])


# --- wording quality ---


def weak_terms(c: Column) -> Column:
    """Sorted distinct weak words (whole words) and phrases (anywhere)."""
    s = F.lower(_text(c))
    pattern = r"\b(" + "|".join(lex.WEAK_WORDS) + r")\b"
    words = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    phrases = F.filter(words_literal(lex.WEAK_PHRASES), lambda p: F.contains(s, p))
    return F.array_sort(F.array_distinct(F.concat(words, F.transform(phrases, lambda p: F.trim(p)))))


def ears(c: Column) -> Column:
    """struct<ok, pattern>: whether an obligation has a response clause, and the sentence pattern."""
    t = F.trim(_text(c))
    rest = F.regexp_extract(t, r"(?is)\b(?:shall|must|will)\b(.*)$", 1)
    inner = F.regexp_replace(rest, r"^[ .\t\n]+|[ .\t\n]+$", "")
    n = F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"\s+")))
    starts = lambda w: t.rlike(rf"(?i)^\s*{w}\b")
    pattern = (
        F.when(starts("when"), "event-driven").when(starts("while"), "state-driven").when(starts("where"), "optional-feature")
        .when(starts("if") & t.rlike(r"(?i)\bthen\b"), "unwanted-behavior").otherwise("ubiquitous")
    )
    out = lambda ok, p: F.struct(F.lit(ok).alias("ok"), p.alias("pattern"))
    return F.when(~t.rlike(r"(?i)\b(?:shall|must|will)\b"), out(False, F.lit(None).cast("string"))).when(n < 2, out(False, F.lit("ubiquitous"))).otherwise(out(True, pattern))


def quality_flags(c: Column) -> Column:
    flags = F.transform(weak_terms(c), lambda w: F.concat(F.lit("weak-word:"), w))
    return F.when(ears(c)["ok"], flags).otherwise(F.concat(flags, F.array(F.lit("not-EARS-conformant"))))


def quality_score(c: Column) -> Column:
    return F.lit(1.0) - F.when(F.size(weak_terms(c)) > 0, 0.4).otherwise(0.0) - F.when(ears(c)["ok"], 0.0).otherwise(0.4)


def testable(c: Column) -> Column:
    return ears(c)["ok"] & (F.size(weak_terms(c)) == 0)


def cosmetic(c: Column) -> Column:
    """White space collapsed and a full stop added where no end mark stands."""
    s = F.trim(F.regexp_replace(_text(c), r"\s+", " "))
    return F.when((s != "") & ~s.rlike(r"[.!?]$"), F.concat(s, F.lit("."))).otherwise(s)


def substantive_flags(flags: Column) -> Column:
    return F.filter(flags, lambda f: ~f.rlike(lex.MECHANICAL_FLAG))


def first_modal(c: Column) -> Column:
    low = F.lower(_text(c))
    out = F.when(low.rlike(r"\bshall\b"), "shall")
    for m in lex.MODALS[1:]:
        out = out.when(low.rlike(rf"\b{m}\b"), m)
    return out.otherwise("")


# --- scope, priority, owner, genuineness ---


def scope_flag(evidence: Column) -> Column:
    """struct<flag, reason> of the strongest scope marker in the evidence, else null."""
    none = F.struct(F.lit(None).cast("string").alias("flag"), F.lit(None).cast("string").alias("reason"))
    each = [(flag, reason, p) for flag, reason, patterns in lex.SCOPE_MARKERS for p in patterns]
    # one pattern tells most texts apart; the markers are looked at one by one, in an array (so that the generated code stays short), for the rest
    marks = F.array(*[F.struct(F.lit(flag).alias("flag"), F.lit(reason).alias("why"), F.regexp_extract(evidence, f"(?i)({p})", 1).alias("hit")) for flag, reason, p in each])
    first = F.filter(marks, lambda m: m["hit"] != "")
    named = F.get(F.transform(F.slice(first, 1, 1), lambda m: F.struct(m["flag"].alias("flag"), F.concat(m["why"], F.lit(' ("'), F.trim(m["hit"]), F.lit('")')).alias("reason"))), F.lit(0))
    return F.coalesce(F.when(evidence.rlike("(?i)" + "|".join(f"(?:{p})" for _, _, p in each)), named), none)


def moscow(c: Column, rtype: Column, inferred: Column) -> Column:
    s = _text(c)
    return (
        F.when(s.rlike(lex.OPTIONAL_CUE), "could").when(s.rlike(lex.MUST_DOMAIN), "must").when(s.rlike(lex.CORE_DOMAIN), "must").when(inferred, "could")
        .when(s.rlike(lex.SOFT_MODAL) & ~s.rlike(lex.HARD_MODAL), "could").when(rtype.isin("business", "constraint"), "must").otherwise("should")
    )


def owner(c: Column, feature: Column, rtype: Column, nfr: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", _text(c), _text(feature), _text(nfr)))
    by_type = F.when(rtype == "non_functional", "Engineering").when(rtype.isin("business", "constraint"), "Product / Sponsor").otherwise(lex.OWNER_DEFAULT)
    return first_match(hay, lex.OWNERS, by_type)


def genuine(c: Column) -> Column:
    """Reason why a statement is no requirement, or null."""
    s = F.trim(_text(c))
    low = F.lower(s)
    out = None
    for p in lex.META_PHRASES:
        value = F.lit(f"reads as document meta/disclaimer ('{p}')")
        out = F.when(F.contains(low, F.lit(p)), value) if out is None else out.when(F.contains(low, F.lit(p)), value)
    for label, pattern in lex.JUNK_SHAPES:
        out = out.when(s.rlike(pattern), F.lit(f"document metadata, not a requirement ({label})"))
    dated = s.rlike(lex.DATE_TEXT) & ~s.rlike(lex.FILTER_OBLIGATION) & ~s.rlike(lex.PRODUCT_VERB)
    out = out.when(dated, F.lit("document metadata, not a requirement (dated byline / metadata line (no obligation))"))
    return out.when(s.rlike(lex.META_SUBJECT) & ~s.rlike(lex.PRODUCT_VERB), F.lit("statement is about the document/section itself, not a product obligation"))


def is_pointer(c: Column) -> Column:
    """Nothing of substance is left without the cross-reference."""
    s = _text(c)
    return s.rlike(lex.POINTER_CLAUSE) & (F.size(content_terms(F.regexp_replace(s, lex.POINTER_CLAUSE, " "))) == 0)


def expects_nothing(text: Column, location: Column) -> Column:
    """A chunk that carries no requirement: blank, heading, front matter or without a cue."""
    t = F.trim(_text(text))
    return (t == "") | t.startswith("#") | _text(location).rlike(lex.FRONT_MATTER) | ~t.rlike(lex.COVERAGE_CUE)


# --- triage ---


def triage(inferred: Column, confidence: Column, conflicts: Column, flags: Column, testable_: Column, rtype: Column, priority: Column, locations: Column) -> Column:
    """struct<level, score, reasons>; ``conflicts`` and ``locations`` are arrays."""
    conf = F.coalesce(confidence, F.lit(0.0))
    coarse = (F.size(locations) > 0) & F.forall(locations, lambda x: F.coalesce(x, F.lit("")).isin(*lex.COARSE_LOCATIONS))
    parts = [
        (3, inferred, F.lit("inferred / tentative — never auto-accept")),
        (2, (conf > 0) & (conf < 0.5), F.format_string("low extractor confidence (%.2f)", conf)),
        (1, (conf >= 0.5) & (conf < 0.75), F.format_string("moderate confidence (%.2f)", conf)),
        (3, F.size(conflicts) > 0, F.lit("part of a flagged conflict")),
        (2, F.size(flags) > 0, F.concat(F.lit("ambiguity: "), F.array_join(F.slice(flags, 1, 3), ", "))),
        (2, ~testable_, F.lit("not testable as written")),
        (1, rtype.isin("constraint", "assumption"), F.concat(rtype, F.lit(" — confirm with the owner"))),
        (1, priority == "could", F.lit("low priority (could)")),
        (1, coarse, F.lit("coarse traceability (no precise section)")),
    ]
    score = sum((F.when(test, n).otherwise(0) for n, test, _ in parts[1:]), F.when(parts[0][1], parts[0][0]).otherwise(0))
    reasons = F.filter(F.array(*[F.when(test, reason) for _, test, reason in parts]), lambda x: x.isNotNull())
    level = F.when(score >= 3, "attention").when(score >= 1, "review").otherwise("routine")
    return F.struct(level.alias("level"), score.alias("score"), reasons.alias("reasons"))


# --- document placement ---


def canonical_feature(c: Column) -> Column:
    low = F.lower(_text(c))
    out = F.when(F.trim(low) == "", F.lit(lex.FEATURE_DEFAULT))
    for label, keys in lex.FEATURE_BUCKETS:
        out = out.when(contains_any(low, keys), F.lit(label))
    return out.otherwise(F.trim(c))


def nfr_section(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in lex.NFR_SECTIONS.items() for x in kv])[_text(c)], F.lit(lex.NFR_DEFAULT))


def section(rtype: Column, feature: Column, nfr: Column) -> Column:
    out = F.when(rtype == "functional", F.concat(F.lit("4. System Features > "), canonical_feature(feature))).when(rtype == "non_functional", nfr_section(nfr))
    for t, s in lex.TYPE_SECTIONS.items():
        out = out.when(rtype == t, F.lit(s))
    return out.otherwise(F.lit(lex.SECTION_DEFAULT))


def wellformed(c: Column) -> Column:
    return F.trim(_text(c)).rlike(r"^\p{Lu}") & _text(c).rlike(r"(?i)\b(?:shall|must|will)\b")


# --- decisions and stack ---


def has_alternatives(c: Column) -> Column:
    return _text(c).rlike(lex.ALTERNATIVES)


def stated_tokens(text: Column) -> Column:
    """Technology names that stand alone in a lower-case text, in lexicon order, then named stacks."""
    names = [t for group in lex.TECH_TOKENS.values() for t in group]
    alone = lambda t: text.rlike(rf"(?<![a-z0-9]){t.replace('.', chr(92) + '.')}(?![a-z0-9])")
    found = [F.when(alone(t), F.lit(t)) for t in names] + [F.when(F.contains(text, F.lit(f"{n} stack")), F.lit(n)) for n in lex.STACK_NAMES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def stack_is_stated(text: Column, found: Column) -> Column:
    return contains_any(text, [f"{n} stack" for n in lex.STACK_NAMES]) | ((F.size(found) > 0) & contains_any(text, lex.STACK_CUES))


def signal_count(text: Column, signals) -> Column:
    """Occurrences of all signals, each counted without overlap."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s) for s in signals[1:]), (F.length(text) - F.length(F.replace(text, F.lit(signals[0]), F.lit("")))) / len(signals[0])).cast("long")


def is_excluded_aspect(key: Column, title: Column) -> Column:
    return F.lower(F.trim(_text(key))).isin(*lex.EXCLUDED_ASPECTS) | contains_any(F.lower(_text(title)), lex.EXCLUDED_TITLES)
