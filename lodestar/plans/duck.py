"""Pieces of DuckDB SQL built from the same lexicons as the Spark columns, for the oracle side only."""

from __future__ import annotations

from lodestar import lexicons as lex


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def m(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def rules(expr: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {m(expr, p)} THEN {q(label)}" for label, p in pairs) + f" ELSE {default} END"


def has_any(expr: str, keys) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(k)})" for k in keys) + ")"


def norm(expr: str) -> str:
    return f"lower(trim(regexp_replace(translate({expr}, {q(lex.NORMALIZE_FROM)}, {q(lex.NORMALIZE_TO)}), '\\s+', ' ', 'g')))"


def toks(expr: str) -> str:
    return f"regexp_extract_all({norm(expr)}, '[a-z0-9]+')"


def kept(expr: str, longer: int, stop) -> str:
    return f"list_distinct(list_filter({expr}, lambda w: length(w) > {longer} AND NOT list_contains({arr(stop)}, w)))"


def weak(expr: str) -> str:
    words = f"regexp_extract_all(lower({expr}), {q(chr(92) + 'b(' + '|'.join(lex.WEAK_WORDS) + ')' + chr(92) + 'b')})"
    phrases = f"list_transform(list_filter({arr(lex.WEAK_PHRASES)}, lambda p: contains(lower({expr}), p)), lambda p: trim(p))"
    return f"list_sort(list_distinct(list_concat({words}, {phrases})))"


MODAL = r"(?i)\b(?:shall|must|will)\b"


def ears_ok(expr: str) -> str:
    rest = f"regexp_replace(regexp_extract({expr}, {q('(?is)' + MODAL[4:] + '(.*)$')}, 1), '^[ .\t\n]+|[ .\t\n]+$', '', 'g')"
    return f"({m(expr, MODAL)} AND CASE WHEN {rest} = '' THEN 0 ELSE len(regexp_split_to_array({rest}, '\\s+')) END >= 2)"


def ears_pattern(expr: str) -> str:
    s = lambda w: m(expr, rf"(?i)^\s*{w}\b")
    return (
        f"CASE WHEN NOT {m(expr, MODAL)} THEN NULL WHEN NOT {ears_ok(expr)} THEN 'ubiquitous' WHEN {s('when')} THEN 'event-driven' WHEN {s('while')} THEN 'state-driven' "
        f"WHEN {s('where')} THEN 'optional-feature' WHEN {s('if')} AND {m(expr, '(?i)' + chr(92) + 'bthen' + chr(92) + 'b')} THEN 'unwanted-behavior' ELSE 'ubiquitous' END"
    )


def flags(expr: str) -> str:
    f = f"list_transform({weak(expr)}, lambda w: 'weak-word:' || w)"
    return f"CASE WHEN {ears_ok(expr)} THEN {f} ELSE list_concat({f}, ['not-EARS-conformant']) END"


def priority(s: str, rtype: str, inferred: str) -> str:
    return (
        f"CASE WHEN {m(s, lex.OPTIONAL_CUE)} THEN 'could' WHEN {m(s, lex.MUST_DOMAIN)} THEN 'must' WHEN {m(s, lex.CORE_DOMAIN)} THEN 'must' WHEN {inferred} THEN 'could' "
        f"WHEN {m(s, lex.SOFT_MODAL)} AND NOT {m(s, lex.HARD_MODAL)} THEN 'could' WHEN {rtype} IN ('business', 'constraint') THEN 'must' ELSE 'should' END"
    )


def owner(s: str, feature: str, rtype: str, nfr: str) -> str:
    hay = f"lower({s} || ' ' || coalesce({feature}, '') || ' ' || coalesce({nfr}, ''))"
    return rules(hay, lex.OWNERS, f"CASE WHEN {rtype} = 'non_functional' THEN 'Engineering' WHEN {rtype} IN ('business', 'constraint') THEN 'Product / Sponsor' ELSE 'Product Owner' END")


def scope(s: str, what: str) -> str:
    out = []
    for flag, reason, patterns in lex.SCOPE_MARKERS:
        for p in patterns:
            value = q(flag) if what == "flag" else q(reason + ' ("') + f" || trim(regexp_extract({s}, {q('(?i)(' + p + ')')}, 1)) || '\")'"
            out.append(f"WHEN {m(s, '(?i)' + p)} THEN {value}")
    return "CASE " + " ".join(out) + " END"


def genuine(s: str) -> str:
    out = [f"WHEN contains(lower({s}), {q(p)}) THEN " + q(f"reads as document meta/disclaimer ('{p}')") for p in lex.META_PHRASES]
    out += [f"WHEN {m(s, p)} THEN " + q(f"document metadata, not a requirement ({label})") for label, p in lex.JUNK_SHAPES]
    out.append(f"WHEN {m(s, lex.DATE_TEXT)} AND NOT {m(s, lex.FILTER_OBLIGATION)} AND NOT {m(s, lex.PRODUCT_VERB)} THEN 'document metadata, not a requirement (dated byline / metadata line (no obligation))'")
    out.append(f"WHEN {m(s, lex.META_SUBJECT)} AND NOT {m(s, lex.PRODUCT_VERB)} THEN 'statement is about the document/section itself, not a product obligation'")
    return "CASE " + " ".join(out) + " END"


def pointer(s: str) -> str:
    rest = kept(f"regexp_extract_all(lower(regexp_replace({s}, {q(lex.POINTER_CLAUSE)}, ' ', 'g')), '[a-z0-9]+')", 2, lex.EMPTY_WORDS)
    return f"({m(s, lex.POINTER_CLAUSE)} AND len({rest}) = 0)"


def feature(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    return f"CASE WHEN trim({low}) = '' THEN {q(lex.FEATURE_DEFAULT)} " + " ".join(f"WHEN {has_any(low, keys)} THEN {q(label)}" for label, keys in lex.FEATURE_BUCKETS) + f" ELSE trim({c}) END"


def nfr_section(c: str) -> str:
    return f"CASE coalesce({c}, '') " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lex.NFR_SECTIONS.items()) + f" ELSE {q(lex.NFR_DEFAULT)} END"


def section(rtype: str, feat: str, nfr: str) -> str:
    return (
        f"CASE WHEN {rtype} = 'functional' THEN '4. System Features > ' || {feature(feat)} WHEN {rtype} = 'non_functional' THEN {nfr_section(nfr)} "
        + " ".join(f"WHEN {rtype} = {q(t)} THEN {q(s)}" for t, s in lex.TYPE_SECTIONS.items())
        + f" ELSE {q(lex.SECTION_DEFAULT)} END"
    )


def triage_score(s: str) -> str:
    """Over the view's columns, with ``twin`` as its only conflict and one location."""
    return (
        f"(CASE WHEN inferred THEN 3 ELSE 0 END + CASE WHEN confidence > 0 AND confidence < 0.5 THEN 2 WHEN confidence >= 0.5 AND confidence < 0.75 THEN 1 ELSE 0 END "
        f"+ CASE WHEN twin IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN len({flags(s)}) > 0 THEN 2 ELSE 0 END "
        f"+ CASE WHEN {ears_ok(s)} AND len({weak(s)}) = 0 THEN 0 ELSE 2 END + CASE WHEN rtype IN ('constraint', 'assumption') THEN 1 ELSE 0 END "
        f"+ CASE WHEN {priority(s, 'rtype', 'inferred')} = 'could' THEN 1 ELSE 0 END + CASE WHEN location IN ('', '(top)', '(para)', '(heading)', '(intro)') THEN 1 ELSE 0 END)"
    )


def level(score: str) -> str:
    return f"CASE WHEN {score} >= 3 THEN 'attention' WHEN {score} >= 1 THEN 'review' ELSE 'routine' END"


def opposite(na: str, ta: str, nb: str, tb: str) -> str:
    has = lambda t, w: f"list_contains({t}, {q(w)})"
    pos = lambda t, w: f"list_position({t}, {q(w)})"
    out = [f"({na}) <> ({nb})"]
    for x, y in lex.OPPOSITES:
        ax, ay, bx, by = has(ta, x), has(ta, y), has(tb, x), has(tb, y)
        out.append(f"({ax} AND NOT {ay} AND {by} AND NOT {bx}) OR ({ay} AND NOT {ax} AND {bx} AND NOT {by}) OR ({ax} AND {ay} AND {bx} AND {by} AND ({pos(ta, x)} < {pos(ta, y)}) <> ({pos(tb, x)} < {pos(tb, y)}))")
    return "(" + " OR ".join(out) + ")"
