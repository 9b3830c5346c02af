"""Statement similarity joins within a project: lossless, on classes of equal wording, without a Python call per pair of rows.

The score ``max(token Jaccard, sequence ratio of the sorted tokens)`` depends on the normal form alone, so rows collapse to *forms*
first and only forms are compared. A pair of forms is found in one of two ways:

* by its tokens: the Jaccard part is a prefix join on rare tokens (``overlap_pairs``), native and exact;
* by its ratio 2M/T, where M characters match and T is the sum of lengths: forms are sorted by length and cut into blocks, and only
  block pairs whose lengths can reach the threshold meet. Inside, bounds of growing cost discard pairs for many at once: lengths,
  common characters as multisets, and the longest common subsequence (bit-parallel), for matching blocks never
  cross. What is left is scored exactly. No bound discards a pair that reaches the threshold.

Characters of short texts are too alike for a selective index: at thresholds under about 0.6 most pairs of similar length stay, and
the ratio side costs a small constant for every pair of a project's forms in the length band.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import lexicons as lex
from lodestar.functions import text as tx
from lodestar.operators.graph import connected_components
from lodestar.operators.ranking import numbered
from lodestar.runtime import Scratch, spread

BLOCK = 256
#: Copies of a set of terms that one row carries while pairs are expanded.
COPIES = 256
#: Words of 64 bits that one pass over pairs holds, and the longest text for which common subsequences are computed.
PAIR_WORDS, LONGEST = 1 << 18, 2048


def with_form(rows: DataFrame, group: str = "project_id") -> DataFrame:
    """``rows`` (group, idx, statement, ...) with ``norm`` and ``form``: the smallest idx of the group's rows of equal normal form."""
    named = spread(rows, group, "statement").withColumn("norm", F.coalesce(tx.normalize_exact("statement"), F.lit("")))
    first = named.groupBy(group, "norm").agg(F.min(F.col("idx").cast("long")).alias("form"))
    return named.join(first, [group, "norm"])


def forms_of(rows: DataFrame, group: str = "project_id") -> DataFrame:
    """(group, form, last, copies, spelled) of rows with a form; ``spelled`` is the sorted tokens, and forms without any are left out."""
    each = rows.groupBy(group, "form").agg(F.max(F.col("idx").cast("long")).alias("last"), F.count("*").alias("copies"), F.first("norm").alias("norm"))
    spelled = F.array_join(F.sort_array(F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0))), " ")
    return each.withColumn("spelled", spelled).drop("norm").filter("spelled <> ''")


def _letters(spelled: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(characters as numbers, padded; counts of each; how many different ones)."""
    known = sorted(set().union(*map(set, spelled)))
    at = np.full(128, 0, np.int64)  # tokens are ASCII
    at[[ord(c) for c in known]] = np.arange(len(known))
    size = [len(s) for s in spelled]
    codes = np.full((len(spelled), max(size)), len(known), np.int64)
    counts = np.zeros((len(spelled), len(known)), np.int32)
    for i, s in enumerate(spelled):
        codes[i, : size[i]] = at[np.frombuffer(s.encode(), np.uint8)]
        counts[i] = np.bincount(codes[i, : size[i]], minlength=len(known))
    return codes, counts, len(known)


def common_subsequence(codes: np.ndarray, letters: int, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows, all pairs at once, a bit for each character of the left one."""
    words = -(-codes.shape[1] // 64)
    masks = np.zeros((len(codes), letters + 1, words), np.uint64)  # the padding matches nothing
    for p in range(codes.shape[1]):
        masks[np.arange(len(codes)), codes[:, p], p // 64] |= np.uint64(1 << (p % 64))
    masks[:, letters] = 0
    v = np.full((len(left), words), ~np.uint64(0))
    for p in range(int(size[right].max(initial=0))):
        hit = masks[left, codes[right, p]]
        both, kept = v & hit, v & ~hit
        carry = np.zeros(len(left), np.uint64)
        for w in range(words):
            total = v[:, w] + both[:, w]
            more = total + carry
            carry = ((total < both[:, w]) | (more < total)).astype(np.uint64)
            v[:, w] = more | kept[:, w]
    inside = np.clip(size[left][:, None] - 64 * np.arange(words), 0, 64)
    low = np.where(inside >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & low).sum(axis=1).astype(np.int64)


def candidates(left: list[str], right: list[str], threshold: float, seen: dict[str, int] | None = None, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of spelled texts whose ratio, either way round, may reach the threshold; ``seen`` counts what each bound leaves.

    ``once``: left and right are the same texts, and only pairs with i < j are wanted.
    """
    n, seen = len(left), {} if seen is None else seen
    codes, counts, letters = _letters(left + right)
    size = counts.sum(axis=1)
    step = max(1, PAIR_WORDS // (len(right) * -(-codes.shape[1] // 64)))
    for a in range(0, n, step):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(a, min(n, a + step)), n + np.arange(len(right)), indexing="ij"))
        if once:
            i, j = i[i < j - n], j[i < j - n]
        least = threshold * (size[i] + size[j]) / 2 - 1e-9

        def bound(name: str, matched: np.ndarray) -> None:
            nonlocal i, j, least
            ok = matched >= least
            i, j, least = i[ok], j[ok], least[ok]
            seen[name] = seen.get(name, 0) + len(i)

        seen["pairs"] = seen.get("pairs", 0) + len(i)
        bound("length", np.minimum(size[i], size[j]))
        bound("characters", np.minimum(counts[i], counts[j]).sum(axis=1))
        if codes.shape[1] <= LONGEST and len(i):
            bound("subsequence", common_subsequence(codes, letters, size, i, j))
        yield i, j - n


def _score(a: str, b: str, matcher: difflib.SequenceMatcher) -> float:
    """Like ``tx.similarity`` of texts with these sorted tokens; the matcher holds b."""
    matcher.set_seq1(a)
    x, y = set(a.split()), set(b.split())
    return max(len(x & y) / len(x | y), matcher.ratio())


def _near_blocks(l: DataFrame, r: DataFrame, threshold: float, group: str) -> DataFrame:
    """(group, bi, bj, ...) of blocks whose closest lengths can reach the threshold."""
    lengths = lambda df, k: df.groupBy(group, F.col("block").alias(f"b{k}")).agg(F.min("size").alias(f"lo{k}"), F.max("size").alias(f"hi{k}"))
    near, far = F.least(F.greatest("loi", "loj"), F.least("hii", "hij")), F.greatest("loi", "loj")  # the closest lengths of two blocks
    return lengths(l, "i").join(lengths(r, "j"), group).filter(2 * near >= threshold * (near + F.greatest(near, far)) - 1e-9)


def _by_ratio(left: DataFrame, right: DataFrame, threshold: float, group: str, same: bool) -> DataFrame:
    """(group, a, b, ab, ba) of pairs of left and right forms, found by their ratio; ``same``: both are one table, each pair once, a < b."""
    scratch = Scratch(left.sparkSession, "forms")
    cut = lambda df, name: scratch.write(numbered(df.select(group, "form", "spelled", F.length("spelled").alias("size")), group, ["size", "form"]).withColumn("block", F.floor((F.col("n") - 1) / BLOCK)).drop("n"), name)
    l = cut(left, "left")
    r = l if same else cut(right, "right")
    pairs = _near_blocks(l, r, threshold, group)
    pairs = scratch.write((pairs.filter("bi <= bj") if same else pairs).select(group, "bi", "bj"), "pairs")
    side = lambda df, k: df.withColumnRenamed("block", k).join(pairs, [group, k]).withColumn("side", F.lit(k == "bj"))
    dealt = side(l, "bi").unionByName(side(r, "bj"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[~pdf["side"]], pdf[pdf["side"]]
        one = same and pdf["bi"].iloc[0] == pdf["bj"].iloc[0]
        text, other, ids, others = a["spelled"].tolist(), b["spelled"].tolist(), a["form"].to_numpy(), b["form"].to_numpy()
        out, matcher = [], difflib.SequenceMatcher()
        if one:  # both sides hold the same forms
            other, others = text, ids
        for i, j in candidates(text, other, threshold, once=one):
            to, back = np.zeros(len(i)), np.zeros(len(i))
            for k in np.argsort(j, kind="stable").tolist():  # the matcher keeps what it learnt of its second text
                matcher.set_seq2(other[j[k]])
                to[k] = _score(text[i[k]], other[j[k]], matcher)
            for k in np.argsort(i, kind="stable").tolist() if same else ():
                matcher.set_seq2(text[i[k]])
                back[k] = _score(other[j[k]], text[i[k]], matcher)
            for k in np.flatnonzero(np.maximum(to, back) >= threshold).tolist():
                one_id, other_id = ids[i[k]], others[j[k]]
                out.append((one_id, other_id, to[k], back[k]) if not same or one_id < other_id else (other_id, one_id, back[k], to[k]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pd.DataFrame({group: pdf[group].iloc[0], **{c: list(v) for c, v in zip(("a", "b", "ab", "ba"), cols, strict=True)}})

    kind = left.schema[group].dataType.simpleString()
    return spread(dealt, group, "bi", "bj").groupBy(group, "bi", "bj").applyInPandas(score, f"{group} {kind}, a long, b long, ab double, ba double")


@F.pandas_udf(T.DoubleType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_score(x, y, difflib.SequenceMatcher(None, "", y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def form_links(forms: DataFrame, threshold: float, group: str = "project_id") -> DataFrame:
    """(group, a, b, ab, ba) with a < b, of different forms: the scores (a, b) and (b, a), null below the threshold; one reaches it."""
    terms = forms.select(group, F.col("form").alias("idx"), F.array_distinct(F.split("spelled", " ")).alias("terms"))
    text = lambda k: forms.select(group, F.col("form").alias(k), F.col("spelled").alias(f"{k}_text"))
    worded = overlap_pairs(terms, threshold, group).select(group, "a", "b").join(text("a").hint("merge"), [group, "a"]).join(text("b").hint("merge"), [group, "b"])
    worded = spread(worded, group, "a", "b").select(group, "a", "b", _similar("a_text", "b_text").alias("ab"), _similar("b_text", "a_text").alias("ba"))
    both = worded.unionByName(_by_ratio(forms, forms, threshold, group, True)).groupBy(group, "a", "b").agg(F.max("ab").alias("ab"), F.max("ba").alias("ba"))
    reach = lambda c: F.when(F.col(c) >= threshold, F.col(c)).alias(c)
    return both.select(group, "a", "b", reach("ab"), reach("ba"))


#: Ratios that a worker remembers; projects share wordings.
RATIOS: dict[tuple[str, str], float] = {}
KNOWN = 1 << 18


def ratio(a: str, b: str, matcher: difflib.SequenceMatcher | None = None) -> float:
    """The sequence ratio of two spelled texts; a ``matcher`` given holds b."""
    got = RATIOS.get((a, b))
    if got is None:
        matcher = matcher or difflib.SequenceMatcher(None, "", b)
        matcher.set_seq1(a)
        if len(RATIOS) >= KNOWN:
            RATIOS.clear()
        got = RATIOS[a, b] = matcher.ratio()
    return got


def _connect(text: list[str], ids: np.ndarray, last: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, either: bool) -> np.ndarray:
    """``label`` with the labels of linked texts made one: pairs of left and right (positions), i < j. Only pairs of different labels are scored."""
    codes, counts, letters = _letters(text)
    size, words = counts.sum(axis=1), [set(t.split()) for t in text]

    def linked(i: int, j: int) -> bool:
        a, b = (i, j) if ids[i] < ids[j] else (j, i)
        if len(words[a] & words[b]) / len(words[a] | words[b]) >= threshold or ratio(text[a], text[b]) >= threshold:
            return True
        return bool(either or last[a] > ids[b]) and ratio(text[b], text[a]) >= threshold

    rest = []
    for i in left.tolist():
        j = right[(right > i) & (label[right] != label[i])]
        most = np.minimum(counts[j], counts[i]).sum(axis=1) / (size[j] + size[i]) * 2
        j, most = j[most >= threshold - 1e-9], most[most >= threshold - 1e-9]
        for _ in range(3):  # likely ones first: what they connect need not be looked at
            if not len(j):
                break
            k = int(np.argmax(most))
            if linked(i, j[k]):
                label[label == label[j[k]]] = label[i]
                stay = label[j] != label[i]
            else:
                stay = np.arange(len(j)) != k
            j, most = j[stay], most[stay]
        rest.append((np.full(len(j), i), j))
    i, j = (np.concatenate([r[k] for r in rest]) if rest else np.zeros(0, np.int64) for k in (0, 1))
    step = max(1, PAIR_WORDS // -(-codes.shape[1] // 64))
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if codes.shape[1] <= LONGEST and len(x):
            most = common_subsequence(codes, letters, size, x, y) / (size[x] + size[y]) * 2
            order = np.argsort(-most, kind="stable")
            order = order[most[order] >= threshold - 1e-9]
            x, y = x[order], y[order]
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if label[a] != label[b] and linked(a, b):
                label[label == label[b]] = label[a]
    return label


def form_components(forms: DataFrame, threshold: float, either: bool = True, group: str = "project_id") -> DataFrame:
    """(form, comp): the components of all pairs of ``form_links``, by their smallest form, without scoring pairs that are connected already.

    Only a pair's score from an earlier row to a later one counts, unless ``either`` does. First each block of forms of near length is connected,
    then block pairs, then pairs that are alike by their tokens only; each time what is connected so far is not compared.
    """
    scratch = Scratch(forms.sparkSession, "edges")
    kind = forms.schema[group].dataType.simpleString()
    cut = numbered(forms.select(group, "form", "last", "spelled", F.length("spelled").alias("size")), group, ["size", "form"]).withColumn("block", F.floor((F.col("n") - 1) / BLOCK)).drop("n")
    cut = scratch.write(cut, "cut")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, every = pdf["form"].to_numpy(), np.arange(len(pdf))
        label = _connect(pdf["spelled"].tolist(), ids, pdf["last"].to_numpy(), ids.copy(), every, every, threshold, either)
        return pdf.drop(columns="size").assign(label=label)

    l = scratch.write(spread(cut, group, "block").groupBy(group, "block").applyInPandas(within, f"{group} {kind}, form long, last long, spelled string, block long, label long"), "within")
    lengths = lambda k: cut.groupBy(group, F.col("block").alias(f"b{k}")).agg(F.min("size").alias(f"lo{k}"), F.max("size").alias(f"hi{k}"))
    pairs = lengths("i").join(lengths("j"), group).filter((F.col("bi") < F.col("bj")) & (2 * F.col("hii") >= threshold * (F.col("hii") + F.greatest("hii", "loj")) - 1e-9))
    pairs = scratch.write(pairs.select(group, "bi", "bj"), "pairs")
    side = lambda k: l.withColumnRenamed("block", k).join(pairs, [group, k]).withColumn("side", F.lit(k == "bj"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "form"])
        before, at = pdf["label"].to_numpy(), np.arange(len(pdf))
        n = int((~pdf["side"]).sum())
        after = _connect(pdf["spelled"].tolist(), pdf["form"].to_numpy(), pdf["last"].to_numpy(), before.copy(), at[:n], at[n:], threshold, either)
        new = after != before
        return pd.DataFrame({"a": before[new], "b": after[new]}).drop_duplicates()

    met = spread(side("bi").unionByName(side("bj")), group, "bi", "bj").groupBy(group, "bi", "bj").applyInPandas(across, "a long, b long")
    edges = scratch.write(l.select(F.col("form").alias("a"), F.col("label").alias("b")).unionByName(met), "by_ratio")
    # by their tokens: sets meet on rare terms as in ``overlap_pairs``, where these are in more than one component
    comps = scratch.write(connected_components(edges).select(F.col("node").alias("form"), F.col("component").alias("comp")), "comps")
    terms = l.join(comps.hint("merge"), "form").select(group, F.col("comp").alias("idx"), F.sort_array(F.array_distinct(F.split("spelled", " "))).alias("terms")).distinct()
    terms = scratch.write(terms.withColumn("idx", F.struct("idx", F.xxhash64("terms").alias("h"))), "terms")
    rare = scratch.write(by_rarity(terms, terms, group), "rare").withColumn("key", F.explode(_prefix(F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)))
    rare = scratch.write(rare.select(group, "key", F.col("idx.idx").alias("c"), "n", "terms"), "keys")
    mixed = rare.groupBy(group, "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select(group, "key")
    rare = spread(rare.join(mixed.hint("merge"), [group, "key"], "left_semi"), group, "key")
    one = lambda k: rare.select(group, "key", F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("terms").alias(f"t{k}"))
    near = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    common = F.size(F.array_intersect("ta", "tb"))
    worded = one("a").join(one("b").hint("merge"), [group, "key"]).filter((F.col("a") < F.col("b")) & near).filter(common / (F.col("na") + F.col("nb") - common) >= threshold).select("a", "b").distinct()
    worded = scratch.write(worded, "worded")
    if worded.isEmpty():
        return comps
    again = connected_components(worded).select(F.col("node").alias("comp"), F.col("component").alias("first"))
    return comps.join(again, "comp", "left").select("form", F.coalesce("first", "comp").alias("comp"))


def cross_links(left: DataFrame, right: DataFrame, threshold: float, group: str = "project_id") -> DataFrame:
    """(group, a, b, sim) of left and right forms whose score (a, b) reaches the threshold."""
    terms = lambda df: df.select(group, F.col("form").alias("idx"), F.array_distinct(F.split("spelled", " ")).alias("terms"))
    met = cross_overlap(terms(left), terms(right), threshold, group)
    met = met.filter(F.col("common") / (F.col("nl") + F.col("nr") - F.col("common")) >= threshold - 1e-9).select(group, F.col("idx").alias("a"), F.col("match").alias("b"))
    worded = met.join(left.select(group, F.col("form").alias("a"), F.col("spelled").alias("a_text")), [group, "a"]).join(right.select(group, F.col("form").alias("b"), F.col("spelled").alias("b_text")), [group, "b"])
    worded = spread(worded, group, "a", "b").select(group, "a", "b", _similar("a_text", "b_text").alias("sim"))
    both = worded.unionByName(_by_ratio(left, right, threshold, group, False).select(group, "a", "b", F.col("ab").alias("sim")))
    return both.filter(F.col("sim") >= threshold).groupBy(group, "a", "b").agg(F.max("sim").alias("sim"))


def _formed(rows: DataFrame, label: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their form, and the forms, written once."""
    scratch = Scratch(rows.sparkSession, label)
    named = scratch.write(with_form(rows.select(group, F.col("idx").cast("long").alias("idx"), "statement"), group), "rows")
    return named, scratch.write(forms_of(named, group), "forms")


def similarity_pairs(rows: DataFrame, threshold: float, later_first: bool = False, group: str = "project_id") -> DataFrame:
    """(group, a, b, sim) with a < b by idx, from (group, idx, statement): every pair of rows, copies included.

    The score is not symmetric: ``later_first`` scores (later, earlier), else (earlier, later). Copies make pairs of pairs here; joins and folds use ``form_links``.
    """
    named, forms = _formed(rows, "pairs", group)
    links = form_links(forms, threshold, group)
    ways = links.select(group, F.col("a").alias("fa"), F.col("b").alias("fb"), F.col("ab").alias("sim")).unionByName(links.select(group, F.col("b").alias("fa"), F.col("a").alias("fb"), F.col("ba").alias("sim")))
    ways = ways.filter("sim is not null").unionByName(forms.filter("copies > 1").select(group, F.col("form").alias("fa"), F.col("form").alias("fb"), F.lit(1.0).alias("sim")))
    side = lambda k: named.select(group, F.col("form").alias(f"f{k}"), F.col("idx").alias(k))
    pairs = ways.join(side("a"), [group, "fa"]).join(side("b"), [group, "fb"])
    ordered = pairs.filter("a > b").select(group, F.col("b").alias("a"), F.col("a").alias("b"), "sim") if later_first else pairs.filter("a < b").select(group, "a", "b", "sim")
    return ordered


def cross_similarity(left: DataFrame, right: DataFrame, threshold: float, group: str = "project_id") -> DataFrame:
    """(group, idx, match, sim) of pairs of left and right rows (group, idx, statement) whose score (left, right) reaches the threshold."""
    (lrows, lforms), (rrows, rforms) = _formed(left, "left", group), _formed(right, "right", group)
    links = cross_links(lforms, rforms, threshold, group)
    return links.join(lrows.select(group, F.col("form").alias("a"), "idx"), [group, "a"]).join(rrows.select(group, F.col("form").alias("b"), F.col("idx").alias("match")), [group, "b"]).select(group, "idx", "match", "sim")


def by_rarity(rows: DataFrame, among: DataFrame, group: str) -> DataFrame:
    """(group, idx, n, terms) of rows (group, idx, terms), with the terms that are rarest in ``among`` first.

    Rows without terms are left out; what a join does with them is for its caller to say.
    """
    each = rows.select(group, "idx", F.explode(F.array_distinct("terms")).alias("term"))
    df = among.select(group, F.explode(F.array_distinct("terms")).alias("term")).groupBy(group, "term").agg(F.count("*").alias("df"))
    ranked = each.join(df.hint("merge"), [group, "term"], "left").groupBy(group, "idx").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("t"))
    return ranked.select(group, "idx", F.size("t").alias("n"), F.transform("t", lambda x: x["term"]).alias("terms"))


def _prefix(length: Column) -> Column:
    return F.slice("terms", 1, length.cast("int"))


def term_classes(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(group, idx, terms) of the first row of every set of terms, and all rows' (group, cls, ids): the set's first row, and up to about ``COPIES`` rows of it."""
    scratch = Scratch(rows.sparkSession, "classes")
    sets = rows.select(group, "idx", F.sort_array(F.array_distinct("terms")).alias("terms")).filter("size(terms) > 0")
    sets = scratch.write(spread(sets, group, "terms"), "sets")
    first = scratch.write(sets.groupBy(group, "terms").agg(F.min("idx").alias("cls"), F.count("*").alias("copies")), "first")
    named = sets.join(first.hint("merge"), [group, "terms"]).withColumn("chunk", F.pmod(F.xxhash64("idx"), F.ceil(F.col("copies") / COPIES)))
    chunks = scratch.write(named.groupBy(group, "cls", "chunk").agg(F.collect_list("idx").alias("ids")).drop("chunk"), "chunks")
    return first.select(group, F.col("cls").alias("idx"), "terms"), chunks


def _expanded(pairs: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """(group, a, b, ...), a < b, of all rows of the classes in pairs (group, ca, cb, ...); a class paired with itself gives each pair of its rows once."""
    side = lambda k: chunks.select(group, F.col("cls").alias(f"c{k}"), F.col("ids").alias(f"{k}s"))
    half = spread(pairs.join(side("a").hint("merge"), [group, "ca"]), group, "cb")
    met = half.join(spread(side("b"), group, "cb").hint("merge"), [group, "cb"])
    rest = [c for c in pairs.columns if c not in (group, "ca", "cb")]
    rows = met.withColumn("x", F.explode("as")).select(group, "ca", "cb", "x", *rest, F.explode("bs").alias("y")).filter("ca <> cb or x < y")
    return rows.select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *rest)


def overlap_pairs(rows: DataFrame, threshold: float, group: str = "project_id") -> DataFrame:
    """(group, a, b, overlap), a < b, of pairs of rows (group, idx, terms) whose Jaccard similarity reaches the threshold.

    Sets that similar share a term among the n - ceil(t n) + 1 rarest of each, and their sizes differ by the threshold
    at most; so sets meet on rare terms only, at the first that both have, and the whole sets decide. Rows of equal
    sets are compared once and expanded at the end: the work before that grows with the different sets.
    """
    sets, chunks = term_classes(rows, group)
    ranked = Scratch(rows.sparkSession, "ranked").write(spread(by_rarity(sets, sets, group), group, "idx"), "sets")
    rare = ranked.withColumn("key", F.explode(_prefix(F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)))
    a = rare.select(group, "key", F.col("idx").alias("ca"), F.col("n").alias("na"), F.col("terms").alias("ta"))
    b = rare.select(group, "key", F.col("idx").alias("cb"), F.col("n").alias("nb"), F.col("terms").alias("tb"))
    near = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    # sizes of tables on disk say nothing of what is exploded from them, so these joins never broadcast
    met = spread(a, group, "key").join(spread(b, group, "key").hint("merge"), [group, "key"]).filter((F.col("ca") < F.col("cb")) & near)
    met = met.withColumn("both", F.array_intersect("ta", "tb")).filter(F.get("both", F.lit(0)) == F.col("key"))
    c = F.size("both")
    pairs = met.select(group, "ca", "cb", (c / (F.col("na") + F.col("nb") - c)).alias("overlap")).filter(F.col("overlap") >= threshold)
    same = chunks.select(group, F.col("cls").alias("ca"), F.col("cls").alias("cb"), F.lit(1.0).alias("overlap")).distinct()
    return _expanded(pairs.unionByName(same), chunks, group)


def opposite_pairs(reqs: DataFrame, threshold: float, group: str = "project_id") -> DataFrame:
    """(group, a, b), a < b, of rows (group, idx, statement) whose topic terms' Jaccard reaches the threshold and that are opposite.

    Rows of equal tokens, topic terms and negation are compared once; two of them are never opposite.
    """
    s, scratch = F.col("statement"), Scratch(reqs.sparkSession, "opposite")
    read = spread(reqs.select(group, "idx", "statement"), group, "statement").select(group, "idx", tx.has_negation(s).alias("neg"), tx.tokens(s).alias("tok"), tx.topic_terms(s).alias("terms")).filter("size(terms) > 0")
    read = scratch.write(read, "rows")
    alike = [group, "neg", "tok", "terms"]
    first = scratch.write(read.groupBy(*alike).agg(F.min("idx").alias("cls"), F.count("*").alias("copies")), "first")
    named = read.join(first.hint("merge"), alike).withColumn("chunk", F.pmod(F.xxhash64("idx"), F.ceil(F.col("copies") / COPIES)))
    chunks = scratch.write(named.groupBy(group, "cls", "chunk").agg(F.collect_list("idx").alias("ids")).drop("chunk"), "chunks")
    pairs = overlap_pairs(first.select(group, F.col("cls").alias("idx"), "terms"), threshold, group).select(group, F.col("a").alias("ca"), F.col("b").alias("cb"))
    side = lambda k: first.select(group, F.col("cls").alias(f"c{k}"), F.col("neg").alias(f"{k}_neg"), F.col("tok").alias(f"{k}_tok"))
    both = pairs.join(side("a").hint("merge"), [group, "ca"]).join(side("b").hint("merge"), [group, "cb"])
    apart = both.filter(tx.polarity_conflict(F.col("a_neg"), F.col("a_tok"), F.col("b_neg"), F.col("b_tok"))).select(group, "ca", "cb")
    return _expanded(scratch.write(apart, "apart"), chunks, group)


def cross_overlap(left: DataFrame, right: DataFrame, share: float, group: str = "project_id") -> DataFrame:
    """(group, idx, match, common, nl, nr) of pairs of rows (group, idx, terms) that share at least that part of the left row's terms.

    Such pairs share one of the left row's n - ceil(share n) + 1 terms that are rarest on the right.
    """
    l, r = by_rarity(left, right, group), by_rarity(right, right, group)
    keys = l.select(group, F.col("idx"), F.col("n").alias("nl"), F.col("terms").alias("tl"), F.explode(_prefix(F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1)).alias("key"))
    every = r.select(group, F.col("idx").alias("match"), F.col("n").alias("nr"), F.col("terms").alias("tr"), F.explode("terms").alias("key"))
    met = keys.join(every, [group, "key"]).withColumn("both", F.array_intersect("tl", "tr")).filter(F.get("both", F.lit(0)) == F.col("key"))
    return met.select(group, "idx", "match", F.size("both").alias("common"), "nl", "nr").filter(F.col("common") >= F.col("nl") * share - 1e-9)


def best_match(left: DataFrame, right: DataFrame, floor: float, group: str = "project_id") -> DataFrame:
    """(group, idx, match, sim): each left row's most similar right row, the first of equals, at ``floor`` at least."""
    (lrows, lforms), (_, rforms) = _formed(left, "left", group), _formed(right, "right", group)
    # a form stands for its first row, so ties between copies go to the first as well
    best = cross_links(lforms, rforms, floor, group).groupBy(group, F.col("a").alias("form")).agg(F.max(F.struct("sim", (-F.col("b")).alias("m"))).alias("x"))
    return lrows.join(best, [group, "form"]).select(group, "idx", (-F.col("x.m")).alias("match"), F.col("x.sim").alias("sim"))


ECHO, COVERED = 0.85, 0.66


def _turns(tok: Column) -> Column:
    """What ``polarity_conflict`` reads of tokens: for each antonym pair that they hold, its number times 5 and 1 or 2 for one side, 3 or 4 for both in this or that order."""
    pairs = F.array(*[F.struct(F.lit(5 * k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(lex.OPPOSITES)])

    def state(p: Column) -> Column:
        x, y = F.array_contains(tok, p["x"]), F.array_contains(tok, p["y"])
        both = F.when(F.array_position(tok, p["x"]) < F.array_position(tok, p["y"]), 3).otherwise(4)
        return F.when(x & y, both).when(x, 1).when(y, 2).otherwise(0)

    return F.filter(F.transform(pairs, lambda p: p["k"] + state(p)), lambda t: t % 5 > 0)


def _apart(a: Column, b: Column) -> Column:
    """Opposite, by the negation and the turns of both."""
    turned = lambda x, y: (F.floor(x / 5) == F.floor(y / 5)) & (x % 5 + y % 5).isin(3, 7)
    return (a["neg"] != b["neg"]) | F.exists(a["turns"], lambda x: F.exists(b["turns"], lambda y: turned(x, y)))


def _echoing(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, first) of left classes (group, spelled, neg, turns, first) whose ratio with a right one that is not opposite reaches ``ECHO``; one is enough."""
    scratch = Scratch(left.sparkSession, "echoing")
    cut = lambda df, name: scratch.write(numbered(df.withColumn("size", F.length("spelled")), group, ["size", "first"]).withColumn("block", F.floor((F.col("n") - 1) / BLOCK)).drop("n"), name)
    l, r = cut(left, "left"), cut(right, "right")
    pairs = scratch.write(_near_blocks(l, r, ECHO, group).select(group, "bi", "bj"), "pairs")
    side = lambda df, k: df.withColumnRenamed("block", k).join(pairs, [group, k]).withColumn("side", F.lit(k == "bj"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side", kind="stable")
        text, n = pdf["spelled"].tolist(), int((~pdf["side"]).sum())
        kinds: dict[tuple, int] = {}
        kind = np.array([kinds.setdefault((neg, *turns), len(kinds)) for neg, turns in zip(pdf["neg"].tolist(), pdf["turns"].tolist(), strict=True)])
        turned = lambda a, b: a[0] != b[0] or any(x // 5 == y // 5 and x % 5 + y % 5 in (3, 7) for x in a[1:] for y in b[1:])
        fit = np.array([[not turned(a, b) for b in kinds] for a in kinds])
        codes, counts, letters = _letters(text)
        size, out = counts.sum(axis=1), []
        for i in range(n):
            j = n + np.flatnonzero(fit[kind[i], kind[n:]])
            most = np.minimum(counts[j], counts[i]).sum(axis=1) / (size[j] + size[i]) * 2
            j, most = j[most >= ECHO - 1e-9], most[most >= ECHO - 1e-9]
            j = j[np.argsort(-most, kind="stable")]
            hit = any(ratio(text[i], text[k]) >= ECHO for k in j[:3].tolist())
            j = j[3:]
            if not hit and len(j) and codes.shape[1] <= LONGEST:
                most = common_subsequence(codes[np.append(i, j)], letters, size[np.append(i, j)], np.zeros(len(j), np.int64), np.arange(1, len(j) + 1)) / (size[j] + size[i]) * 2
                j = j[np.argsort(-most, kind="stable")][: int((most >= ECHO - 1e-9).sum())]
            if hit or any(ratio(text[i], text[k]) >= ECHO for k in j.tolist()):
                out.append(i)
        return pdf.iloc[out][[group, "first"]]

    kind = left.schema[group].dataType.simpleString()
    dealt = side(l, "bi").unionByName(side(r, "bj"))
    return spread(dealt, group, "bi", "bj").groupBy(group, "bi", "bj").applyInPandas(find, f"{group} {kind}, first string").distinct()


def echo_free(items: DataFrame, firm: DataFrame, group: str = "project_id") -> DataFrame:
    """Open items less the ungrounded or inferred ones that echo a firm requirement (project, statement) of their project.

    An echo has the same normal form, or is very similar, or has two thirds of its core terms in one requirement;
    the last two only if the statements are not opposite. Statements of equal terms, or tokens, and equal polarity are one class, and what one
    test has found is not compared by the next.
    """
    scratch, s = Scratch(items.sparkSession, "echo"), F.col("statement")
    noise = items.filter(F.col("kind").isin("ungrounded", "inferred") & (F.trim("statement") != "")).select(group, "idx", "statement")

    def read(rows: DataFrame, name: str) -> DataFrame:
        each = spread(rows.select(group, "statement").distinct(), group, "statement").withColumn("exact", F.coalesce(tx.normalize_exact("statement"), F.lit("")))
        spelled = F.array_join(F.sort_array(F.regexp_extract_all("exact", F.lit("[a-z0-9]+"), F.lit(0))), " ")
        return scratch.write(each.select(group, "statement", tx.normalize(s).alias("norm"), spelled.alias("spelled"), F.sort_array(tx.core_terms(s)).alias("core"), tx.has_negation(s).alias("neg"), _turns(tx.tokens(s)).alias("turns")), name)

    def classes(rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy(group, by, "neg", "turns").agg(F.min("statement").alias("first"))

    def sharing(terms: Column, share: float, score: Column):
        of = lambda rows: rows.select(group, F.struct("first", "neg", "turns").alias("idx"), terms.alias("terms"))
        return lambda a, b: cross_overlap(of(a), of(b), share, group).filter((score >= share) & ~_apart(F.col("idx"), F.col("match"))).select(group, "idx.first").distinct()

    said, told = read(noise, "said"), read(firm, "told")
    left = scratch.write(said.join(told.select(group, "norm").distinct(), [group, "norm"], "left_anti"), "unequal")
    c, nl, nr = F.col("common"), F.col("nl"), F.col("nr")
    tests = [
        ("core", sharing(F.col("core"), COVERED, c / nl)), ("spelled", sharing(F.split("spelled", " "), ECHO, c / (nl + nr - c))),
        ("spelled", lambda a, b: _echoing(a, b, group)),
    ]
    for k, (by, test) in enumerate(tests):
        some = lambda rows: classes(rows.filter(F.size("core") > 0 if by == "core" else F.col("spelled") != ""), by)  # noqa: B023, E731
        named = scratch.write(some(left), f"classes{k}")
        found = scratch.write(test(named, scratch.write(some(told), f"firm{k}")), f"found{k}")
        gone = named.join(found, [group, "first"], "left_semi").select(group, by, "neg", "turns")
        left = scratch.write(left.join(gone, [group, by, "neg", "turns"], "left_anti"), f"left{k}")
    echoes = noise.join(said.join(left, [group, "statement"], "left_anti"), [group, "statement"]).select(group, "idx").distinct()
    return items.join(echoes, [group, "idx"], "left_anti")
