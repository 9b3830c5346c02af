"""Language identification by a linear-chain conditional random field over words.

Every word gets a language from its affixes, character n-grams and lexicon memberships (hashed features with
learned weights) and from its neighbours by learned transitions; forward-backward gives each word's marginals, so
code-switched text is labelled word by word. A document's language is the one with the largest mean marginal
over all its words, and that mean is its score.

Training: a bounded sample of labelled documents is cut into word sequences, half of them spliced from documents of
different languages so that switches are seen; weights and transitions maximise the conditional likelihood by
Adagrad. The bounds: the ``MAX_LANGS`` most frequent languages; of each the ``TRAIN_DOCS`` documents that come first
by a hash of id and text, up to ``TRAIN_CHARS`` characters each and ``TRAIN_TOTAL`` together (longer ones stay out of the
sample). Documents with crc32(doc_id as text) mod 4 = 2 are held out and never seen.

Prediction runs over whole texts of any length: words are cut into segments of ``SEGMENT``; all segments of an
Arrow batch run in lock step. A first pass multiplies each segment's transfer matrix, a scan over each
document's segments gives the messages at their ends, and a second pass gives the marginals.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; without any labelled document
everything is ``und``; words of no letter (digits, marks) are not labelled; a null doc_id is neither held out
nor trained on; repeated rows are predicted alike; of equal mean marginals the first language by name wins; an empty table gives an empty one. Columns named ``lid_*``
are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.resident import resident, trim
from lodestar.llm.textcut import mix64, words
from lodestar.runtime import bound_arrow

UNKNOWN = "und"
MAX_LANGS, TRAIN_DOCS, TRAIN_CHARS, TRAIN_TOTAL = 62, 300, 100_000, 3_000_000
SEQUENCES, SEQUENCE = 3000, 40
FEATURES = 1 << 17
LEXICON = 2000
EPOCHS, RATE, L2 = 12, 0.3, 1e-6
SEGMENT = 64
CACHE = 150_000
#: Steps of a score in the histogram from which ``least_score`` is read, and wrong labels for a right one.
STEPS = 200
WRONG = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Weights of a trained field; ``lexicon`` maps a word to a bit mask of languages."""

    langs: list[str]
    weights: np.ndarray  # (FEATURES + one lexicon row per language + bias) by language
    transitions: np.ndarray
    lexicon: dict[bytes, int] = field(default_factory=dict)


def features(names: list[bytes], lexicon: dict[bytes, int], n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) pairs, by word."""
    texts = [w.decode("utf-8") for w in names]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    flat = np.frombuffer("".join([f"\x02{t}\x03" for t in texts]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(start + size, size) - np.arange(len(flat))  # characters from here to the word's end
    owner, feats = [], []

    def add(kind: int, n: int, at: np.ndarray) -> None:
        at = at[left[at] >= n]
        h = np.full(len(at), kind, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[at + j]
        owner.append(word[at])
        feats.append((mix64(h) % np.uint64(FEATURES)).astype(np.int64))

    every = np.arange(len(flat))
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            add(n, n, every)
        for k in (1, 2, 3):  # affixes: the word's first and last letters, apart from the n-grams
            add(10 + k, k, (start + 1)[size - 2 >= k])
            add(20 + k, k, (start + size - 1 - k)[size - 2 >= k])
    mask = np.fromiter((lexicon.get(w, 0) for w in names), np.int64, len(names))
    for lang in range(min(n_langs, MAX_LANGS)):
        has = np.flatnonzero(mask >> lang & 1)
        owner.append(has)
        feats.append(np.full(len(has), FEATURES + lang))
    owner.append(np.arange(len(names)))
    feats.append(np.full(len(names), FEATURES + n_langs))
    return np.concatenate(owner), np.concatenate(feats)


def emissions(names: list[bytes], model: Model) -> np.ndarray:
    """Scores of each word for each language."""
    out = np.zeros((len(names), len(model.langs)), np.float32)
    for a in range(0, len(names), 20_000):
        part = names[a : a + 20_000]
        owner, feats = features(part, model.lexicon, len(model.langs))
        for lang in range(len(model.langs)):
            out[a : a + len(part), lang] = np.bincount(owner, weights=model.weights[feats, lang], minlength=len(part))
    return out


def _softmax_rows(t: np.ndarray) -> np.ndarray:
    return np.exp(t - t.max())


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of every word's language, for documents that lie end to end (``first``: n + 1 places)."""
    n_words, n_lang = scores.shape
    gamma = np.zeros_like(scores, dtype=np.float64)
    sizes = np.diff(first)
    if not n_words:
        return gamma
    n_seg = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), n_seg)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    begin = first[:-1][doc] + number * SEGMENT
    length = np.minimum(SEGMENT, first[1:][doc] - begin)
    x = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    step = _softmax_rows(transitions).astype(np.float64)
    order = np.argsort(-length, kind="stable")  # in lock step the live segments stay a prefix
    begin, length = begin[order], length[order]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    live = [int((length > i).sum()) for i in range(SEGMENT)]
    m = np.broadcast_to(np.eye(n_lang), (len(order), n_lang, n_lang)).copy()
    for i in range(SEGMENT):
        k = live[i]
        if not k:
            break
        y = (m[:k].reshape(-1, n_lang) @ step).reshape(k, n_lang, n_lang) * x[begin[:k] + i][:, None, :]
        m[:k] = y / y.sum(axis=(1, 2), keepdims=True)
    # messages at the ends of segments: scan over each document's segments
    m_doc = m[back]
    head = np.cumsum(n_seg) - n_seg
    into, outof = np.full((len(doc), n_lang), 1.0 / n_lang), np.ones((len(doc), n_lang))
    for k in range(1, int(n_seg.max())):
        at = head[n_seg > k] + k
        v = np.einsum("si,sij->sj", into[at - 1], m_doc[at - 1])
        into[at] = v / v.sum(axis=1, keepdims=True)
    for k in range(int(n_seg.max()) - 2, -1, -1):
        at = head[n_seg > k + 1] + k
        v = np.einsum("sij,sj->si", m_doc[at + 1], outof[at + 1])
        outof[at] = v / v.sum(axis=1, keepdims=True)
    alpha = into[order]
    kept = []
    for i in range(SEGMENT):
        k = live[i]
        if not k:
            break
        y = (alpha[:k] @ step) * x[begin[:k] + i]
        alpha[:k] = y / y.sum(axis=1, keepdims=True)
        kept.append(alpha[:k].copy())
    beta = outof[order]
    for i in range(len(kept) - 1, -1, -1):
        k = live[i]
        g = kept[i] * beta[:k]
        gamma[begin[:k] + i] = g / g.sum(axis=1, keepdims=True)
        b = (beta[:k] * x[begin[:k] + i]) @ step.T
        beta[:k] = b / b.sum(axis=1, keepdims=True)
    return gamma


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    """Fit a field to labelled texts."""
    langs = sorted(set(labels))
    n_lang = len(langs)
    model = Model(langs, np.zeros((FEATURES + n_lang + 1, n_lang)), np.zeros((n_lang, n_lang)))
    names, which, first = letter_words(texts)
    lang = np.array([langs.index(x) for x in labels])
    sizes = np.diff(first)
    if n_lang < 2 or not len(which):
        return model
    for k in range(min(n_lang, MAX_LANGS)):
        mine = Counter(which[np.repeat(lang == k, sizes)].tolist())
        for w, _ in sorted(mine.items(), key=lambda x: (-x[1], names[x[0]]))[:LEXICON]:
            model.lexicon[names[w]] = model.lexicon.get(names[w], 0) | 1 << k
    rng = np.random.default_rng(seed)
    by_lang = [np.flatnonzero((lang == k) & (sizes > 0)) for k in range(n_lang)]
    usable = [k for k in range(n_lang) if len(by_lang[k])]
    seqs, gold = np.zeros((SEQUENCES, SEQUENCE), np.int64), np.zeros((SEQUENCES, SEQUENCE), np.int64)
    for s in range(SEQUENCES):
        cuts = [0, SEQUENCE] if s % 2 else [0, *sorted(rng.choice(np.arange(3, SEQUENCE - 2), rng.integers(1, 3), replace=False).tolist()), SEQUENCE]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = usable[rng.integers(len(usable))]
            d = by_lang[k][rng.integers(len(by_lang[k]))]
            at = first[d] + (rng.integers(sizes[d]) + np.arange(b - a)) % sizes[d]
            seqs[s, a:b], gold[s, a:b] = which[at], k
    owner, feats = features(names, model.lexicon, n_lang)
    square = np.full(model.weights.shape, 1e-6)
    t_square = np.full(model.transitions.shape, 1e-6)
    batches = 6
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(SEQUENCES), batches):
            score = np.stack([np.bincount(owner, weights=model.weights[feats, k], minlength=len(names)) for k in range(n_lang)], axis=1)
            x = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-30
            step = _softmax_rows(model.transitions)
            obs, tag = x[seqs[part]], gold[part]
            n = len(part)
            alpha, beta = np.zeros_like(obs), np.ones_like(obs)
            prev = np.full((n, n_lang), 1.0 / n_lang)
            for i in range(SEQUENCE):
                prev = (prev @ step) * obs[:, i]
                prev /= prev.sum(axis=1, keepdims=True)
                alpha[:, i] = prev
            for i in range(SEQUENCE - 2, -1, -1):
                b = (beta[:, i + 1] * obs[:, i + 1]) @ step.T
                beta[:, i] = b / b.sum(axis=1, keepdims=True)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=2, keepdims=True)
            delta = gamma
            np.put_along_axis(delta, tag[:, :, None], np.take_along_axis(delta, tag[:, :, None], 2) - 1, 2)
            by_word = np.stack([np.bincount(seqs[part].ravel(), weights=delta[:, :, k].ravel(), minlength=len(names)) for k in range(n_lang)], axis=1)
            t_grad = np.zeros((n_lang, n_lang))
            for i in range(1, SEQUENCE):
                pair = alpha[:, i - 1, :, None] * step[None] * (obs[:, i] * beta[:, i])[:, None, :]
                t_grad += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                np.add.at(t_grad, (tag[:, i - 1], tag[:, i]), -1.0)
            grad = np.stack([np.bincount(feats, weights=by_word[owner, k], minlength=len(model.weights)) for k in range(n_lang)], axis=1) / n + L2 * model.weights
            t_grad = t_grad / n + 1e-3 * model.transitions
            square += grad * grad
            t_square += t_grad * t_grad
            model.weights -= RATE * grad / np.sqrt(square)
            model.transitions -= RATE * t_grad / np.sqrt(t_square)
    model.weights = model.weights.astype(np.float32)
    return model


_LETTER = regex.compile(r"\p{L}")


def letter_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``words`` of the lower-cased texts, less those without a letter."""
    names, which, first = words([t.lower() for t in texts])
    good = np.fromiter((_LETTER.search(w.decode("utf-8")) is not None for w in names), bool, len(names))
    keep = good[which] if len(which) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(keep)])
    new = np.cumsum(good) - 1
    return [w for w, ok in zip(names, good, strict=True) if ok], new[which[keep]], kept[first]


class Tagger:
    """Predicts with a model; remembers the scores of words up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.rows: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)

    def word_scores(self, names: list[bytes]) -> np.ndarray:
        if len(self.rows) > CACHE:
            self.rows, self.scores = {}, self.scores[:0]
        at = [self.rows.get(w, -1) for w in names]
        new = [w for w, k in zip(names, at, strict=True) if k < 0]
        if new:
            base = len(self.scores)
            self.scores = np.concatenate([self.scores, emissions(new, self.model)])
            self.rows.update((w, base + i) for i, w in enumerate(new))
            at = [self.rows[w] for w in names]
        return self.scores[np.array(at, np.int64)] if names else self.scores[:0]

    def tag(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, each word's index, places of texts, and each word's marginals."""
        names, which, first = letter_words(texts)
        scores = self.word_scores(names)
        return names, which, first, marginals(scores[which], first, self.model.transitions)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], np.ndarray]:
        """Language and score of each text, and its words by most likely language."""
        n_lang = len(self.model.langs)
        if not n_lang:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), np.zeros((len(texts), 0), np.int64)
        _, _, first, gamma = self.tag(texts)
        total = np.concatenate([np.zeros((1, n_lang)), np.cumsum(gamma, axis=0)])
        hard = np.zeros(gamma.shape)
        hard[np.arange(len(gamma)), gamma.argmax(axis=1)] = 1
        hard = np.concatenate([np.zeros((1, n_lang)), np.cumsum(hard, axis=0)])
        n = np.diff(first)
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        langs = [self.model.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
        score = np.where(n > 0, np.clip(mean[np.arange(len(n)), best], 0, 1), 0.0)
        return langs, score.tolist(), (hard[first[1:]] - hard[first[:-1]]).astype(np.int64)


def fit(docs: DataFrame, *, per_lang: int = TRAIN_DOCS) -> Model:
    """Train on a bounded sample of the labelled documents (doc_id, text, lang) that are not held out."""
    good = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    counts = good.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.5 * per_lang / r["count"]))).otherwise(share)
    # about 1.5 times the wanted rows pass; the window bounds what reaches the driver whatever the ids are
    u = F.xxhash64(F.lit("sample"), "doc_id", "text").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    order = W.partitionBy("lang").orderBy("u", "doc_id", "text")

    def first(rows: DataFrame) -> list:
        rows = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang)
        rows = rows.withColumn("chars", F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, 0))).filter((F.col("r") == 1) | (F.col("chars") <= TRAIN_TOTAL))
        return rows.select("lang", "r", "text").collect()

    taken = first(good.withColumn("u", u).filter(F.col("u") < share)) if counts else []
    # equal rows have equal hashes: a language of a few texts, each many times, may have none below its share
    if left := [r["lang"] for r in counts if r["lang"] not in {x.lang for x in taken}]:
        taken += first(good.withColumn("u", u).filter(F.col("lang").isin(left)))
    taken.sort(key=lambda r: (r.lang, r.r))
    model = train([r.text for r in taken], [r.lang for r in taken])
    trim()
    return model


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep_words: bool = True) -> DataFrame:
    """``docs`` with lid_lang, lid_score and (``keep_words``) lid_words, a map of words per language."""
    spark = docs.sparkSession
    bound_arrow(spark)
    docs = docs.drop("lid_lang", "lid_score", "lid_words")
    at = docs.columns.index(text)
    sent = spark.sparkContext.broadcast(model)  # its size is bounded by FEATURES and LEXICON times the languages
    key = zlib.crc32(model.weights.tobytes())
    added = [T.StructField("lid_lang", T.StringType()), T.StructField("lid_score", T.DoubleType())]
    added += [T.StructField("lid_words", T.MapType(T.StringType(), T.LongType()))] * keep_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = resident(("langid", key), lambda: Tagger(sent.value))
        for batch in batches:
            langs, score, by_lang = tagger.predict([t or "" for t in batch.column(at).to_pylist()])
            cols = [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            if keep_words:
                names = tagger.model.langs
                cols.append(pa.array([[(names[k], int(v)) for k, v in enumerate(r) if v] for r in by_lang.tolist()], pa.map_(pa.string(), pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *[f.name for f in added]])
        trim()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def least_score(identified: DataFrame) -> float:
    """The largest bound below which, on held-out labelled documents, more than ``WRONG`` labels are wrong for one that is right; 0 if there is none.

    Read from a histogram over all of them (doc_id, lang, lid_lang, lid_score). Documents in two languages in equal
    parts get either label, so even odds are no ground to reject.
    """
    known = identified.filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lid_lang") != UNKNOWN))
    step = F.least(F.floor(F.col("lid_score") * STEPS), F.lit(STEPS - 1)).alias("step")
    wrong = F.sum(F.when(F.col("lang") == F.col("lid_lang"), -WRONG).otherwise(1)).alias("wrong")
    bound, more = 0.0, 0
    for r in sorted(known.groupBy(step).agg(wrong).collect()):  # at most STEPS rows
        more += r["wrong"]
        if more > 0:
            bound = (r["step"] + 1) / STEPS
    return bound


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` less those without a language or with a score below ``least_score``; a null ``lang`` gets the language found.

    The held-out labelled documents, a quarter, are identified twice: once for the bound, so that no copy of the
    documents is stored for it.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    known = docs.filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    least = least_score(identify(known, model, keep_words=False))
    good = identify(docs, model, keep_words=False).filter((F.col("lid_lang") != UNKNOWN) & (F.col("lid_score") >= least))
    return good.withColumn("lang", F.coalesce("lang", "lid_lang")).select(*[c for c in docs.columns if c in good.columns])


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    out = identify(docs.select("doc_id", "text"), model, keep_words=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"))
