"""Token counts of byte-level BPE by compiled finite-state transducers.

Two deterministic machines count without building tokens:

* The *splitter* reads character classes and says where a pre-token starts. Texts of an Arrow batch lie end to
  end and are cut into chunks of ``CHUNK`` characters. For every chunk at once the machine runs from all its
  states in lock step, which gives the chunk's state map; the maps compose associatively, so a parallel prefix
  scan (log2 steps over all chunks) yields each chunk's true entry state, and one more pass marks the starts.
* The *counter* reads the bytes of a pre-token. After each prefix the BPE encoding has one last token, and a
  token may follow another just if the pair encodes to itself. So the state is the longest suffix that begins
  some token, with the last token and relative count at each place inside it; reading a byte moves to another
  such state and emits the change of the count. It is back at its root where a pre-token starts, so the map of a
  stretch of whole pre-tokens is (root to root, count), and such maps compose by adding counts: a scan over the
  pre-tokens of a batch, each distinct one walked once, gives every text's count. States are compiled when first
  reached and shared by all pre-tokens of a worker. Their number is bounded, also inside a batch or a long pre-token:
  past the bound they are dropped and recompiled.

Special strings of the tokenizer count as one token each, as in the library. Counts equal the library's.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); texts of any length are whole and take memory
in proportion to their batch; other columns and repeated rows pass through.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.resident import resident, trim
from lodestar.llm.textcut import binary_pieces, utf8_places
from lodestar.runtime import bound_arrow

CHUNK = 128
MAX_STATES, MAX_PIECES, PIECE_BYTES = 250_000, 800_000, 64

# Splitter: character classes (with the lookahead they need) and states.
RESET, LETTER, NUMBER, OTHER, BLANK, BLANK_END, WHITE_END, SHORT, LONG = range(9)
S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_GLUE, S_CON1, S_CON2 = range(8)
N_CLASS, N_STATE = 9, 8


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transition and start-mark tables, indexed class * N_STATE + state.

    BLANK is white space inside or at the end of a run or text, BLANK_END a space and WHITE_END other white space
    that something follows; SHORT and LONG are apostrophes that a contraction of one or two letters follows.
    """
    to, mark = np.zeros((N_CLASS, N_STATE), np.uint8), np.zeros((N_CLASS, N_STATE), np.uint8)
    for s in range(N_STATE):
        to[RESET, s] = S_START
        for cls, own in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER)):
            to[cls, s], mark[cls, s] = own, s not in (own, S_GLUE)
        to[BLANK, s], mark[BLANK, s] = S_BLANK, s != S_BLANK
        to[BLANK_END, s], mark[BLANK_END, s] = S_GLUE, 1
        to[WHITE_END, s], mark[WHITE_END, s] = S_START, 1
        inside = s in (S_OTHER, S_GLUE)
        to[SHORT, s], mark[SHORT, s] = (S_OTHER, 0) if inside else (S_CON1, 1)
        to[LONG, s], mark[LONG, s] = (S_OTHER, 0) if inside else (S_CON2, 1)
    to[LETTER, S_CON2], mark[LETTER, S_CON2] = S_CON1, 0
    to[LETTER, S_CON1], mark[LETTER, S_CON1] = S_START, 0
    return to.ravel(), mark.ravel()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, other, or white space (BLANK)."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = cls
    # a run found over the gap left by the surrogates may span it; they never occur in a text
    return table


def classify(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Classes of code points; ``breaks`` are the places of separators between texts."""
    table = _classes()
    cls = table[codes]
    cls[breaks] = RESET
    white = cls == BLANK
    follow = np.zeros(len(cls), bool)
    follow[:-1] = ~white[1:] & (cls[1:] != RESET)
    end = white & follow
    cls[end] = np.where(codes[end] == 32, BLANK_END, WHITE_END)
    apos = np.flatnonzero(codes == 39)
    apos = apos[(cls[apos] == OTHER) & (apos + 1 < len(codes))]
    if len(apos):
        inside = cls != RESET
        one, two = codes[apos + 1], codes[np.minimum(apos + 2, len(codes) - 1)]
        ok1, ok2 = inside[apos + 1], inside[np.minimum(apos + 2, len(codes) - 1)] & (apos + 2 < len(codes))
        cls[apos[ok1 & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ok1 & ok2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        cls[apos[pair]] = LONG
    return cls


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps, row by row: ``then`` after ``first``."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of chunk state maps under composition, in log2(n) parallel steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def starts(cls: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a pre-token starts (separators are never starts)."""
    to, mark = _TO, _MARK
    n = len(cls)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, RESET, np.uint8)
    padded[:n] = cls
    grid = np.ascontiguousarray(padded.reshape(rows, chunk).T)  # step by chunk
    base = grid.astype(np.uint16) * N_STATE
    maps = np.broadcast_to(np.arange(N_STATE, dtype=np.uint8), (rows, N_STATE)).copy()
    for i in range(chunk):
        maps = to[base[i][:, None] + maps]
    scanned = prefix_scan(maps.astype(np.intp)) if rows > 1 else maps.astype(np.intp)
    state = np.empty(rows, np.uint8)
    state[0] = S_START
    state[1:] = scanned[:-1, S_START]
    out = np.empty((chunk, rows), np.uint8)
    for i in range(chunk):
        at = base[i] + state
        out[i] = mark[at]
        state = to[at]
    return out.T.ravel()[:n].astype(bool)


_TO, _MARK = _splitter()


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            out[chr(k)], k = b, k + 1
    return out


class State(dict):
    """byte -> (state, change of the count).

    ``places`` are (bytes read since, last token, relative count) of the places from which those bytes begin a
    longer token, and of the present one, the farthest first; ``suffix`` is what was read since the first.
    """

    __slots__ = ("suffix", "places")


class BpeCounter:
    """Counts the BPE tokens of byte strings by a transducer that is compiled on demand."""

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]) -> None:
        self.vocab, self.merges = vocabulary, merges
        self.open = {t[:i] for t in vocabulary for i in range(1, len(t))}  # what can still become a longer token
        self.born = {a + b: (r, a, b) for (a, b), r in merges.items()}  # the merge that makes each token
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self.states: dict[tuple, State] = {}
        self.root = self._state(b"", ((0, None, 0),))

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE: the lowest-ranked adjacent pair first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.merges.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side stay two.

        Merges are undone in falling rank. What then stands at the seam was there together before the undone
        merge, so a merge of the seam of lower rank would have come first.
        """
        born, merges, limit = self.born, self.merges, 1 << 60
        while merges.get((left, right), limit) >= limit:
            a, b = born.get(left), born.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]  # of equal merges the left one comes first
        return False

    def _follows(self, last: bytes | None, token: bytes) -> bool:
        key = (last, token)
        if (ok := self.pairs.get(key)) is None:
            ok = self.pairs[key] = self.merge(token) == [token] if last is None else self._apart(last, token)
        return ok

    def _state(self, suffix: bytes, places: tuple) -> State:
        key = (suffix, places)
        if (s := self.states.get(key)) is None:
            s = State()
            s.suffix, s.places = suffix, places
            self.states[key] = s
        return s

    def _compile(self, state: State, byte: int) -> tuple[State, int]:
        grown = state.suffix + bytes((byte,))
        n, found, keep = len(grown), None, []
        for k, last, count in state.places:
            token = grown[n - k - 1 :]
            if found is None and token in self.vocab and self._follows(last, token):
                found, now = token, count + 1
            if token in self.open:
                keep.append((k + 1, last, count))
        if found is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        suffix = grown[n - keep[0][0] :] if keep else b""
        to = self._state(suffix, (*[(k, last, count - now) for k, last, count in keep], (0, found, 0)))
        state[byte] = out = (to, now)
        return out

    def count(self, data: bytes) -> int:
        state, total = self.root, 0
        for b in data:
            hop = state.get(b)
            if hop is None:
                if len(self.states) > MAX_STATES:
                    state = self._restart(state)
                hop = self._compile(state, b)
            state = hop[0]
            total += hop[1]
        return total

    def _restart(self, state: State) -> State:
        """Forget all compiled states but where ``state`` is; they come back when next reached."""
        self.states.clear()
        self.pairs.clear()
        self.root = self._state(b"", ((0, None, 0),))
        return self._state(state.suffix, state.places)


class Counter:
    """Splitter and counter of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE with the usual pattern and no normalizer is supported")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.bpe = BpeCounter({raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}, ranks)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pieces: dict[bytes, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        segments, owner = [], []
        for i, t in enumerate(texts):
            parts = self.special.split(t) if self.special is not None and self.special.search(t) else [t]
            total[i] += len(parts) - 1
            for p in parts:
                if p:
                    segments.append(p)
                    owner.append(i)
        if not segments:
            return total.tolist()
        whole = "\n".join(segments) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        mark = starts(classify(codes, ends))
        mark[ends] = True  # separators are pieces of their own, worth nothing
        begin = np.flatnonzero(mark)
        data = whole.encode("utf-8")
        pieces = binary_pieces(data, utf8_places(codes, begin, len(data))).dictionary_encode()
        known, count = self.pieces, self.bpe.count
        distinct = pieces.dictionary.to_pylist()
        worth = list(map(known.get, distinct))
        for k in [k for k, c in enumerate(worth) if c is None]:
            piece = distinct[k]
            worth[k] = c = count(piece)
            if len(piece) <= PIECE_BYTES:
                known[piece] = c
        n = np.array(worth, np.int64)[pieces.indices.to_numpy()]
        n[np.searchsorted(begin, ends)] = 0
        sums = np.add.reduceat(n, np.searchsorted(begin, np.concatenate([[0], ends[:-1] + 1])))
        np.add.at(total, np.asarray(owner), sums)
        if len(known) > MAX_PIECES:
            known.clear()
        return total.tolist()


def counter(path: str) -> Counter:
    return resident(("tokencount", path), lambda: Counter(path))


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with tc_n_bytes, tc_n_tokens and tc_over_limit (more than ``limit`` tokens)."""
    tokenizer = tokenizer or default_tokenizer()
    bound_arrow(docs.sparkSession)
    docs = docs.drop("tc_n_tokens", "tc_n_bytes", "tc_over_limit")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(tokenizer)
        for batch in batches:
            n = machine.counts([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "tc_n_tokens"])
        trim()

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("tc_n_tokens", T.LongType())]))
    return out.withColumn("tc_n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("tc_over_limit", F.col("tc_n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # the text stays in Python: only its length in bytes goes back
    out = token_counts(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    return out.select("doc_id", "n_bytes", F.col("tc_n_tokens").alias("n_tokens"), F.col("tc_over_limit").alias("over_limit"))
