"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score, then by position: the best pair is
merged, its new neighbours join the agenda, stale entries are skipped when popped. What no piece covers falls
back to byte pieces, or to the unknown id where the vocabulary has none.

A text is first cut between characters that stand side by side in no piece of the vocabulary, for no merge can
reach over such a place. Units are then independent, so each distinct unit is encoded once per cache generation. Every unit that enters the cache is
held against the sentencepiece library in the same Arrow batch; a difference (none is known) is resolved for
the library and counted in ``n_mismatch``. Decoding is the library's ``decode(ids)``.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to itself; other columns and
repeated rows pass through. Memory is bounded by the Arrow batch and two cache generations.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.resident import resident, trim
from lodestar.llm.textcut import binary_pieces, utf8_places
from lodestar.runtime import bound_arrow

MARK = "▁"
#: Units longer than this are encoded afresh each time; a generation holds at most so many units.
UNIT_BYTES, GENERATION = 64, 150_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class AgendaEncoder:
    """Encodes with the pieces and scores of a merge-type model whose normalizer is the identity."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only merge-type models with an identity normalizer are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.ids = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        # pairs of characters (white space as itself, beyond ASCII all alike) that stand side by side in some piece
        self.joined = np.zeros((129, 129), bool)
        for p in self.ids:
            c = np.minimum(np.frombuffer(p.replace(MARK, " ").encode("utf-32-le"), np.uint32), 128)
            self.joined[c[:-1], c[1:]] = True
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit of normalized text."""
        known, symbols = self.ids, list(unit)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            if (hit := known.get(joined)) is not None:
                heapq.heappush(agenda, (-hit[1], left, right, joined))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(joined) or after[left] != right:
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = follow = after[right]
            if follow < n:
                before[follow] = left
                propose(left, follow)
            if before[left] >= 0:
                propose(before[left], left)
        out: list[int] = []
        for s in symbols:
            if not s:
                continue
            if (hit := known.get(s)) is not None:
                out.append(hit[0])
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode("utf-8"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def units(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct units of the texts (white space as itself), each text's units in order, and where texts begin."""
        lead = " " if self.prefix else ""
        whole = "".join([f"{lead}{t}\0" if t else "\0" for t in texts]).replace(MARK, " ")
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        cls = np.minimum(codes, 128)
        sizes = np.array([len(t) + len(lead) * bool(t) + 1 for t in texts])
        ends = np.cumsum(sizes) - 1  # the separators
        mark = np.ones(len(codes), bool)
        np.logical_not(self.joined[cls[:-1], cls[1:]], out=mark[1:])
        mark[ends] = True
        mark[ends[:-1] + 1] = True
        begin = np.flatnonzero(mark)
        data = whole.encode("utf-8")
        found = binary_pieces(data, utf8_places(codes, begin, len(data))).dictionary_encode()
        which = found.indices.to_numpy()
        stop = np.searchsorted(begin, ends)
        return found.dictionary.to_pylist(), which, np.stack([np.concatenate([[0], stop[:-1] + 1]), stop])

    def learn(self, units: list[bytes]) -> tuple[list[tuple[int, ...]], set[int]]:
        """Ids of units, held against the library, and which of them differed (the library's are returned)."""
        texts = [u.decode("utf-8") for u in units]
        ours = [tuple(self.encode_unit(t.replace(" ", MARK))) for t in texts]
        lead, wrong = len(self.library.encode("\n")), set()
        for k, theirs in enumerate(self.library.encode(["\n" + t for t in texts], num_threads=1)):
            if tuple(theirs[lead:]) != ours[k]:
                ours[k] = tuple(theirs[lead:])
                wrong.add(k)
        return ours, wrong

    def encode_batch(self, texts: list[str]) -> tuple[list[list[int]], list[str], list[int]]:
        """Ids of each text, the same as decimals joined by commas, and how many of its new units differed from the library."""
        distinct, which, (first, last) = self.units(texts)
        young, old = self.young, self.old
        ids = list(map(young.get, distinct))
        missing = []
        for k in [k for k, v in enumerate(ids) if v is None]:
            if (hit := old.get(distinct[k])) is not None:
                ids[k] = young[distinct[k]] = hit
            else:
                missing.append(k)
        wrong: set[int] = set()
        if missing:
            fresh, bad = self.learn([distinct[k] for k in missing])
            wrong = {missing[k] for k in bad}
            for k, v in zip(missing, fresh, strict=True):
                ids[k] = v
                if len(distinct[k]) <= UNIT_BYTES and k not in wrong:
                    young[distinct[k]] = v
        if len(young) > GENERATION:
            self.old, self.young = young, {}
        words = [",".join(map(str, v)) for v in ids]
        out, joined, bad_counts = [], [], []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            units = which[a:b].tolist()
            out.append(list(chain.from_iterable([ids[k] for k in units])))
            joined.append(",".join([words[k] for k in units]))
            bad_counts.append(len(wrong.intersection(units)) if wrong else 0)
        return out, joined, bad_counts


def encoder(model_file: str) -> AgendaEncoder:
    return resident(("pieces", model_file), lambda: AgendaEncoder(model_file))


def encode_decode(docs: DataFrame, *, model_file: str | None = None, text: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with sp_ids (array<int>), sp_n_tokens, sp_ids_sha256, sp_decoded, sp_decoded_sha256, sp_n_mismatch.

    ``keep_ids`` and ``keep_text`` leave out the two wide columns where only their digests are wanted.
    """
    model_file = model_file or default_model()
    bound_arrow(docs.sparkSession)
    added = [("sp_n_tokens", pa.int64()), ("sp_ids_sha256", pa.string()), ("sp_decoded_sha256", pa.string()), ("sp_n_mismatch", pa.int64())]
    added += [("sp_ids", pa.list_(pa.int32()))] * keep_ids + [("sp_decoded", pa.string())] * keep_text
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.list_(pa.int32()): T.ArrayType(T.IntegerType())}
    docs = docs.drop(*[c for c, _ in added])
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kinds[kind]) for name, kind in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids, joined, wrong = coder.encode_batch(texts)
            decoded = coder.library.decode(ids, num_threads=1) if ids else []
            cols = {
                "sp_n_tokens": [len(x) for x in ids], "sp_ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in joined], "sp_ids": ids,
                "sp_decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded], "sp_n_mismatch": wrong, "sp_decoded": decoded,
            }
            arrays = [*batch.columns, *[pa.array(cols[name], kind) for name, kind in added]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *[name for name, _ in added]])
        trim()

    return docs.mapInArrow(run, schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs, keep_ids=False, keep_text=False)
    return out.select(
        "doc_id", F.col("sp_n_tokens").alias("n_tokens"), F.col("sp_ids_sha256").alias("ids_sha256"),
        F.col("sp_decoded_sha256").alias("decoded_sha256"), F.col("sp_n_mismatch").alias("n_mismatch"),
    )
