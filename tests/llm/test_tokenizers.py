import hashlib
import random

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import pieces, tokencount

SAMPLES = ["", " ", "a", "  a", "it's we're they'll I'd 's 'll !'s x'S", "a\n 'b\n\n  c \t", "don't\n're '", "héllo wörld 123 4½ 日本語😀", "a<|endoftext|>b <|endoftext|>", "x" * 300, "ab  c d\r\n", "'", "''s", " '", "l'l 'l 'r 've", "\x00\x1c a\x85b"]


def library_counts(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_library():
    c = tokencount.counter(tokencount.default_tokenizer())
    assert c.counts(SAMPLES) == library_counts(SAMPLES)
    rnd = random.Random(3)
    alphabet = "abcdeé 'stremlvd\n\t 1.2,—ñß日  "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(400)]
    assert c.counts(texts) == library_counts(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_counts_any_text(texts):
    assert tokencount.counter(tokencount.default_tokenizer()).counts(texts) == library_counts(texts)


def test_scan_equals_sequential():
    import numpy as np

    rng = np.random.default_rng(0)
    cls = rng.integers(0, tokencount.N_CLASS, 5000).astype(np.uint8)
    state, want = tokencount.S_START, []
    for c in cls:
        want.append(tokencount._MARK[c * tokencount.N_STATE + state])
        state = tokencount._TO[c * tokencount.N_STATE + state]
    assert tokencount.starts(cls, chunk=64).tolist() == [bool(x) for x in want]


def test_states_are_dropped_and_recompiled(monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_STATES", 10)
    c = tokencount.Counter(tokencount.default_tokenizer())
    assert c.counts(SAMPLES) == c.counts(SAMPLES) == library_counts(SAMPLES)
    rnd = random.Random(5)
    hard = ["".join(rnd.choice("abcdefgh") for _ in range(5000))]  # one long pre-token never seen before
    assert c.counts(hard) == library_counts(hard) and len(c.bpe.states) <= 14


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_agenda_equals_sentencepiece(texts):
    c = pieces.encoder(pieces.default_model())
    ids, joined, wrong = c.encode_batch(texts)
    assert ids == c.library.encode(texts) and not any(wrong) and joined == [",".join(map(str, x)) for x in ids]


def test_agenda_without_cache():
    c = pieces.AgendaEncoder(pieces.default_model())
    for t in [*SAMPLES, "▁a ▁▁b", "<s>hi</s> <0x0A> <unk>", "the   quick    brown"]:
        assert (c.encode_unit("▁" + t.replace(" ", "▁")) if t else []) == c.library.encode(t)


def test_columns_nulls_and_clashes(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (3, "Hello world", 7), (None, "x" * 70000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sp_n_tokens long")
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in pieces.encode_decode(df).collect():
        ids = lib.encode(r.text or "")
        assert r.sp_ids == ids and r.sp_n_tokens == len(ids) and r.sp_decoded == lib.decode(ids)
        assert r.sp_ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.sp_decoded_sha256 == hashlib.sha256(r.sp_decoded.encode()).hexdigest()
    got = {(r.doc_id, r.tc_n_bytes): r.tc_n_tokens for r in tokencount.token_counts(df).collect()}
    assert got[(1, 0)] == 0 and got[(3, 11)] == 2 and got[(None, 70000)] == library_counts(["x" * 70000])[0]
    assert pieces.encode_decode(df.limit(0)).count() == 0 and tokencount.token_counts(df.limit(0)).count() == 0


def test_queries_equal_the_libraries_on_whole_texts(spark):
    """Both queries over every document of sf0.01, against the libraries on whole texts."""
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    n = dict(zip(text, library_counts(list(text.values())), strict=True))
    for r in tokencount.op5_token_counts(spark, sf).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n[r.doc_id], n[r.doc_id] > 512)
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in pieces.op8_sentencepiece(spark, sf).collect():
        ids = lib.encode(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and r.n_mismatch == 0
