import corpus_pipeline
from lodestar.llm import queries


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dup", "mix", "pieces"]


def test_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op2_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
        "op3_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op4_embedding_neardup": {"vec_id", "n_links", "component_id", "kept"},
        "op5_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op8_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op11_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op12_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
        "op13_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
        "op9_warc_round_trip": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    }
    kinds = {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "n_assign": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean", "held_out": "boolean", "score": "double", "payload_bytes": "bigint", "spans": "string"}
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, sf)
        types = dict(df.dtypes)
        assert cols <= set(types)
        assert all(types[c] == k for c, k in kinds.items() if c in cols), (name, types)
