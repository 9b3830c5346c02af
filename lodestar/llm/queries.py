"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from lodestar.llm.bm25 import OP1_SQL, op1_bm25_topk
from lodestar.llm.capfilters import OP4_SQL, op4_embedding_neardup
from lodestar.llm.hardneg import OP12_SQL, op12_hard_negatives
from lodestar.llm.langid import op7_language_id
from lodestar.llm.linededup import OP10_SQL, op10_line_dedup
from lodestar.llm.mixing import OP2_SQL, op2_mix_sources
from lodestar.llm.neardup import OP6_SQL, op6_ngram_jaccard_join
from lodestar.llm.pieces import op8_sentencepiece
from lodestar.llm.pii import op11_pii
from lodestar.llm.secrets import op3_secret_scan
from lodestar.llm.tokencount import op5_token_counts
from lodestar.llm.warc import OP9_SQL, op9_warc_round_trip
from lodestar.llm.whitening import op13_whitening

QUERIES = {
    "op1_bm25_topk": op1_bm25_topk,
    "op2_mix_sources": op2_mix_sources,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_neardup": op4_embedding_neardup,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_line_dedup": op10_line_dedup,
    "op11_pii": op11_pii,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op1_bm25_topk": OP1_SQL,
    "op2_mix_sources": OP2_SQL,
    "op4_embedding_neardup": OP4_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op9_warc_round_trip": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
}
