"""Registered queries of the training-data operators and their SQL."""

from .embedding_dedup import op4_embedding_dedup
from .host_reputation import OP1_SQL, op1_host_reputation
from .jaccard_join import op2_jaccard_join
from .language_id import op11_language_id
from .license_scan import op7_license_scan
from .line_dedup import op5_line_dedup
from .merkle_manifest import OP12_SQL, op12_merkle_manifest
from .packing import op3_packing
from .source_mix import OP9_SQL, op9_source_mix
from .token_alignment import op13_token_alignment
from .token_counts import op10_token_counts
from .toxicity import op6_toxicity
from .vector_search import op8_vector_search

LLM_QUERIES = {
    "op1_host_reputation": op1_host_reputation,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_vector_search": op8_vector_search,
    "op9_source_mix": op9_source_mix,
    "op10_token_counts": op10_token_counts,
    "op11_language_id": op11_language_id,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}
LLM_ORACLE_SQL = {
    "op1_host_reputation": OP1_SQL,
    "op9_source_mix": OP9_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
