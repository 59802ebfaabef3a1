"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe_codec import op6_byte_bpe
from .chat import OP7_SQL, op7_chat_format
from .hamming import OP2_SQL, op2_hamming_top_k
from .near_dedup import OP10_SQL, op10_minhash_odd_sketch
from .nn_descent import op1_nn_descent
from .packing import op4_best_fit_packing
from .suffix_dedup import op9_suffix_array_dedup
from .token_counts import op3_token_counts
from .toxicity import op8_toxicity_crf
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_hamming_top_k": op2_hamming_top_k,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_url_filter": op5_url_filter,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity_crf": op8_toxicity_crf,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_minhash_odd_sketch": op10_minhash_odd_sketch,
}

ORACLE_SQL = {
    "op2_hamming_top_k": OP2_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_chat_format": OP7_SQL,
    "op10_minhash_odd_sketch": OP10_SQL,
}
