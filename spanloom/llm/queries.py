"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from .langid import op6_viterbi_langid
from .lines import OP4_SQL, op4_site_lines
from .media import op7_jpeg_payload
from .neighbours import op9_nn_descent
from .ngramjoin import op3_signature_trees
from .packing import op8_vector_packing
from .pages import op10_url_differencing
from .sharding import op5_hash_tree
from .substrings import op2_repeated_spans

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_repeated_spans": op2_repeated_spans,
    "op3_signature_trees": op3_signature_trees,
    "op4_site_lines": op4_site_lines,
    "op5_hash_tree": op5_hash_tree,
    "op6_viterbi_langid": op6_viterbi_langid,
    "op7_jpeg_payload": op7_jpeg_payload,
    "op8_vector_packing": op8_vector_packing,
    "op9_nn_descent": op9_nn_descent,
    "op10_url_differencing": op10_url_differencing,
}

SQL: dict[str, str] = {"op4_site_lines": OP4_SQL}
