"""Registered queries of the operators, and their SQL where SQL can express them."""

from .chat import op9_chat_formatting
from .clustering import OP11_SQL, op11_dual_tree_lloyd
from .decontamination import op6_decontamination
from .html_extraction import op8_html_extraction
from .language_id import op4_language_id
from .line_dedup import OP10_SQL, op10_line_dedup
from .media import op7_media_fingerprints
from .near_dedup import op5_minhash_near_dedup
from .packing import op2_length_packing
from .spelling import op12_wavelet_spelling
from .token_output import op3_token_output
from .toxicity import op1_toxicity
from .vector_dedup import OP13_SQL, op13_multi_index_dedup

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_length_packing": op2_length_packing,
    "op3_token_output": op3_token_output,
    "op4_language_id": op4_language_id,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_media_fingerprints": op7_media_fingerprints,
    "op8_html_extraction": op8_html_extraction,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_line_dedup": op10_line_dedup,
    "op11_dual_tree_lloyd": op11_dual_tree_lloyd,
    "op12_wavelet_spelling": op12_wavelet_spelling,
    "op13_multi_index_dedup": op13_multi_index_dedup,
}
ORACLES = {"op10_line_dedup": OP10_SQL, "op11_dual_tree_lloyd": OP11_SQL, "op13_multi_index_dedup": OP13_SQL}
