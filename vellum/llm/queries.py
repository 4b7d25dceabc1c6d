"""The queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from .chat import OP10_SQL, op10_query
from .compression import op6_query
from .decontaminate import OP7_SQL, op7_query
from .exponion import OP11_SQL, op11_query
from .forest import op5_query
from .html_text import op2_query
from .ivf_pq import op13_query
from .nbsvm import op3_query
from .packing import op9_query
from .phrases import op4_query
from .simhash import op8_query
from .spelling import OP12_SQL, op12_query
from .suffix_array import op1_query

QUERIES = {
    "op1_suffix_array_dedup": op1_query,
    "op2_html_consensus_paths": op2_query,
    "op3_quality_nbsvm": op3_query,
    "op4_phrase_automata": op4_query,
    "op5_projection_forest": op5_query,
    "op6_toxicity_compression": op6_query,
    "op7_minhash_decontamination": op7_query,
    "op8_simhash_pivots": op8_query,
    "op9_bin_slack_packing": op9_query,
    "op10_chat_round_trip": op10_query,
    "op11_exponion_clusters": op11_query,
    "op12_spelling_pigeonhole": op12_query,
    "op13_ivf_pq_neighbours": op13_query,
}

ORACLE: dict[str, str] = {
    "op7_minhash_decontamination": OP7_SQL,
    "op10_chat_round_trip": OP10_SQL,
    "op11_exponion_clusters": OP11_SQL,
    "op12_spelling_pigeonhole": OP12_SQL,
}
