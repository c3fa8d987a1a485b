"""Registered queries of this package and their SQL."""

from __future__ import annotations

from .attribution import op7_token_counts
from .chat import OP3_SQL, op3_chat
from .fingerprint import op5_fingerprint
from .html_text import op12_extract
from .language import op6_language
from .mixing import OP4_SQL, op4_mixing
from .packing import op1_packing
from .quality import op10_quality
from .ranked import OP11_SQL, op11_search
from .simhash import op9_simhash
from .substrings import OP8_SQL, op8_substrings
from .toxicity import op2_toxicity
from .trie import OP13_SQL, op13_trie

QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_chat": op3_chat,
    "op4_mixing": op4_mixing,
    "op5_fingerprint": op5_fingerprint,
    "op6_language": op6_language,
    "op7_token_counts": op7_token_counts,
    "op8_substrings": op8_substrings,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_search": op11_search,
    "op12_extract": op12_extract,
    "op13_trie": op13_trie,
}
ORACLE_SQL = {
    "op3_chat": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op8_substrings": OP8_SQL,
    "op11_search": OP11_SQL,
    "op13_trie": OP13_SQL,
}
