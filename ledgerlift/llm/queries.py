"""Queries of this folder's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerlift.llm import (
    ann, chat, exact, fingerprints, langid, lexical, minhash, mixing, negatives, packing, sharding, substring, url_filter,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_packing": packing.op3_packing,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_nearest": ann.op5_nearest,
    "op6_minhash_dedup": minhash.op6_minhash_dedup,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_language_id": langid.op9_language_id,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_exact_dedup": exact.op11_exact_dedup,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE = {**chat.ORACLE, **mixing.ORACLE, **exact.ORACLE, **lexical.ORACLE, **negatives.ORACLE}
