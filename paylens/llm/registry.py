"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from paylens.llm import chat, decontaminate, language, licenses, mixing, neighbours, pieces, quality, repair, search, simhash, substrings, suffixes

QUERIES = {
    "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
    "op2_mixing": mixing.op2_mixing,
    "op3_language_id": language.op3_language_id,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_chat_format": chat.op8_chat_format,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_lexical_search": search.op13_lexical_search,
}

ORACLE = {
    "op4_license_scan": licenses.op4_sql(),
    "op6_substring_dedup": substrings.op6_sql(),
    "op8_chat_format": chat.op8_sql(),
    "op9_suffix_dedup": suffixes.op9_sql(),
    "op12_decontamination": decontaminate.op12_sql(),
    "op13_lexical_search": search.op13_sql(),
}
