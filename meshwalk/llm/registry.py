"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from meshwalk.llm import decontaminate, hardneg, jaccard, lexical, mixing, personal, quality, substring, tokens, tokenstore, toxicity, urls, warc

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_jaccard_components": jaccard.op2_jaccard_components,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_line_quality": quality.op4_line_quality,
    "op5_warc_archives": warc.op5_warc_archives,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_token_store": tokenstore.op8_token_store,
    "op9_url_filter": urls.op9_url_filter,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_personal_data": personal.op11_personal_data,
    "op12_ranked_search": lexical.op12_ranked_search,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op4_line_quality": quality.OP4_SQL,
    "op5_warc_archives": warc.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op12_ranked_search": lexical.OP12_SQL,
    "op13_hard_negatives": hardneg.OP13_SQL,
}
