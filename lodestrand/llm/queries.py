"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from lodestrand.llm import decontaminate, dominance, eliasfano, fim, jaccard, language, linededup, nearest, ogg, packing, ppm, tokencounts, urls

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_lm_scoring": ppm.op2_lm_scoring,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_token_id_output": eliasfano.op4_token_id_output,
    "op5_packing": packing.op5_packing,
    "op6_token_counts": tokencounts.op6_token_counts,
    "op7_url_filter": urls.op7_url_filter,
    "op8_ogg_media": ogg.op8_ogg_media,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_language_id": language.op10_language_id,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_nearest_neighbours": nearest.op12_nearest_neighbours,
    "op13_dominance_counting": dominance.op13_dominance_counting,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": jaccard.ORACLE,
    "op3_benchmark_decontamination": decontaminate.ORACLE,
    "op7_url_filter": urls.ORACLE,
    "op9_line_dedup": linededup.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op13_dominance_counting": dominance.ORACLE,
}
