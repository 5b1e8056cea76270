"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import conversations, decontaminate, gru_lm, licenses, lines, packing, quality, secrets, simhash, substring, toxicity, vector_codes, vector_topk

QUERIES = {
    "op1_length_buckets": packing.op1_length_buckets,
    "op2_cotraining": quality.op2_cotraining,
    "op3_toxicity_bigru": toxicity.op3_toxicity_bigru,
    "op4_license_join": licenses.op4_license_join,
    "op5_superkmer_dedup": substring.op5_superkmer_dedup,
    "op6_simhash_golay": simhash.op6_simhash_golay,
    "op7_voronoi_topk": vector_topk.op7_voronoi_topk,
    "op8_gru_lm": gru_lm.op8_gru_lm,
    "op9_line_edit_join": lines.op9_line_edit_join,
    "op10_string_tiling": decontaminate.op10_string_tiling,
    "op11_annular_codes": vector_codes.op11_annular_codes,
    "op12_secret_cnn": secrets.op12_secret_cnn,
    "op13_dijkstra_repair": conversations.op13_dijkstra_repair,
}

ORACLE_SQL = {
    "op1_length_buckets": packing.OP1_SQL,
    "op4_license_join": licenses.OP4_SQL,
    "op5_superkmer_dedup": substring.OP5_SQL,
    "op7_voronoi_topk": vector_topk.OP7_SQL,
    "op11_annular_codes": vector_codes.OP11_SQL,
}
