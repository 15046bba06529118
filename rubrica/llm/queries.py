"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from rubrica.llm import decontaminate, html_text, jaccard, language, merkle, packing, pigeonring, quality, quality_rules, sharding, sort_means, toxicity, warc

QUERIES = {
    "op1_block_max_wand": decontaminate.op1_block_max_wand,
    "op2_rendezvous": sharding.op2_rendezvous,
    "op3_segment_scan": toxicity.op3_segment_scan,
    "op4_subword_embeddings": quality.op4_subword_embeddings,
    "op5_revisit_archives": warc.op5_revisit_archives,
    "op6_line_first": quality_rules.op6_line_first,
    "op7_word_crf": language.op7_word_crf,
    "op8_signature_trees": jaccard.op8_signature_trees,
    "op9_tree_model": html_text.op9_tree_model,
    "op10_pattern_packing": packing.op10_pattern_packing,
    "op11_sort_means": sort_means.op11_sort_means,
    "op12_postorder_manifest": merkle.op12_postorder_manifest,
    "op13_pigeonring": pigeonring.op13_pigeonring,
}
ORACLE_SQL = {
    "op6_line_first": quality_rules.ORACLE_SQL,
    "op11_sort_means": sort_means.ORACLE_SQL,
    "op12_postorder_manifest": merkle.ORACLE_SQL,
}
