"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from factloom.llm import audio_fingerprint, conversation_repair, edit_counts, group_join, hard_negatives, html_template, mixing, near_dedup, quality_rules, rule_ensemble, secret_scan, token_files, unigram_pieces

QUERIES = {
    "op1_audio_fingerprint": audio_fingerprint.op1_audio_fingerprint,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_unigram_pieces": unigram_pieces.op3_unigram_pieces,
    "op4_edit_counts": edit_counts.op4_edit_counts,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_rule_ensemble": rule_ensemble.op6_rule_ensemble,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_token_files": token_files.op9_token_files,
    "op10_html_template": html_template.op10_html_template,
    "op11_group_join": group_join.op11_group_join,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op7_near_dedup": group_join.OP7_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op11_group_join": group_join.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
