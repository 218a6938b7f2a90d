"""Registered queries of the corpus operators, and SQL where it can express one."""

from . import bitsliced_topk, byte_bpe, hyperlang, license_rules, ngram_lm, quality_rules, secret_scan, simhash, source_mix, toxic_segments

QUERIES = {
    "op1_bitsliced_topk": bitsliced_topk.op1_bitsliced_topk,
    "op10_markov_secrets": secret_scan.op10_markov_secrets,
    "op2_robust_outliers": quality_rules.op2_robust_outliers,
    "op3_license_rules": license_rules.op3_license_rules,
    "op4_ngram_lm": ngram_lm.op4_ngram_lm,
    "op5_mix_sources": source_mix.op5_mix_sources,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_toxic_segments": toxic_segments.op8_toxic_segments,
    "op9_hyperdimensional_language": hyperlang.op9_hyperdimensional_language,
}

ORACLES: dict[str, str] = {
    "op1_bitsliced_topk": bitsliced_topk.SQL,
    "op3_license_rules": license_rules.SQL,
    "op5_mix_sources": source_mix.SQL,
}
