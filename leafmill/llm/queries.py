"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from leafmill.llm import align, lattice, lm, lpf, mil, packing, phrases, pieces, rules, sharding, simhash, substring, warc

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op6_sharding": sharding.op6_sharding,
    "op5_lattice": lattice.op5_lattice,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op3_quality_mil": mil.op3_quality_mil,
    "op2_warc": warc.op2_warc,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_quality_rules": rules.op8_quality_rules,
    "op9_simhash": simhash.op9_simhash,
    "op10_packing": packing.op10_packing,
    "op11_phrases": phrases.op11_phrases,
    "op12_suffix_dedup": lpf.op12_suffix_dedup,
    "op13_alignment": align.op13_alignment,
}

SQL = {
    "op5_lattice": lattice.OP5_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op2_warc": warc.OP2_SQL,
    "op8_quality_rules": rules.OP8_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_suffix_dedup": lpf.OP12_SQL,
}
