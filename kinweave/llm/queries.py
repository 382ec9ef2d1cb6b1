"""The queries of this subpackage, by name, and the SQL that gives the same results."""

from __future__ import annotations

from kinweave.llm import (
    ann, encoding, lexical, lm, merkle, packing, quality, simhash, substring, tokencounts, tokenfiles, toxicity, urlrules,
)

QUERIES = {
    "op1_edit_aware_counts": tokencounts.op1_edit_aware_counts,
    "op2_rlz_repeats": substring.op2_rlz_repeats,
    "op3_attention_lm": lm.op3_attention_lm,
    "op4_streaming_bpe": encoding.op4_streaming_bpe,
    "op5_differencing_pack": packing.op5_differencing_pack,
    "op6_permutation_index": ann.op6_permutation_index,
    "op7_golay_simhash": simhash.op7_golay_simhash,
    "op8_adaptive_quality": quality.op8_adaptive_quality,
    "op9_mil_toxicity": toxicity.op9_mil_toxicity,
    "op10_url_rules": urlrules.op10_url_rules,
    "op11_pregel_merkle": merkle.op11_pregel_merkle,
    "op12_windowed_search": lexical.op12_windowed_search,
    "op13_packed_ids": tokenfiles.op13_packed_ids,
}
ORACLES = {
    "op2_rlz_repeats": substring.ORACLE,
    "op8_adaptive_quality": quality.ORACLE,
    "op11_pregel_merkle": merkle.ORACLE,
    "op12_windowed_search": lexical.ORACLE,
}
