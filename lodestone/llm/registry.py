"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, collocations, exact_dedup, merkle, mixing, packing, quality, secrets, simhash, substring_dedup, suffix_dedup, topk, url_rules

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_packing": packing.op9_packing,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_collocations": collocations.op11_collocations,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_url_filter": url_rules.op13_url_filter,
}

ORACLES = {
    "op1_exact_topk": topk.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_url_filter": url_rules.OP13_SQL,
}
