"""The subpackage's queries and their SQL."""

from __future__ import annotations

from symloom.llm import jaccard, lines, media, mixing, packing, secrets, substrings, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": substrings.op2_suffix_dedup,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_warc_audit": warc.op4_warc_audit,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_media_telephony": media.op10_media_telephony,
}

ORACLES: dict[str, str] = {
    "op3_secret_scan": secrets.oracle(),
    "op7_line_dedup": lines.ORACLE,
    "op8_exact_topk": topk.ORACLE,
}
