"""The queries of the numbered operators and, where it can be said, their SQL."""

from __future__ import annotations

from folioquery.llm import (
    context_mixing, jaccard, language, line_templates, manifest, mixing, periods, pieces, quality, secrets, toxicity, vector_dups, wavelet)

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_context_mixing": context_mixing.op2_context_mixing,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_wavelet_shards": wavelet.op6_wavelet_shards,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_vector_dups": vector_dups.op8_vector_dups,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_line_templates": line_templates.op10_line_templates,
    "op11_language_id": language.op11_language_id,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

ORACLES = {
    "op7_quality_rules": quality.SQL,
    "op8_vector_dups": vector_dups.SQL,
    "op9_jaccard_join": jaccard.SQL,
    "op10_line_templates": line_templates.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_periodic_runs": periods.SQL,
}
