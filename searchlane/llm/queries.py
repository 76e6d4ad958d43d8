"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
from searchlane.llm import op1_token_rollup as _op1
from searchlane.llm import op2_license_digest as _op2
from searchlane.llm import op8_mix_sources as _op8
from searchlane.llm import op12_divergence_audit as _op12
from searchlane.llm.op3_substring_dedup import op3_substring_dedup
from searchlane.llm.op4_rule_quality import op4_rule_quality
from searchlane.llm.op5_simhash_golay import op5_simhash_golay
from searchlane.llm.op6_prefix_forest import op6_prefix_forest
from searchlane.llm.op7_suffix_decontam import op7_suffix_decontam
from searchlane.llm.op9_weak_toxicity import op9_weak_toxicity
from searchlane.llm.op10_logbilinear import op10_logbilinear
from searchlane.llm.op11_importance_resampling import op11_importance_resampling
from searchlane.llm.op13_odd_sketches import op13_odd_sketches

QUERIES = {
    "op1_token_rollup": _op1.op1_token_rollup,
    "op2_license_digest": _op2.op2_license_digest,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_rule_quality": op4_rule_quality,
    "op5_simhash_golay": op5_simhash_golay,
    "op6_prefix_forest": op6_prefix_forest,
    "op7_suffix_decontam": op7_suffix_decontam,
    "op8_mix_sources": _op8.op8_mix_sources,
    "op9_weak_toxicity": op9_weak_toxicity,
    "op10_logbilinear": op10_logbilinear,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_divergence_audit": _op12.op12_divergence_audit,
    "op13_odd_sketches": op13_odd_sketches,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_token_rollup": _op1.ORACLE,
    "op2_license_digest": _op2.ORACLE,
    "op8_mix_sources": _op8.ORACLE,
    "op12_divergence_audit": _op12.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
