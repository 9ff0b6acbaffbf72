"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import archives, chats, decontaminate, licenses, lm_score, mixture, quality, resample, simhash, suffix_dedup, token_files, toxicity, whitening

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_files": token_files.op4_token_files,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_mixture": mixture.op6_mixture,
    "op7_arc_to_warc": archives.op7_arc_to_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_licenses": licenses.op10_licenses,
    "op11_whitening": whitening.op11_whitening,
    "op12_resample": resample.op12_resample,
    "op13_chats": chats.op13_chats,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op6_mixture": mixture.ORACLE,
    "op7_arc_to_warc": archives.ORACLE,
    "op12_resample": resample.ORACLE,
    "op13_chats": chats.ORACLE,
}
