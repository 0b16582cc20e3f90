"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from barline.llm import sql
from barline.llm.op1_lm_score import op1_lm_score
from barline.llm.op2_secrets import op2_secret_scan
from barline.llm.op3_line_dedup import op3_line_dedup
from barline.llm.op4_near_dup import op4_near_dup
from barline.llm.op5_langid import op5_language_id
from barline.llm.op6_decontaminate import op6_decontaminate
from barline.llm.op7_quality_rules import op7_quality_rules
from barline.llm.op8_toxicity import op8_toxicity
from barline.llm.op9_quality_classifier import op9_quality_classifier
from barline.llm.op10_packing import op10_packing
from barline.llm.op11_spelling import op11_spelling_variants
from barline.llm.op12_mixing import op12_source_mix
from barline.llm.op13_whitening import op13_embedding_whitening

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dup": op4_near_dup,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_mix": op12_source_mix,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op1_lm_score": sql.lm_score(),
    "op2_secret_scan": sql.secret_scan(),
    "op4_near_dup": sql.near_dup(),
    "op6_decontaminate": sql.decontaminate(),
    "op7_quality_rules": sql.quality_rules(),
    "op11_spelling_variants": sql.spelling_variants(),
}
