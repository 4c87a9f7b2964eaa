"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from kinfold.llm.bpe import op2_bpe
from kinfold.llm.jaccard_join import op1_jaccard_join
from kinfold.llm.chat_format import ORACLE as CHAT_SQL
from kinfold.llm.chat_format import op5_chat_format
from kinfold.llm.license_scan import ORACLE as LICENSE_SQL
from kinfold.llm.license_scan import op6_license_scan
from kinfold.llm.lm_score import op3_lm_score
from kinfold.llm.nearest import op4_nearest
from kinfold.llm.quality_classifier import op10_quality_classifier
from kinfold.llm.quality_rules import op8_quality_rules
from kinfold.llm.source_mix import op7_source_mix
from kinfold.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_bpe": op2_bpe,
    "op3_lm_score": op3_lm_score,
    "op4_nearest": op4_nearest,
    "op5_chat_format": op5_chat_format,
    "op6_license_scan": op6_license_scan,
    "op7_source_mix": op7_source_mix,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {"op5_chat_format": CHAT_SQL, "op6_license_scan": LICENSE_SQL}
