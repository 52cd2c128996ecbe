"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .fingerprints import op4_document_fingerprints
from .html_extract import op10_html_extraction
from .jaccard_join import op5_ngram_jaccard_join
from .language_id import op8_language_id
from .lm_scoring import op2_lm_scoring
from .long_repeats import op11_long_repeats
from .merkle_manifest import OP12_SQL, op12_merkle_manifest
from .packing import op7_best_fit_packing
from .preference import OP6_SQL, op6_preference_formatting
from .quality_classifier import op9_quality_classifier
from .quality_rules import op3_quality_rules
from .sentencepiece_lattice import op1_sentencepiece
from .token_alignment import op13_token_alignment

_FUNCTIONS = (
    op1_sentencepiece,
    op2_lm_scoring,
    op3_quality_rules,
    op4_document_fingerprints,
    op5_ngram_jaccard_join,
    op6_preference_formatting,
    op7_best_fit_packing,
    op8_language_id,
    op9_quality_classifier,
    op10_html_extraction,
    op11_long_repeats,
    op12_merkle_manifest,
    op13_token_alignment,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

SQL: dict[str, str] = {"op6_preference_formatting": OP6_SQL, "op12_merkle_manifest": OP12_SQL}
