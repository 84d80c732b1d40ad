"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .decontaminate import op3_benchmark_decontamination
from .fingerprints import op9_document_fingerprints
from .html import op6_html_extraction
from .pieces import op7_sentencepiece
from .quality import op4_quality_classifier
from .secrets import op10_secret_scan
from .simhash import op2_simhash_near_dedup
from .suffix_dedup import op1_suffix_dedup
from .urls import op8_url_filters

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_html_extraction": op6_html_extraction,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_url_filters": op8_url_filters,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_secret_scan": op10_secret_scan,
}
SQL = {"op5_chat_formatting": OP5_SQL}
