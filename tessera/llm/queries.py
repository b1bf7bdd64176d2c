"""The queries of this subpackage: opN_<name> over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from .decontamination import op2_decontamination
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .html_text import op12_html_text
from .licenses import op10_license_scan
from .line_dedup import OP3_SQL, op3_line_dedup
from .mixing import op5_source_mixing
from .near_dedup import op9_near_dedup
from .phrases import OP11_SQL, op11_phrases
from .quality import op4_quality_classifier
from .secrets import op8_secret_scan
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op1_suffix_dedup

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_source_mixing": op5_source_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_phrases": op11_phrases,
    "op12_html_text": op12_html_text,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {"op3_line_dedup": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op11_phrases": OP11_SQL, "op13_filter_audit": OP13_SQL}
