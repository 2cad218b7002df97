"""The subpackage's queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .langid import op10_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import op1_mixing
from .packing import op8_best_fit_packing
from .pii import op9_pii
from .quality import ABLATIONS_SQL, OP5_SQL, op5_quality_rules, quality_ablations
from .simhash import op7_simhash
from .token_count import op2_token_counts
from .token_file import op4_token_files
from .va_file import OP3_SQL, op3_vector_top_k

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_vector_top_k": op3_vector_top_k,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "quality_ablations": quality_ablations,
}

ORACLE_SQL = {
    "op3_vector_top_k": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "quality_ablations": ABLATIONS_SQL,
}
