"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_suffix, op2_simhash, op3_decontaminate, op4_urls, op5_exact, op6_lines, op7_pii, op8_toxicity, op9_packing, op10_tokens

MODULES = (op1_suffix, op2_simhash, op3_decontaminate, op4_urls, op5_exact, op6_lines, op7_pii, op8_toxicity, op9_packing, op10_tokens)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
