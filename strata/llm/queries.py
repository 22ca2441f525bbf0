"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from strata.llm import (bpe, decontamination, html_extraction, lexical_search, licenses, line_dedup, packing, periodic_runs,
                        quality_classifier, quality_rules, simhash, suffix_dedup, token_files)

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_packing": packing.op13_packing,
}

ORACLE = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op9_license_scan": licenses.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
}
