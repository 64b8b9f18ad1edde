"""The contract queries of this subpackage, and the SQL of those that SQL can express."""

from . import audit, collocations, decontaminate, lines, lm, mixing, pii, quality, quality_rules, simhash, substrings, toxicity, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_lm_score": lm.op4_lm_score,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_mix": mixing.op10_mix,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_collocations": collocations.op12_collocations,
    "op13_line_dedup": lines.op13_line_dedup,
}

ORACLE_SQL = {
    "op4_lm_score": lm.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op10_mix": mixing.ORACLE,
    "op11_filter_audit": audit.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_line_dedup": lines.ORACLE,
}
