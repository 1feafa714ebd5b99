"""The queries of this subpackage by name, with the DuckDB SQL that gives the same rows."""

from . import decontaminate, langid, licenses, mixing, pii, quality, rules, simhash, substrings, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_warc": warc.op3_warc,
    "op4_language_id": langid.op4_language_id,
    "op5_quality": quality.op5_quality,
    "op6_pii": pii.op6_pii,
    "op7_simhash": simhash.op7_simhash,
    "op8_licenses": licenses.op8_licenses,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_substrings": substrings.op10_substrings,
}
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op8_licenses": licenses.op8_sql(),
    "op9_quality_rules": rules.OP9_SQL,
}
