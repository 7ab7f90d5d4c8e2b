"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from lexmill.llm import decontaminate, exact_dedup, licenses, line_dedup, mix, near_dedup, quality, token_ids, toxicity, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_warc": warc.op2_warc,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_token_ids": token_ids.op5_token_ids,
    "op6_mixing": mix.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality": quality.op8_quality,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_mixing": mix.OP6_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
}
