"""The thin queries over the given tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import chat, decontam, exact_dedup, langid, mixing, quality, runs, secrets, simhash, substring_dedup, toxicity, vector_codes, warc

QUERIES = {"op3_substring_dedup": substring_dedup.query, "op7_toxicity": toxicity.query, "op5_chat_format": chat.query, "op9_secrets": secrets.query, "op4_mixing": mixing.query, "op10_quality": quality.query, "op2_language_id": langid.query, "op6_decontamination": decontam.query, "op1_exact_dedup": exact_dedup.query, "op8_simhash_near_dedup": simhash.query, "op11_periodic_runs": runs.query, "op12_vector_codes": vector_codes.query, "op13_warc": warc.query}
ORACLES = {"op3_substring_dedup": substring_dedup.ORACLE, "op5_chat_format": chat.ORACLE, "op9_secrets": secrets.ORACLE, "op4_mixing": mixing.ORACLE, "op6_decontamination": decontam.ORACLE, "op1_exact_dedup": exact_dedup.ORACLE, "op11_periodic_runs": runs.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_warc": warc.ORACLE}
