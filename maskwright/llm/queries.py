"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import conversations, decontamination, exact_dedup, lexical, licenses, minhash, ngram_rules, packing, quality, substring_dedup, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_warc": warc.op4_warc,
    "op5_url_filter": urls.op5_url_filter,
    "op6_quality": quality.op6_quality,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_quality_rules": ngram_rules.op12_quality_rules,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
