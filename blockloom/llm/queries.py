"""The operators' queries over the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import collocations, crosswalk, jaccard, leaks, licenses, pieces, quality, repeats, secrets, tokens, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_url_filter": urls.op3_url_filter,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_secrets": secrets.op5_secrets,
    "op6_decontamination": leaks.op6_decontamination,
    "op7_warc": warc.op7_warc,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_licenses": licenses.op9_licenses,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_substring_dedup": repeats.op11_substring_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_alignment": crosswalk.op13_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": jaccard.SQL,
    "op3_url_filter": urls.SQL,
    "op6_decontamination": leaks.SQL,
    "op7_warc": warc.SQL,
    "op9_licenses": licenses.SQL,
    "op10_quality_rules": quality.SQL,
    "op11_substring_dedup": repeats.SQL,
    "op12_collocations": collocations.SQL,
}
