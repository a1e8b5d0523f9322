"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from orderloom.llm import bottom_k, byte_bpe, chroma, html_main, mixing, pii, prefix_trie, quality, secret_scan, simhash, spelling, token_counts, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_secret_scan": secret_scan.op2_secret_scan,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_simhash": simhash.op4_simhash,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_mixing": mixing.op7_mixing,
        "op8_chroma_fingerprints": chroma.op8_chroma_fingerprints,
        "op9_personal_data": pii.op9_personal_data,
        "op10_html_extraction": html_main.op10_html_extraction,
        "op11_bottom_k": bottom_k.op11_bottom_k,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op2_secret_scan": secret_scan.op2_sql(),
        "op3_url_filter": url_filter.op3_sql(),
        "op7_mixing": mixing.OP7_SQL,
        "op11_bottom_k": bottom_k.OP11_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
