"""Queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquesina.llm import bpe, decontaminate, dialogue, divergence, html, language, lines, packing, private, quality, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_leaks": decontaminate.op1_benchmark_leaks,
    "op2_toxicity_scores": toxicity.op2_toxicity_scores,
    "op3_packed_sequences": packing.op3_packed_sequences,
    "op4_quality_ledger": quality.op4_quality_ledger,
    "op5_repeated_passages": substrings.op5_repeated_passages,
    "op6_language_scores": language.op6_language_scores,
    "op7_repeated_lines": lines.op7_repeated_lines,
    "op8_private_data": private.op8_private_data,
    "op9_main_text": html.op9_main_text,
    "op10_simhash_groups": simhash.op10_simhash_groups,
    "op11_dialogue_repair": dialogue.op11_dialogue_repair,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_bpe_round_trip": bpe.op13_bpe_round_trip,
}

SQL: dict[str, str] = {
    "op4_quality_ledger": quality.OP4_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
