"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_search, chat_format, decontaminate, lang_id, line_dedup, minhash_dedup, mix_sources, pii, quality, simhash_dedup, spelling, substring_dedup, token_align

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mix_sources": mix_sources.op3_mix_sources,
    "op4_lang_id": lang_id.op4_lang_id,
    "op5_ann_search": ann_search.op5_ann_search,
    "op6_simhash": simhash_dedup.op6_simhash,
    "op7_quality": quality.op7_quality,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_chat_formatting": chat_format.op9_chat_formatting,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_minhash": minhash_dedup.op12_minhash,
    "op13_spelling_groups": spelling.op13_spelling_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": mix_sources.OP3_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_chat_formatting": chat_format.OP9_SQL,
    "op12_minhash": minhash_dedup.OP12_SQL,
    "op13_spelling_groups": spelling.OP13_SQL,
}
