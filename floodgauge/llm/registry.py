"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floodgauge.llm import alignment, bpe, chat, decontaminate, exact_dedup, html_text, language, lexical, media, near_dedup, packing, records, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_media_fingerprints": media.op3_media_fingerprints,
    "op4_pack_sequences": packing.op4_pack_sequences,
    "op5_language_id": language.op5_language_id,
    "op6_token_records": records.op6_token_records,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_chat_format": chat.op9_chat_format,
    "op10_html_text": html_text.op10_html_text,
    "op11_align_tokens": alignment.op11_align_tokens,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}
SQL: dict[str, str] = {"op1_exact_dedup": exact_dedup.SQL, "op9_chat_format": chat.SQL, "op12_lexical_search": lexical.SQL, "op13_decontaminate": decontaminate.SQL}
