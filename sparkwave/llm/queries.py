"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_warc, op2_decontamination, op3_packing, op4_hash_forest, op5_ppm, op6_html_blocks, op7_jaccard_join, op8_toxicity, op9_chat_format, op10_token_ids, op11_hard_negatives, op12_conversation_repair, op13_mixing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc.op1_warc,
    "op2_decontamination": op2_decontamination.op2_decontamination,
    "op3_packing": op3_packing.op3_packing,
    "op4_hash_forest": op4_hash_forest.op4_hash_forest,
    "op5_ppm": op5_ppm.op5_ppm,
    "op6_html_blocks": op6_html_blocks.op6_html_blocks,
    "op7_jaccard_join": op7_jaccard_join.op7_jaccard_join,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_chat_format": op9_chat_format.op9_chat_format,
    "op10_token_ids": op10_token_ids.op10_token_ids,
    "op11_hard_negatives": op11_hard_negatives.op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair.op12_conversation_repair,
    "op13_mixing": op13_mixing.op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": op1_warc.SQL,
    "op2_decontamination": op2_decontamination.SQL,
    "op7_jaccard_join": op7_jaccard_join.SQL,
    "op11_hard_negatives": op11_hard_negatives.SQL,
    "op13_mixing": op13_mixing.SQL,
}
