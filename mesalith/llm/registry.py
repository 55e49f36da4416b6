"""Queries of the training-data operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from mesalith.llm import bpe, embedding_dedup, exact_dedup, line_dedup, near_dedup, packing, quality, secrets, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_quality": quality.op2,
    "op3_secret_scan": secrets.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_near_dedup": near_dedup.op5,
    "op6_toxicity": toxicity.op6,
    "op7_packing": packing.op7,
    "op8_bpe": bpe.op8,
    "op9_embedding_dedup": embedding_dedup.op9,
    "op10_url_filter": url_filter.op10,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
