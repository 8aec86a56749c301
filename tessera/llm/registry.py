"""Queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import bpe, decontamination, embedding_dedup, line_dedup, minhash, quality, secrets, sharding, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_minhash": minhash.op5_minhash,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_quality": quality.op9_quality,
    "op10_sharding": sharding.op10_sharding,
}

ORACLES = {
    "op1_url_filter": url_filter.oracle(),
    "op2_embedding_dedup": embedding_dedup.oracle(),
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_minhash": minhash.oracle(),
    "op6_decontamination": decontamination.ORACLE,
}
