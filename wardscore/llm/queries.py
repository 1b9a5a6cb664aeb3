"""The queries of this subpackage and the SQL of those that DuckDB can answer."""

from __future__ import annotations

from wardscore.llm import (
    bpe,
    context_mixing,
    embedding_dedup,
    html_render,
    importance_resampling,
    line_quality,
    minhash_dedup,
    mixing,
    norm_buckets,
    permutation_index,
    sharding,
    token_alignment,
    url_filter,
)

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_sharding": sharding.query,
    "op3_bpe": bpe.query,
    "op4_mixing": mixing.query,
    "op5_line_quality": line_quality.query,
    "op6_context_mixing": context_mixing.query,
    "op7_minhash_dedup": minhash_dedup.query,
    "op8_permutation_index": permutation_index.query,
    "op9_html_render": html_render.query,
    "op10_url_filter": url_filter.query,
    "op11_token_alignment": token_alignment.query,
    "op12_importance_resampling": importance_resampling.query,
    "op13_norm_buckets": norm_buckets.query,
}

ORACLES = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op12_importance_resampling": importance_resampling.ORACLE,
    "op13_norm_buckets": norm_buckets.ORACLE,
}
