"""The queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from lectern.llm import decontaminate, hnsw, langid, neardup, pieces, rollups, shards, toxicity, urls, warc

_ALL = (
    shards.op1_vector_bin_packing,
    langid.op2_naive_bayes_language_id,
    hnsw.op3_hnsw_near_dedup,
    pieces.op4_sentencepiece_prefix_table,
    rollups.op5_delta_rollups,
    urls.op6_url_filter,
    toxicity.op7_boosted_tree_toxicity,
    neardup.op8_superminhash_near_dedup,
    warc.op9_warc_segments,
    decontaminate.op10_spaced_seed_decontamination,
)


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_hnsw_near_dedup": hnsw.OP3_SQL,
        "op5_delta_rollups": rollups.OP5_SQL,
        "op8_superminhash_near_dedup": neardup.OP8_SQL,
        "op9_warc_segments": warc.OP9_SQL,
        "op10_spaced_seed_decontamination": decontaminate.OP10_SQL,
    }
