"""Registered queries of this subpackage and their SQL."""

import corpus_pipeline
from landspan.llm import (
    alignment,
    bpe,
    chat,
    decontaminate,
    fingerprints,
    licenses,
    mixing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    url_filter,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_score": quality.op2_quality_score,
    "op3_url_reputation": url_filter.op3_url_reputation,
    "op4_spaced_seed_overlaps": decontaminate.op4_spaced_seed_overlaps,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_rendezvous_shards": sharding.op6_rendezvous_shards,
    "op7_iblt_fingerprints": fingerprints.op7_iblt_fingerprints,
    "op8_simhash_components": simhash.op8_simhash_components,
    "op9_chat_format": chat.op9_chat_format,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_source_mix": mixing.op13_source_mix,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_url_reputation": url_filter.ORACLE_SQL,
    "op9_chat_format": chat.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_source_mix": mixing.ORACLE_SQL,
}
