"""The queries of this subpackage, by the names under which they are registered, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, exact_dedup, html_main, packing, prefix_trie, repetition, secret_tags, sentence_pieces, sharding, simhash, structure_repair, toxicity, warc

QUERIES = {
    "op1_compression_toxicity": toxicity.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_warc_shards": warc.query,
    "op4_crf_main_text": html_main.query,
    "op5_chat_prefix_tree": chat.query,
    "op6_best_fit_packing": packing.query,
    "op7_shared_prefix_pieces": sentence_pieces.query,
    "op8_suffix_array_quality": repetition.query,
    "op9_simhash_golay": simhash.query,
    "op10_weighted_hash_tree": sharding.query,
    "op11_z_fast_trie": prefix_trie.query,
    "op12_crf_secrets": secret_tags.query,
    "op13_lightest_repair": structure_repair.query,
}
SQL = {"op2_exact_dedup": exact_dedup.SQL, "op3_warc_shards": warc.SQL, "op5_chat_prefix_tree": chat.SQL, "op11_z_fast_trie": prefix_trie.SQL, "op13_lightest_repair": structure_repair.SQL}
