"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from lumenar.llm import centroids, exact_dedup, fill_in_middle, knn_join, language_id, minhash, nbest, ngram_join, packing, sets, sharding, tool_calls, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op7_voronoi_knn_join": knn_join.op7_voronoi_knn_join,
    "op2_arc_to_warc": warc.op2_arc_to_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_id": language_id.op10_language_id,
    "op3_tool_call_linking": tool_calls.op3_tool_call_linking,
    "op8_nbest_segmentation": nbest.op8_nbest_segmentation,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_byte_shards": sharding.op6_byte_shards,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_ngram_jaccard_join": ngram_join.op12_ngram_jaccard_join,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLES = {
    "op2_arc_to_warc": warc.ORACLE,
    "op3_tool_call_linking": tool_calls.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_minhash_near_dedup": sets.groups_oracle(4, 80),
    "op7_voronoi_knn_join": knn_join.ORACLE,
    "op11_centroid_clusters": centroids.ORACLE,
    "op12_ngram_jaccard_join": ngram_join.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
