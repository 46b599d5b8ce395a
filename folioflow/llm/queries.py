"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, binary_ids, images, jaccard, language_id, merkle, mixing, packing, quality, toolcalls, toxicity, warc, wordpiece

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op10_rtree_join": jaccard.op10_rtree_join,
    "op2_robust_outliers": quality.op2_robust_outliers,
    "op3_wordpiece_counts": wordpiece.op3_wordpiece_counts,
    "op5_tool_calls": toolcalls.op5_tool_calls,
    "op6_image_copies": images.op6_image_copies,
    "op4_hierarchical_mix": mixing.op4_hierarchical_mix,
    "op7_token_files": binary_ids.op7_token_files,
    "op8_language_id": language_id.op8_language_id,
    "op9_packing": packing.op9_packing,
    "op11_alignment": alignment.op11_alignment,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_warc": warc.op13_warc,
}

ORACLES: dict[str, str] = {"op4_hierarchical_mix": mixing.OP4_SQL, "op12_merkle_manifest": merkle.OP12_SQL, "op13_warc": warc.OP13_SQL}
