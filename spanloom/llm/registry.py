"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, dedup, edits, langid, neighbours, packing, pii, quality, ranking, sharding, signature_trees, toxicity, unigram

QUERIES = {
    "op1_language_id": langid.query,
    "op2_multiprobe_neighbours": neighbours.query,
    "op3_packing": packing.query,
    "op4_edit_aware_counts": edits.query,
    "op5_toxicity": toxicity.query,
    "op6_unigram_pieces": unigram.query,
    "op7_quality_rules": quality.query,
    "op8_pii": pii.query,
    "op9_minmax_dedup": dedup.query,
    "op10_hilbert_sharding": sharding.query,
    "op11_signature_tree_join": signature_trees.query,
    "op12_nra_search": ranking.query,
    "op13_fragment_alignment": alignment.query,
}

ORACLES = {"op7_quality_rules": quality.ORACLE, "op11_signature_tree_join": signature_trees.ORACLE, "op12_nra_search": ranking.ORACLE}
