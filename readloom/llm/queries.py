"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from readloom.llm import alignment, embed_dedup, fingerprints, langid, mixing, packing, simhash, token_counts, token_files, topk, toxicity, turn_repair, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_topk_search": topk.query,
    "op3_token_files": token_files.query,
    "op4_simhash": simhash.query,
    "op5_language_id": langid.query,
    "op6_embedding_dedup": embed_dedup.query,
    "op7_packing": packing.query,
    "op8_toxicity": toxicity.query,
    "op9_warc": warc.query,
    "op10_token_counts": token_counts.query,
    "op11_fingerprints": fingerprints.query,
    "op12_alignment": alignment.query,
    "op13_turn_repair": turn_repair.query,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op2_topk_search": topk.SQL,
    "op6_embedding_dedup": embed_dedup.SQL,
    "op9_warc": warc.SQL,
}
