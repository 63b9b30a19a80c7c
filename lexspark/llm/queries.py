"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lexspark.llm import chat, fingerprints, jaccard, licenses, packing, pieces, pii, quality, repeats, structure, toxicity, vectors, whitening

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_embeddings": vectors.op3_embeddings,
    "op4_quality": quality.op4_quality,
    "op5_pack": packing.op5_pack,
    "op6_pieces": pieces.op6_pieces,
    "op7_pii": pii.op7_pii,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_repeats": repeats.op11_repeats,
    "op12_structure": structure.op12_structure,
    "op13_whitening": whitening.op13_whitening,
}
SQL: dict[str, str] = {"op1_chat_format": chat.SQL, "op2_jaccard": jaccard.SQL, "op3_embeddings": vectors.SQL, "op12_structure": structure.SQL}
