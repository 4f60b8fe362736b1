"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tracklathe.llm import embeddings, language_model, licenses, mixing, packing, quality, simhash, topk, toxicity, urls

QUERIES = {
    "op1_packing": packing.query,
    "op2_toxicity": toxicity.query,
    "op3_urls": urls.query,
    "op4_mixing": mixing.query,
    "op5_topk": topk.query,
    "op6_language_model": language_model.query,
    "op7_licenses": licenses.query,
    "op8_embeddings": embeddings.query,
    "op9_quality": quality.query,
    "op10_simhash": simhash.query,
}
SQL = {
    "op4_mixing": mixing.SQL,
    "op5_topk": topk.SQL,
    "op8_embeddings": embeddings.SQL,
}
