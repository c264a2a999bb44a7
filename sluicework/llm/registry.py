"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from sluicework.llm import collocations, hnsw, html_blocks, language_model, mixing, order_minhash, pieces, repeats, secrets, simhash, surrogates, toxicity, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mixing": mixing.query,
    "op2_simhash": simhash.query,
    "op3_repeats": repeats.query,
    "op4_toxicity": toxicity.query,
    "op5_pieces": pieces.query,
    "op6_surrogates": surrogates.query,
    "op7_secrets": secrets.query,
    "op8_order_minhash": order_minhash.query,
    "op9_html_blocks": html_blocks.query,
    "op10_hnsw": hnsw.query,
    "op11_collocations": collocations.query,
    "op12_language_model": language_model.query,
    "op13_whitening": whitening.query,
}
ORACLE = {"op1_mixing": mixing.SQL, "op3_repeats": repeats.SQL, "op7_secrets": secrets.SQL, "op11_collocations": collocations.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
