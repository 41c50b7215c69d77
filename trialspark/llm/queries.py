"""Registered queries of the corpus operators and their pipeline, with SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
from trialspark.llm import (
    op1_sentencepiece, op2_minhash, op3_toxicity, op4_substring, op5_suffix_array, op6_warc, op7_packing, op8_token_counts, op9_exact, op10_neighbours, op11_quality,
    op12_trie, op13_merkle,
)

CORPUS_QUERIES = {
    "op1_sentencepiece": op1_sentencepiece.query,
    "op2_minhash": op2_minhash.query,
    "op3_toxicity": op3_toxicity.query,
    "op4_substring": op4_substring.query,
    "op5_suffix_array": op5_suffix_array.query,
    "op6_warc": op6_warc.query,
    "op7_packing": op7_packing.query,
    "op8_token_counts": op8_token_counts.query,
    "op9_exact": op9_exact.query,
    "op10_neighbours": op10_neighbours.query,
    "op11_quality": op11_quality.query,
    "op12_trie": op12_trie.query,
    "op13_merkle": op13_merkle.query,
    "pipeline": corpus_pipeline.run,
}

CORPUS_ORACLES = {
    "op6_warc": op6_warc.ORACLE,
    "op9_exact": op9_exact.ORACLE,
    "op12_trie": op12_trie.ORACLE,
    "op13_merkle": op13_merkle.ORACLE,
}
