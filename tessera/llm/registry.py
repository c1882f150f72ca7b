"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tessera.llm import ann_hnsw, chat_format, exact_dedup, fill_middle, line_dedup, ngram_join, packing, pii, prefix_trie, sentencepiece_viterbi, sharding, topk_mtree, toxicity

#: Module and query of each operator.
OPERATORS = {
    packing: "op1_packing",
    sharding: "op2_sharding",
    exact_dedup: "op3_exact_dedup",
    toxicity: "op4_toxicity",
    ngram_join: "op5_ngram_join",
    sentencepiece_viterbi: "op6_sentencepiece",
    chat_format: "op7_chat_format",
    pii: "op8_pii",
    topk_mtree: "op9_topk",
    line_dedup: "op10_line_dedup",
    prefix_trie: "op11_prefix_trie",
    fill_middle: "op12_fill_middle",
    ann_hnsw: "op13_ann",
}


def queries() -> dict:
    return {name: getattr(module, name) for module, name in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in OPERATORS:
        out |= getattr(module, "SQL", {})
    return out
