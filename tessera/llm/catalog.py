"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import (
    bpe,
    exact_dedup,
    language,
    lexical,
    minhash,
    mixing,
    oracles,
    passages,
    pii,
    quality,
    spelling,
    substring,
    toxicity,
    winnowing,
)

QUERIES = {
    "op1_suffix_array": substring.op1_suffix_array,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_pii": pii.op4_pii,
    "op5_minhash": minhash.op5_minhash,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_winnowing": winnowing.op8_winnowing,
    "op9_passages": passages.op9_passages,
    "op10_mixing": mixing.op10_mixing,
    "op11_spelling": spelling.op11_spelling,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_language": language.op13_language,
}

SQL = {
    "op5_minhash": oracles.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op10_mixing": oracles.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
}
