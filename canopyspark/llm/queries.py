"""The corpus queries and their DuckDB counterparts, where SQL can express them."""

from __future__ import annotations

from canopyspark.llm import bpe, jaccard, langid, lexical, linededup, merkle, mixing, mtree, passages, quality, simhash, suffixdedup, tokenfile

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_mtree": mtree.op2_mtree,
    "op3_suffixdedup": suffixdedup.op3_suffixdedup,
    "op4_linededup": linededup.op4_linededup,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_mixing": mixing.op6_mixing,
    "op7_tokenfile": tokenfile.op7_tokenfile,
    "op8_quality": quality.op8_quality,
    "op9_passages": passages.op9_passages,
    "op10_bpe": bpe.op10_bpe,
    "op11_simhash": simhash.op11_simhash,
    "op12_merkle": merkle.op12_merkle,
    "op13_lexical": lexical.op13_lexical,
}

ORACLES = {
    "op2_mtree": mtree.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_lexical": lexical.ORACLE,
}
