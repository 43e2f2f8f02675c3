"""The registered training-data queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from rarefold.llm import ann, convrepair, ctxmix, exactdup, filteraudit, htmlcut, langid, mixing, packing, quality, simhash, sketch, tokens

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_langid": langid.op2_langid,
    "op3_ctxmix": ctxmix.op3_ctxmix,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_quality": quality.op7_quality,
    "op8_fingerprints": sketch.op8_fingerprints,
    "op9_html": htmlcut.op9_html,
    "op10_packing": packing.op10_packing,
    "op11_conversation_repair": convrepair.op11_conversation_repair,
    "op12_filter_audit": filteraudit.op12_filter_audit,
    "op13_exact_dedup": exactdup.op13_exact_dedup,
}
ORACLE = {"op5_mixing": mixing.ORACLE_OP5, "op12_filter_audit": filteraudit.ORACLE_OP12, "op13_exact_dedup": exactdup.ORACLE_OP13}
