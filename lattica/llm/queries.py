"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bestfit, bitpack, chat, ctw, cws, decontaminate, merkle, ngram_join, oracle, quality, vectorbins


def queries() -> dict:
    return {
        "op1_ctw_score": ctw.op1_ctw_score,
        "op2_bitpacked_ids": bitpack.op2_bitpacked_ids,
        "op3_vector_shards": vectorbins.op3_vector_shards,
        "op4_cws_fingerprint": cws.op4_cws_fingerprint,
        "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_chat_windows": chat.op7_chat_windows,
        "op8_quality": quality.op8_quality,
        "op9_warc_fixity": merkle.op9_warc_fixity,
        "op10_bestfit_pack": bestfit.op10_bestfit_pack,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
