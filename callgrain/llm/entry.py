"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from callgrain.llm import alignment, ann, chat, collocations, html, langid, minhash, mixing, oracles, packing, pieces, quality, tokenfile, warc


def queries() -> dict:
    return {
        "op1_nearest_neighbours": ann.op1_nearest_neighbours,
        "op2_language_id": langid.op2_language_id,
        "op3_chat_format": chat.op3_chat_format,
        "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_token_files": tokenfile.op6_token_files,
        "op7_warc_revisits": warc.op7_warc_revisits,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_html_main_text": html.op9_html_main_text,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_best_fit_packing": packing.op11_best_fit_packing,
        "op12_collocations": collocations.op12_collocations,
        "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
