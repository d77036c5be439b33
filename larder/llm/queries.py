"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from larder.llm import (
    ann, bpe, fingerprints, langid, negatives, ngram_lm, packing, phrases, quality, quotes, secrets, simhash_dedup, warc)


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.query,
        "op2_language_id": langid.query,
        "op3_lm_scoring": ngram_lm.query,
        "op4_simhash_dedup": simhash_dedup.query,
        "op5_document_fingerprints": fingerprints.query,
        "op6_quotation_chat": quotes.query,
        "op7_warc_derivatives": warc.query,
        "op8_quality_rules": quality.query,
        "op9_bpe_codec": bpe.query,
        "op10_cost_packing": packing.query,
        "op11_phrase_mining": phrases.query,
        "op12_graph_neighbours": ann.query,
        "op13_hard_negatives": negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quotation_chat": quotes.SQL,
        "op8_quality_rules": quality.sql(),
        "op11_phrase_mining": phrases.SQL,
        "op13_hard_negatives": negatives.SQL,
    }
