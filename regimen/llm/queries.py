"""Registered queries of the corpus operators and the pipeline."""

from __future__ import annotations

from regimen.llm import (collocations, decontaminate, language_id, lexical_search, ngram_join, order_minhash, packing,
                         quality, simhash, suffix_dedup, toxicity, url_filter, warc)

QUERIES = {
    "op1_ppm_language_id": language_id.op1,
    "op2_winnowing_decontamination": decontaminate.op2,
    "op3_warc_derivatives": warc.op3,
    "op4_suffix_array_dedup": suffix_dedup.op4,
    "op5_order_minhash": order_minhash.op5,
    "op6_compression_quality": quality.op6,
    "op7_boosted_toxicity": toxicity.op7,
    "op8_url_language_model": url_filter.op8,
    "op9_simhash_golay": simhash.op9,
    "op10_best_fit_packing": packing.op10,
    "op11_ngram_jaccard_join": ngram_join.op11,
    "op12_phrase_collocations": collocations.op12,
    "op13_lexical_search": lexical_search.op13,
}

ORACLES: dict[str, str] = {
    "op3_warc_derivatives": warc.ORACLE,
    "op11_ngram_jaccard_join": ngram_join.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
